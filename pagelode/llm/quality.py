"""Quality rules with adaptive thresholds, by DataFrame functions only.

Fixed rules (``base_failed``) catch what no corpus wants. Beyond them a text is judged against its peers: quantile sketches
of a few figures are kept for each language and source, merged upwards to the language and to the whole, and the fences of
the most specific group that is large enough decide. A fence stands ``FENCE`` times the way from the median to the tail
quantile beyond that quantile, so its place and its width are both those of the group. Rates (events for each word or line)
get besides what chance alone adds to the count of a text of that length, as a Poisson count has it; no width is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import looked_up, written

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SKETCH_K = 1024
LEAST_GROUP = 200
#: The tail quantiles below and above the median, and how far beyond them the fences stand.
LOW_TAIL, TAIL, FENCE = 0.1, 0.9, 3.0
#: Standard deviations of chance that the count behind a rate may lie above its fence.
CHANCE = 4.0
MEAN = "mean_word_chars"
#: Each rate with the count that it is taken over.
RATES = {"symbols_per_word": "n_words", "dup_line_share": "n_lines", "repeat_word_share": "n_words"}
#: Columns that :func:`measured` adds.
MEASURES = ["word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", MEAN, *RATES]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the counts of the fixed rules and the ratios. A null text counts as empty.
    Columns of these names are replaced."""
    docs = docs.drop(*MEASURES)
    t = F.coalesce(F.col(text), F.lit(""))
    blank = F.lit(SPACE)
    trimmed = F.btrim(t, blank)
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    words = docs.select(
        *others,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+")).alias("__words"),
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
    )
    n = F.size("__words")
    names = [c for c in docs.columns if c != text] + ["word_chars", "n_symbols"]
    kept = [F.col(f"`{c}`") for c in names]
    three = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get("__words", i - 1), F.get("__words", i), F.get("__words", i + 1)))
    hashed = words.select(
        *kept,
        n.cast("long").alias("n_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 4, three).otherwise(F.array().cast("array<bigint>")).alias("__windows"),
    )
    names += ["n_words", "n_lines", "n_dup_lines"]
    repeats = F.size("__windows") > F.size(F.array_distinct("__windows"))
    zipped = F.arrays_zip(F.col("__windows").alias("h"), F.sequence(F.lit(1), F.size("__windows")).alias("i"))
    # Equal windows stand side by side once sorted; without any there is nothing to sort
    ordered = hashed.select(*[F.col(f"`{c}`") for c in names], F.when(repeats, F.sort_array(zipped)).alias("__sorted"))
    pairs = F.zip_with("__sorted", F.slice("__sorted", F.lit(2), F.size("__sorted")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = ordered.select(*[F.col(f"`{c}`") for c in names], F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))).alias("__starts"))
    steps = F.zip_with("__starts", F.slice("__starts", F.lit(2), F.greatest(F.size("__starts"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda total, x: total + x), F.lit(0)).cast("long")
    counted = starts.select(*[F.col(f"`{c}`") for c in names], covered.alias("n_repeat_words"))
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counted.withColumns({
        MEAN: over("word_chars", "n_words"), "symbols_per_word": over("n_symbols", "n_words"),
        "dup_line_share": over("n_dup_lines", "n_lines"), "repeat_word_share": over("n_repeat_words", "n_words"),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def fences(measures: DataFrame, groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """(__lang, __source, low, high, and for each rate its tail quantile and fence) among the texts that pass the fixed rules.

    A group under ``LEAST_GROUP`` texts takes the fences of its language, a language under it those of the whole.
    """
    lang, source = groups
    figures = [MEAN, *RATES]
    fine = measures.where(~F.col("base_failed"))
    level = fine.groupBy(lang, source).agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(r, F.lit(SKETCH_K)).alias(r) for r in figures])
    level = written(level, "quality-sketches")

    def quantiles(df: DataFrame, keys: list[str], suffix: str) -> DataFrame:
        """Numbers in place of the sketches, so that sketches are never joined: low, middle and high ones of each figure."""
        merged = df.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(r).alias(r) for r in figures])
        found = [F.kll_sketch_get_quantile_double(r, F.lit(q)).alias(f"{r}_{i}{suffix}") for r in figures for i, q in enumerate((LOW_TAIL, 0.5, TAIL))]
        return merged.select(*keys, F.col("n").alias("n" + suffix), *found)

    whole = quantiles(level.withColumn("__all", F.lit(0)), ["__all"], "").first() or {}  # one row of numbers, none of an empty table
    by_lang = quantiles(level, [lang], "_l").withColumnRenamed(lang, "__l")
    found = quantiles(level, [lang, source], "_g").join(by_lang, F.col(lang).eqNullSafe(F.col("__l")))

    def at(figure: str, i: int) -> Column:
        name = f"{figure}_{i}"
        return F.when(F.col("n_g") >= LEAST_GROUP, F.col(name + "_g")).when(F.col("n_l") >= LEAST_GROUP, F.col(name + "_l")).otherwise(F.lit(whole[name] if whole else None).cast("double"))

    beyond = lambda figure, i: at(figure, i) + FENCE * (at(figure, i) - at(figure, 1))
    ends = [beyond(MEAN, 0).alias("low"), beyond(MEAN, 2).alias("high")]
    for rate in RATES:
        ends += [at(rate, 2).alias("tail_" + rate), beyond(rate, 2).alias("fence_" + rate)]
    return found.select(F.col(lang).alias("__lang"), F.col(source).alias("__source"), *ends)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` without its text, with all measures, ``base_failed`` and ``kept``.

    Null languages and sources are groups of their own. Where no text of a group passes the fixed rules, none is kept, so
    no fence is needed. Repeated rows are judged each by itself, alike. An empty table gives an empty table.
    """
    measures = written(measured(docs.drop("kept"), text), "quality-measures")  # read twice: for the sketches and for the verdict
    limits = written(fences(measures, (lang, source)), "quality-fences")
    joined = looked_up(measures, limits, {lang: "__lang", source: "__source"})
    inside = F.col(MEAN).between(F.col("low"), F.col("high"))
    for rate, over in RATES.items():
        count = F.greatest(F.col(over), F.lit(1))
        chance = CHANCE * F.sqrt(F.col("tail_" + rate) / count) + CHANCE * CHANCE / count
        inside &= F.col(rate) <= F.col("fence_" + rate) + chance
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop(*limits.columns)
