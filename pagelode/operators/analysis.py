"""Analyses of a library: shared lines, titles, folders, catalogue, chat output and figures of benchmark runs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions import text

LEAST_LINE = 40
MOST_FILES = 5
LEAST_RATIO = 0.2


# ---- duplicates ----


def long_lines(rows: DataFrame, key: str, column: str = "text", least: int = LEAST_LINE) -> DataFrame:
    line = F.explode(F.transform(F.split(column, "\n", -1), lambda s: F.btrim(s, F.lit(" \t\r\x0b\f"))))
    return rows.select(F.col(key).alias("file_id"), line.alias("line")).where(F.length("line") >= least)


def duplicate_pairs(rows: DataFrame, key: str, column: str = "text", least: int = LEAST_LINE, most: int = MOST_FILES, ratio: float = LEAST_RATIO) -> DataFrame:
    """(file_a, file_b, shared, ratio_a, ratio_b) of files that share much of either's long lines.

    Lines in more than ``most`` files are boilerplate, so a line makes at most most * (most - 1) / 2 pairs. The files of a
    line are gathered in a set of at most most + 1 by partial aggregation; there is no join of lines with lines.
    """
    lines = long_lines(rows, key, column, least)
    sizes = lines.groupBy("file_id").agg(F.count("*").alias("n"))
    once = lines.select(F.xxhash64("line").alias("h"), F.md5("line").alias("m"), "file_id").distinct()
    df = once.groupBy("h", "m").agg(F.count("*").alias("df")).where(F.col("df").between(2, most))
    files = once.join(df, ["h", "m"], "left_semi").groupBy("h", "m").agg(F.array_sort(F.collect_list("file_id")).alias("fs"))
    a = files.select("fs", F.posexplode("fs").alias("i", "file_a"))
    pairs = a.select("file_a", F.explode(F.slice("fs", F.col("i") + 2, F.size("fs"))).alias("file_b")).groupBy("file_a", "file_b").agg(F.count("*").alias("shared"))
    for side in "ab":
        pairs = pairs.join(sizes.select(F.col("file_id").alias(f"file_{side}"), F.col("n").alias(f"n_{side}")), f"file_{side}")
    pairs = pairs.select("file_a", "file_b", "shared", (F.col("shared") / F.col("n_a")).alias("ratio_a"), (F.col("shared") / F.col("n_b")).alias("ratio_b"))
    return pairs.where(F.greatest("ratio_a", "ratio_b") >= ratio)


def by_overlap(pairs: DataFrame) -> DataFrame:
    """Pairs with the largest shared part of either file first."""
    return pairs.orderBy(F.greatest("ratio_a", "ratio_b").desc(), "file_a", "file_b")


def shared_lines(rows: DataFrame, key: str, column: str = "text", least: int = LEAST_LINE, most: int = MOST_FILES) -> DataFrame:
    """(file_a, file_b, line) of the long lines that pairs of files share, as :func:`duplicate_pairs` counts them."""
    once = long_lines(rows, key, column, least).distinct()
    df = once.groupBy("line").agg(F.count("*").alias("df")).where(F.col("df").between(2, most)).select("line")
    files = once.join(df, "line", "left_semi").groupBy("line").agg(F.array_sort(F.collect_list("file_id")).alias("fs"))
    a = files.select("line", "fs", F.posexplode("fs").alias("i", "file_a"))
    return a.select("file_a", F.explode(F.slice("fs", F.col("i") + 2, F.size("fs"))).alias("file_b"), "line")


@pandas_udf(StringType())
def _percent(share: pd.Series) -> pd.Series:
    """With one decimal, of the exact binary value and ties to even, as C and Python print; Java's formats round ties up."""
    return share.map(lambda v: f"{v * 100:.1f}", na_action="ignore")


def duplicate_report(pairs: DataFrame, shared: DataFrame, totals: DataFrame, paths: DataFrame, ratio: float = LEAST_RATIO) -> DataFrame:
    """(ratio, file_a, file_b, report): a text for each pair, with at most ten of its shared lines, long ones cut to 147 characters.

    ``totals``: (file_id, n) long lines of each file; ``paths``: (file_id, path). A pair shares a bounded number of lines with
    one file of its size, so they are gathered for each pair.
    """
    cut = lambda s: F.when(F.length(s) > 150, F.concat(F.left(s, F.lit(147)), F.lit("..."))).otherwise(s)
    lines = shared.groupBy("file_a", "file_b").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    rows = pairs.join(lines, ["file_a", "file_b"])
    for side in "ab":
        rows = rows.join(totals.select(F.col("file_id").alias(f"file_{side}"), F.col("n").alias(f"total_{side}")), f"file_{side}")
        rows = rows.join(paths.select(F.col("file_id").alias(f"file_{side}"), F.col("path").alias(f"path_{side}")), f"file_{side}")
    share = F.greatest("ratio_a", "ratio_b")
    shown = F.transform(F.slice("lines", 1, 10), lambda s: F.concat(F.lit("  - "), cut(s), F.lit("\n")))
    more = F.when(F.size("lines") > 10, F.concat(F.lit("  ... [and "), F.size("lines") - 10, F.lit(" more shared lines]\n"))).otherwise(F.lit(""))
    file = lambda side: F.concat(F.lit(f"File {side.upper()}: "), f"path_{side}", F.lit(" ("), F.col("shared"), F.lit(" shared paragraphs out of "), F.col(f"total_{side}"), F.lit(" total)\n"))
    head = F.concat(F.lit("Match: "), _percent(share), F.lit("% overlap\n"))
    report = F.concat(head, file("a"), file("b"), F.lit("Offending Sentences (Shared Content):\n"), F.array_join(shown, ""), more, F.lit("-" * 80 + "\n"))
    return rows.select(share.alias("ratio"), "file_a", "file_b", report.alias("report"))


def write_report(reports: DataFrame, path: str, ratio: float = LEAST_RATIO) -> None:
    """The reports as text files below ``path``, best pairs first over all files; a header stands before them."""
    bar, header = "=" * 80, f"POTENTIAL DUPLICATES REPORT (Threshold > {ratio:.0%})"
    first = reports.sparkSession.createDataFrame([(f"{bar}\n{header}\n{bar}\n", 2.0)], "report string, ratio double")
    reports.select("report", "ratio").unionByName(first).orderBy(F.col("ratio").desc()).select("report").write.mode("overwrite").option("lineSep", "").text(path)


# ---- titles ----


def title_matches(works: DataFrame, local: DataFrame) -> DataFrame:
    """Works (title) with ``found`` and the rule that found them: 'exact', 'part', 'tokens' or null.

    Equal normal forms and equal sorted tokens are joined by key. For a title as part of another, candidates are those where
    the first four letters of the shorter one are among the runs of four letters of the longer one.
    """
    norm = text.normalize_title(F.col("title"))
    key = F.array_join(F.array_sort(F.split(norm, " ")), " ")
    w = works.select("title", norm.alias("n"), key.alias("k")).distinct()
    loc = local.select(norm.alias("ln"), key.alias("lk")).where("ln <> ''").distinct()
    exact = w.join(loc.select(F.col("ln").alias("n")).distinct(), "n", "left_semi").select("title", F.lit(1).alias("rule"))
    tokens = w.join(loc.select(F.col("lk").alias("k")).distinct(), "k", "left_semi").select("title", F.lit(3).alias("rule"))
    # part of the other, either way round: the shorter title's first four letters are among the longer one's runs of four
    inside = [_parts(w, loc, "n", "ln"), _parts(loc, w, "ln", "n")]
    part = inside[0].unionByName(inside[1]).select("n").distinct().join(w, "n").select("title", F.lit(2).alias("rule"))
    best = exact.unionByName(part).unionByName(tokens).groupBy("title").agg(F.min("rule").alias("rule"))
    named = F.when(F.col("rule") == 1, "exact").when(F.col("rule") == 2, "part").when(F.col("rule") == 3, "tokens")
    return w.select("title").join(best, "title", "left").select("title", F.col("rule").isNotNull().alias("found"), named.alias("rule"))


def _parts(long: DataFrame, short: DataFrame, ln: str, sn: str) -> DataFrame:
    """(n, ln) where the title ``sn`` stands inside ``ln``: candidates share a run of four letters (or the whole, if shorter)."""
    runs = F.transform(F.sequence(F.lit(1), F.length(ln)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.substring(ln, i, k)))
    grams = long.where(F.col(ln) != "").select(ln, F.explode(F.array_distinct(F.flatten(runs))).alias("g"))
    return short.where(F.col(sn) != "").select(sn, F.left(sn, F.lit(4)).alias("g")).join(grams, "g").where(F.contains(ln, F.col(sn))).select(ln, sn)


WHOLE_RATIO, TOKEN_RATIO = 0.85, 0.8


def _grams(name: str) -> Column:
    """Distinct pairs of letters; a string of one letter is its own."""
    at = F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substring(name, i, F.lit(2))))


def _candidates(a: DataFrame, b: DataFrame, ratio: float) -> DataFrame:
    """(x, y) that may be alike by more than the ratio; ``a``: distinct strings x, ``b``: distinct strings y, none of them empty.

    A ratio bounds the letters without a partner, each of which spoils two pairs of letters of x at most, and the lengths. So
    x and y share one of the rarest pairs of x: of as many as can be spoilt, and one more.
    """
    spoilt = 4 * (1 - ratio) / (2 - ratio)  # for each letter of x
    theirs = b.select("y", F.explode(_grams("y")).alias("g"))
    rare = theirs.groupBy("g").agg(F.count("*").alias("df"))
    mine = a.select("x", F.explode(_grams("x")).alias("g")).join(rare, "g", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    order = F.row_number().over(Window.partitionBy("x").orderBy("df", "g"))
    picked = mine.withColumn("n", order).where((F.col("n") <= F.floor(F.length("x") * spoilt) + 1) & (F.col("df") > 0)).select("x", "g")
    longest = (2 - ratio) / ratio
    near = (F.length("y") <= F.length("x") * longest) & (F.length("x") <= F.length("y") * longest)
    return picked.join(theirs, "g").where(near).select("x", "y").distinct()


def fuzzy_title_matches(works: DataFrame, local: DataFrame) -> DataFrame:
    """(title, best, score): the most alike local title of each work that has one: whole titles over 0.85, or every token of the
    work over 0.8 like some token of the local one.

    Whole titles are compared where rare pairs of letters and lengths allow. For tokens, the vocabularies are compared so;
    then titles meet by the work's token whose like tokens stand in the fewest local titles.
    """
    norm = text.normalize_title(F.col("title"))
    w = works.select("title", norm.alias("x")).where("x <> ''").distinct()
    loc = local.select(F.col("title").alias("local_title"), norm.alias("y")).where("y <> ''").distinct()
    xs, ys = w.select("x").distinct(), loc.select("y").distinct()
    whole = _candidates(xs, ys, WHOLE_RATIO).where(text.whole_alike("x", "y"))

    mine, theirs = xs.select("x", F.explode(F.array_distinct(F.split("x", " "))).alias("t")), ys.select("y", F.explode(F.array_distinct(F.split("y", " "))).alias("u"))
    vocabulary = _candidates(mine.select(F.col("t").alias("x")).distinct(), theirs.select(F.col("u").alias("y")).distinct(), TOKEN_RATIO)
    like = vocabulary.where(text.token_alike("x", "y")).select(F.col("x").alias("t"), F.col("y").alias("u"))
    often = like.join(theirs.groupBy("u").agg(F.count("*").alias("df")), "u").groupBy("t").agg(F.sum("df").alias("df"))
    rarest = mine.join(often, "t", "left").groupBy("x").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("t"))).alias("m")).where("m.df > 0").select("x", F.col("m.t").alias("t"))
    met = rarest.join(like, "t").join(theirs, "u").select("x", "y").distinct()
    by_token = met.where(text.tokens_alike("x", "y"))

    scored = whole.unionByName(by_token).distinct().withColumn("score", text.similarity("x", "y"))
    rows = w.join(scored, "x").join(loc, "y")
    return rows.groupBy("title").agg(F.max(F.struct("score", "local_title")).alias("b")).select("title", F.col("b.local_title").alias("best"), F.col("b.score").alias("score"))


# ---- folders and catalogue ----


def unique_folders(files: DataFrame) -> DataFrame:
    """Every folder above a file, and '(Root)' where files have none."""
    parts = F.split("relative_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.select(F.explode(F.when(F.size(parts) == 1, F.array(F.lit("(Root)"))).otherwise(above)).alias("folder")).distinct()


def allowed(folder: Column, allow: list[str]) -> Column:
    """Whether a folder is one of the allowed or below it; an empty list allows all."""
    found = F.lit(not allow)
    for a in allow:
        found |= (folder == a) | F.startswith(folder, F.lit(a + "/"))
    return found


def resolved_allow_list(user: Column, guild: Column, default: Column) -> Column:
    return F.coalesce(user, guild, default)


def autocomplete(folders: DataFrame, typed: str, allow: list[str], most: int = 25) -> DataFrame:
    return folders.where(allowed(F.col("folder"), allow) & F.contains(F.lower("folder"), F.lit(typed.lower()))).orderBy("folder").limit(most)


def split_folders(value: Column) -> Column:
    """Parts of a comma list, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(value, ","), lambda s: F.trim(s)), lambda s: s != "")


def id_list(value: Column) -> Column:
    """Distinct numbers of a comma list; quotes and anything else that isn't all digits is dropped."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(value, ","), lambda s: F.btrim(F.trim(s), F.lit("'\" "))), lambda s: F.regexp_like(s, F.lit("^[0-9]+$")))))


def clamped(value: Column, default: int, low: int, high: int) -> Column:
    return F.least(F.greatest(F.coalesce(value.try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def catalogue(files: DataFrame) -> DataFrame:
    """(folder, entries): visible files of each folder in natural order."""
    rows = files.select(text.folder_of(F.col("relative_path")).alias("folder"), F.struct(text.natural_key(F.col("filename")).alias("k"), F.col("filename").alias("f")).alias("e"))
    return rows.groupBy("folder").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["f"]).alias("entries"))


def embed_pages(hits: DataFrame, per: int = 3) -> DataFrame:
    """Hits (file_id, page_num) with their number and page in the chat's list, and (file_id, start) of each book. Hits are numbered
    within their books; only the counts, a row for each book, are summed by one task."""
    counts = hits.groupBy("file_id").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file_id", before.alias("before"))
    n = F.col("before") + F.row_number().over(Window.partitionBy("file_id").orderBy("page_num"))
    return hits.join(starts, "file_id").select("file_id", "page_num", n.alias("n"), F.floor((n - 1) / per).cast("int").alias("embed_page"), F.floor(F.col("before") / per).cast("int").alias("book_start"))


def match_block(folder: Column, name: Column, i: Column, total: Column, page: Column, chapter: Column, snippet: Column) -> Column:
    head = F.concat(F.lit("**["), folder, F.lit("] "), name, F.lit(" ("), i.cast("string"), F.lit("/"), total.cast("string"), F.lit(")**"))
    place = F.concat(F.lit("Page "), page.cast("string"), F.coalesce(F.concat(F.lit(" - "), chapter), F.lit("")))
    quoted = F.concat(F.lit("> "), F.replace(snippet, F.lit("\n"), F.lit("\n> ")))
    return F.concat_ws("\n", head, place, quoted)


def catalogue_text(listed: DataFrame, root: str) -> DataFrame:
    """(n, block): the catalogue as text blocks in the natural order of folders, after a block that names the root."""
    lines = F.array_join(F.transform("entries", lambda e: F.concat(F.lit("  - "), e, F.lit("\n"))), "")
    blocks = listed.select(text.natural_key(F.col("folder")).alias("k"), F.concat(F.lit("["), F.col("folder"), F.lit("]\n"), lines, F.lit("\n")).alias("block"))
    first = listed.sparkSession.createDataFrame([([], f"Listing works in: {root}\n\n")], "k array<string>, block string")
    return blocks.unionByName(first).orderBy("k").select("block")


def result_json(found: DataFrame, *columns: str) -> DataFrame:
    return found.select(F.to_json(F.struct(*columns)).alias("document"))


# ---- figures of runs ----


def latencies(runs: DataFrame, key: str, value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return runs.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q.alias("q"), F.min(value).alias("min"), F.max(value).alias("max")).select(
        key, "n", "mean", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), "min", "max"
    )


def slowest(figures: DataFrame, key: str, most: int = 5) -> DataFrame:
    return figures.orderBy(F.col("mean").desc(), key).limit(most)


def compared(base: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    b, c = base.select(key, F.col(value).alias("base")), now.select(key, F.col(value).alias("current"))
    return b.join(c, key).select(key, "base", "current", (F.col("current") - F.col("base")).alias("delta"), F.when(F.col("base") != 0, (F.col("current") - F.col("base")) / F.col("base") * 100).alias("percent"))


def averaged(runs: DataFrame, key: str, value: str) -> DataFrame:
    return runs.groupBy(key).agg(F.avg(value).alias("mean"))


def write_runs(runs: DataFrame, path: str) -> None:
    """Results of benchmark runs (run, document: JSON), a line for each."""
    runs.select("run", "document").write.mode("overwrite").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("run bigint, document string").json(path)


LEAF = StructType([StructField("path", ArrayType(StringType())), StructField("number", DoubleType()), StructField("other", StringType())])


def _leaves(value: object, path: list[str]) -> list[dict]:
    if isinstance(value, dict):
        return [leaf for k, v in value.items() for leaf in _leaves(v, [*path, f".{k}"])]
    if isinstance(value, list):
        return [{"path": [*path, f"#{len(value)}"], "number": None, "other": None}] + [leaf for i, v in enumerate(value) for leaf in _leaves(v, [*path, f"[{i}"])]
    number = float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    return [{"path": path, "number": number, "other": None if number is not None else json.dumps(value)}]


def leaves(runs: DataFrame) -> DataFrame:
    """(run, path, number, other): numbers and other values of nested results, with the names and places that lead to them."""

    @pandas_udf(ArrayType(LEAF))
    def taken(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: _leaves(json.loads(d), []), na_action="ignore")

    return runs.select("run", F.explode(taken("document")).alias("l")).select("run", "l.*")


def averaged_runs(runs: DataFrame, meta: tuple[str, ...] = ("timestamp", "db")) -> DataFrame:
    """(path, value): each number averaged over the runs that have it, and other values of the first run.

    The fields ``meta`` are the first run's. A list is averaged place by place if it has one length in all runs, else the first
    run's stands.
    """
    rows = leaves(runs)
    first = rows.agg(F.min("run").alias("first"))  # one row
    rows = rows.join(F.broadcast(first))
    size = F.startswith(F.element_at("path", -1), F.lit("#"))
    uneven = rows.where(size).groupBy(F.slice("path", F.lit(1), F.size("path") - 1).alias("list")).agg(F.countDistinct(F.element_at("path", -1)).alias("n")).where("n > 1").select("list")
    rows = rows.where(~size)
    heads = F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i))
    inside = rows.select("path", F.explode(heads).alias("list")).distinct().join(uneven, "list", "left_semi").select("path").distinct().withColumn("uneven", F.lit(True))
    rows = rows.join(inside, "path", "left")
    alone = F.coalesce("uneven", F.lit(False)) | F.get("path", F.lit(0)).isin(*["." + m for m in meta])
    figures = rows.groupBy("path").agg(F.avg("number").alias("mean"), F.min_by(F.coalesce(F.col("number").cast("string"), F.col("other")), "run").alias("value"), F.max(alone).alias("alone"), F.min("run").alias("least"), F.first("first").alias("first"))
    own = F.col("alone") & (F.col("least") > F.col("first"))
    return figures.where(~own).select(F.array_join("path", "").alias("path"), F.when(F.col("alone") | F.col("mean").isNull(), F.col("value")).otherwise(F.col("mean").cast("string")).alias("value"))
