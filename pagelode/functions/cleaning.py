"""The cleaning pipeline of page texts as columns.

Every step but two is a regular expression or a character table and runs in the JVM. The two that keep a state or decide
by words (double quotes, words broken at a hyphen) are Arrow UDFs over whole columns. The order of the steps matters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from . import rules


def _each(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to))
    return text


def whitespace(text: Column) -> Column:
    """Runs of white space other than line ends become one blank."""
    return _each(text, (r"(?U)[^\S\n]+", " "))


def spaced_out(text: Column) -> Column:
    """'s o m e' becomes 'some'; in texts over 2000 characters line by line, and not in lines over 2000."""
    fixed = lambda t: F.regexp_replace(t, F.lit(r"(?U)(?<=\b\w) (?=\w\b)"), F.lit(""))
    by_line = F.array_join(F.transform(F.split(text, "\n", -1), lambda line: F.when(F.length(line) > 2000, line).otherwise(fixed(line))), "\n")
    found = F.regexp_like(text, F.lit(r"(?U)\b\w\s\w\s\w\b"))
    return F.when(~found, text).when(F.length(text) > 2000, by_line).otherwise(fixed(text))


def watermarks(text: Column) -> Column:
    return _each(text, (rules.WATERMARKS, ""))


def boilerplate(text: Column) -> Column:
    return _each(text, *[(p, "") for p in rules.BOILERPLATE])


def ellipsis(text: Column) -> Column:
    return _each(text, (rules.SPACED_ELLIPSIS, "..."))


def garbage(text: Column) -> Column:
    return _each(text, *[(p, "") for p in rules.GARBAGE])


def characters(text: Column) -> Column:
    """Quotes, dashes, ligatures and misread letters to plain ones; control characters go."""
    table = rules.SINGLE_CHARACTERS
    text = F.translate(text, "".join(table) + rules.DROPPED_CHARACTERS.replace("\0", ""), "".join(table.values()))
    text = F.replace(text, F.lit("\0"), F.lit(""))
    for c, to in rules.STRING_CHARACTERS.items():
        text = F.replace(text, F.lit(c), F.lit(to))
    return text


def collapse(text: Column) -> Column:
    return _each(text, (" +", " "))


# ---- display fixes ----


def _hold(text: Column, pattern: str, swaps: dict[str, str]) -> Column:
    """Within matches of the pattern, characters become place holders: match by match, by splitting around them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def held(x: Column) -> Column:
        for a, b in swaps.items():
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    parts = F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(held(b), F.lit(""))))
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(parts, ""))


def protect_urls(text: Column) -> Column:
    return _hold(F.replace(text, F.lit("�"), F.lit("")), rules.PROTECTED_URL, {".": "<PRD>", ":": "<COLON>", ",": "<COMMA>"})


def protect_abbreviations(text: Column) -> Column:
    return _hold(text, rules.PROTECTED_ABBREVIATION, {".": "<PRD>"})


def protect_references(text: Column) -> Column:
    return _hold(text, rules.PROTECTED_REFERENCE, {";": "<SEMICOLON>"})


def protect(text: Column) -> Column:
    """URLs, two abbreviations and character references keep their punctuation until :func:`restore`."""
    return protect_references(protect_abbreviations(protect_urls(text)))


def restore(text: Column) -> Column:
    for a, b in {"<PRD>": ".", "<COLON>": ":", "<COMMA>": ",", "<SEMICOLON>": ";"}.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def contraction_rules() -> list[tuple[str, str]]:
    glued, apart = rules.GLUED_CONTRACTION
    return [*rules.MISREAD_WORDS, (r"(?iU)\b(" + "|".join(rules.CONTRACTIONS) + ")" + glued, apart), *rules.APOSTROPHES]


def contractions(text: Column) -> Column:
    """Apostrophes that stand apart from their words, or glue two words together."""
    return _each(text, *contraction_rules())


def quotes_before(text: Column) -> Column:
    return _each(text, *rules.QUOTES_BEFORE)


def quotes_after(text: Column) -> Column:
    return _each(text, *rules.QUOTES_AFTER)


def punctuation(text: Column) -> Column:
    return _each(text, *rules.PUNCTUATION)


def heal_urls(text: Column) -> Column:
    """URLs that were split at their punctuation; up to five passes, each a no-op once nothing changes."""
    healed = _each(text, *rules.SPLIT_URLS * 5)
    marked = F.contains(text, F.lit("http")) | F.contains(text, F.lit("www.")) | F.contains(text, F.lit("HTTP")) | F.contains(text, F.lit("WWW."))
    return F.when(marked, healed).otherwise(text)


_BESIDE = dict.fromkeys("([{", "bracket") | dict.fromkeys(".,!?;:", "stop") | dict.fromkeys(")]}", "end")
#: What a straight quote is, by the kinds of the characters before and after it; else the other of the last one.
_TURNS = {(x, y): True for x in ("blank", "bracket") for y in ("letter", "bracket", "other")} | {("stop", "letter"): True}
_TURNS |= {(x, y): False for x in ("stop", "end", "letter", "other") for y in ("blank", "end", "stop")}


def _beside(c: str) -> str:
    return "blank" if c.isspace() else "letter" if c.isalnum() else _BESIDE.get(c, "other")


def curl_line(line: str) -> str:
    """Straight double quotes of a line to curly ones, by what stands beside them and else in turn."""
    pieces = line.split('"')
    ends = len(pieces) - 1
    made, opening = [pieces[0]], False
    for i in range(ends):
        before = _beside(pieces[i][-1:] or ('"' if i else " "))
        after = _beside(pieces[i + 1][:1] or ('"' if i + 1 < ends else " "))
        colon = (pieces[i + 1][:1] == ":") and after == "stop"
        opening = _TURNS.get((before, "other" if colon else after), not opening)
        if opening:
            made.append(" “" if before == "stop" else "“")
        else:
            made.append("” " if after == "letter" else "”")
        made.append(pieces[i + 1])
    return "".join(made)


def curl(text: str | None) -> str | None:
    if not text or '"' not in text:
        return text
    return "\n".join(curl_line(line) if '"' in line else line for line in text.split("\n"))


_BROKEN = re.compile(r"\b([a-zA-Z]+)-\s+([a-zA-Z]+)")
_PREFIXES = frozenset(rules.HYPHEN_PREFIXES)


def _joined(m: re.Match) -> str:
    """Names and stutters stay as they are, compounds keep their hyphen, other words become one."""
    head, tail = m.groups()
    compound = head.lower() in _PREFIXES
    stutter = len(head) < 4 and tail.lower().startswith(head.lower())
    if tail[0].isupper() or (stutter and not compound):
        return m[0]
    return head + "-" * compound + (tail if head.isupper() else tail.lower())


def heal(text: str | None) -> str | None:
    """Words broken at a hyphen become whole; compounds, names and stutters stay."""
    return text if text is None or "-" not in text else _BROKEN.sub(_joined, text)


def _over(f, texts: pd.Series) -> pd.Series:
    return texts.map(f, na_action="ignore")


@pandas_udf(StringType())
def smart_quotes(texts: pd.Series) -> pd.Series:
    return _over(curl, texts)


@pandas_udf(StringType())
def heal_hyphens(texts: pd.Series) -> pd.Series:
    return _over(heal, texts)


def _has(*parts: str) -> Callable[[Column], Column]:
    return lambda text: reduce(or_, [F.contains(text, F.lit(x)) for x in parts])


def _like(*patterns: str) -> Callable[[Column], Column]:
    return lambda text: reduce(or_, [F.regexp_like(text, F.lit(x)) for x in patterns])


def _classes(characters: list[str]) -> list[str]:
    """Those below 256, which the engine keeps in a table, and the others, whose list it goes through for characters from there on."""
    low, high = ("".join(f"\\u{ord(c):04X}" for c in characters if (ord(c) < 256) == x) for x in (True, False))
    return [f"[{low}]", rf"[\u0100-\uFFFF&&[{high}]]"]


def _rule(pattern: str, to: str) -> Callable[[Column], Column]:
    return lambda text: _each(text, (pattern, to))


def _rules(rows: list[tuple[str, str]], *needs: Callable[[Column], Column]) -> list[tuple]:
    return [(need, _rule(*row)) for need, row in zip(needs, rows, strict=True)]


_GLUED, _STOPS = r"(?:s|t|d|m|ll|re|ve)", r"[~¦:;,.]"
#: The pipeline: what a text must hold for a step to change it, and the step. A text without it is passed on as it is, so that
#: most texts cost one cheap scan a step. After the first step, blanks and line ends are all the white space that there is; the
#: conditions count on that. Those of several rules hold for all of them: where none can match the text stays the same between.
STEPS = (
    (lambda t: _has("  ")(t) | _like(r"[\t\x0B\f\r\x85\xA0]", r"[\u1000-\uFFFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]")(t), whitespace),
    (_like(r"(?U)[ \n]\w[ \n]\w\b"), spaced_out),
    (_like(r"(?i)pdf|tfan"), watermarks),
    (lambda t: _has("CONTENTS", "Table of Contents")(t) | _like(r"(?iU)HORUS HERESY", rf"(?dUi)\A\s*{rules.BOILERPLATE_HEADS}", rf"(?dUi)\n\s*{rules.BOILERPLATE_HEADS}")(t), boilerplate),
    (_has(". .", ".\n.", ".  ", ". \n", ".\n ", ".\n\n"), ellipsis),
    *_rules(
        [(p, "") for p in rules.GARBAGE],
        _has("¦"), _like(r"[#=~*_\-]{4}"), _has("~", "¦"), _like(rf"{_STOPS}[A-Za-z0-9]+{_STOPS}+[A-Za-z0-9]"), _like("[~:.;,¦'\"“]{2,}(?:[ \n]|\\z)"),
        _like(rf"{_STOPS}{{2}}"), _like(r"([^ \n])\1{4}"), _like(r"(?=[^ \n]{6})([^ \n]{2,})\1{2}"), _like(r"(?:\A|[ \n])([^ \n]++)[ \n]++\1[ \n]++\1(?:[ \n]|\z)"), _has("####", "....."),
    ),
    (_like(*_classes([*rules.SINGLE_CHARACTERS, *rules.STRING_CHARACTERS, *rules.DROPPED_CHARACTERS])), characters),
    (lambda t: _has("://", "�")(t) | _like(r"[wW]{3}\.")(t), protect_urls),
    (_has(".g", ".G", ".e", ".E"), protect_abbreviations),
    (_has("&"), protect_references),
    *_rules(
        contraction_rules(),
        _has("fne"), _has("stus"), _like(rf"(?iU)'[ \n]*{_GLUED}[a-z]"), _has("s'", "S'"), _like(rf"(?iU)'[ \n]+{_GLUED}\b"), _like(rf"(?iU)[ \n]'{_GLUED}\b"), _has(" '"),
    ),
    *_rules(
        rules.QUOTES_BEFORE,
        _like("[ \n][‘“'\"][ \n]", "\\A[‘“'\"][ \n]"), _like("[ \n]['\"”’](?:[ \n.,!?;]|\\z)"), _like(r"(?U)'(?<=[^\w \n]')[A-Za-z]"),
    ),
    ('"', curl),
    *_rules(
        rules.QUOTES_AFTER,
        _has(",'", ":'", ";'"), _has(".'", "!'", "?'"), _like(r"(?iU)'(?<=[a-z]{3}')[a-z]{2}"), _has('"'), _has('"'), _has('""'), _has("''"),
    ),
    *_rules(
        rules.PUNCTUATION,
        _like(r"\.(?<=['\"“”‘’]\.)[ \n]*[A-Z]"), _has('"'), _has("..."), _like(r"[ \n][:,.!?;]"), _like(r"[:,.!?;][A-Za-z]"), _like(r"[.!?][ \n]+['\"“”‘’]"),
    ),
    (_has("<"), restore), (_has("http", "www.", "HTTP", "WWW."), heal_urls), (r"-\s", heal), (_has("  "), collapse),
)


def _in_python(rows: DataFrame, column: str, needed: str, step: Callable[[str], str]) -> DataFrame:
    """The step for texts that match the pattern. Not a UDF, above which Spark folds projections into one another."""
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            some = pc.fill_null(pc.match_substring_regex(texts, needed), False)
            if pc.any(some).as_py():
                made = pa.array([step(t) for t in texts.filter(some).to_pylist()], texts.type)
                batch = batch.set_column(at, batch.schema.field(at), pc.replace_with_mask(texts, some, made))
            yield batch

    return rows.mapInArrow(run, rows.schema)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of the session get at most 1000 rows or 4 MB, since texts can be long and each worker holds several copies."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def cleaned(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with a column of texts taken through the whole pipeline; null stays null.

    Each step is a projection of its own: steps that look at their input more than once are then not folded into one
    expression, which would work out all that stands before them again each time. Texts that a step can't change go round it.
    """
    small_batches(rows.sparkSession)
    text = F.col(column)
    for needed, step in STEPS:
        if isinstance(needed, str):
            rows = _in_python(rows, column, needed, step)
        else:
            rows = rows.withColumn(column, F.when(needed(text), step(text)).otherwise(text))
    return rows
