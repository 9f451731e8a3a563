"""Scalar functions on text as columns: tokens, sort keys, escaping, highlighting, snippets' helpers, titles and links."""

from __future__ import annotations

import difflib
import html as _html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, DoubleType

from . import rules

TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def fold(text: Column) -> Column:
    """Lower case without accents, as the index sees it."""
    return F.translate(F.lower(text), rules.ACCENTED, rules.PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and numbers, folded. Null gives null."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def token_text(text: Column) -> Column:
    """The tokens in order with one blank before and after each: a phrase is a plain substring of it. Null gives null."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(fold(text), F.lit(r"[^\p{L}\p{N}\p{Co}]+"), F.lit(" ")), F.lit(" ")), F.lit(" "))


def natural_key(name: Column) -> Column:
    """Sorts 'Volume 2' before 'Volume 10': parts of digits are padded, others in lower case."""
    led = F.concat(F.when(F.regexp_like(name, F.lit(r"^\d")), F.lit("\u0001")).otherwise(F.lit("")), name)
    parts = F.regexp_extract_all(led, F.lit(r"\d+|\D+"), F.lit(0))
    number = lambda p: F.lpad(F.regexp_replace(p, F.lit("^0+(?=.)"), F.lit("")), 40, "0")
    return F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit(r"^\d")), number(p)).otherwise(F.lower(p)))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))).otherwise(text)


def to_markdown(snippet: Column) -> Column:
    """Highlighted HTML to chat markdown: bold stays, other tags go, special characters are escaped."""
    for a, b in (("<b>", "\u0001"), ("</b>", "\u0002")):
        snippet = F.replace(snippet, F.lit(a), F.lit(b))
    snippet = F.regexp_replace(snippet, F.lit("<[^>]+>"), F.lit(""))
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        snippet = F.replace(snippet, F.lit(a), F.lit(b))
    snippet = F.regexp_replace(snippet, F.lit(r"([\\*_~`>#])"), F.lit(r"\\$1"))
    for a in ("\u0001", "\u0002"):
        snippet = F.replace(snippet, F.lit(a), F.lit("**"))
    return snippet


def normalize_title(name: Column) -> Column:
    """Lower case, without known file endings and apostrophes, separators to single blanks."""
    name = F.regexp_replace(F.lower(name), F.lit(r"\.(pdf|epub|mobi|azw3|txt|docx?|cbz|cbr)$"), F.lit(""))
    name = F.translate(name, "'’‘`", "")
    return F.trim(F.regexp_replace(name, F.lit(r"[^\p{L}\p{N}]+"), F.lit(" ")))


def is_page_number(line: Column) -> Column:
    return F.regexp_like(line, F.lit(rules.PAGE_NUMBER))


def digits_to_token(line: Column) -> Column:
    return F.regexp_replace(line, F.lit(r"\d+"), F.lit("<NUM>"))


def folder_of(path: Column) -> Column:
    """The folder of a path; '(Root)' for a file without one."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(folder == "", F.lit("(Root)")).otherwise(folder)


def without_pdf(name: Column) -> Column:
    return F.regexp_replace(name, F.lit(r"\.pdf\z"), F.lit(""))


def browser_link(path: Column, page: Column, root: str | None = "") -> Column:
    """A link to a page of a file below the served root, its path encoded as in URLs; null where nothing is served."""
    if root is None:
        return F.lit(None).cast("string")
    url = F.url_encode(F.replace(path, F.lit("\\"), F.lit("/")))
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("%21", "!"), ("%24", "$"), ("%26", "&"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2B", "+"), ("%2C", ","), ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@")):
        url = F.replace(url, F.lit(a), F.lit(b))
    return F.concat(F.lit("/file/"), url, F.lit("#page="), page.cast("string"))


def _over(a: str, b: str, limit: float) -> bool:
    """Whether the similarity is over the limit; two upper bounds that cost little come first."""
    m = difflib.SequenceMatcher(None, a, b)
    return m.real_quick_ratio() > limit and m.quick_ratio() > limit and m.ratio() > limit


@pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two strings (Ratcliff and Obershelp)."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


@pandas_udf(BooleanType())
def whole_alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether the similarity is over 0.85."""
    return pd.Series([_over(x or "", y or "", 0.85) for x, y in zip(a, b, strict=True)], dtype=bool)


@pandas_udf(BooleanType())
def token_alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two tokens are equal or their similarity is over 0.8."""
    return pd.Series([x == y or _over(x or "", y or "", 0.8) for x, y in zip(a, b, strict=True)], dtype=bool)


@pandas_udf(BooleanType())
def tokens_alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether every token of the first is over 0.8 like some token of the second."""
    alike = lambda t, u: t == u or _over(t, u, 0.8)
    return pd.Series([bool(x) and all(any(alike(t, u) for u in y.split()) for t in x.split()) for x, y in zip(a, b, strict=True)], dtype=bool)


# ---- patterns from query terms (plain Python: they are few, and built once for each query) ----

_TABLE = str.maketrans(rules.SINGLE_CHARACTERS | rules.STRING_CHARACTERS | dict.fromkeys(rules.DROPPED_CHARACTERS, ""))
_SPACER = r"[^\w]{0,15}"


def _loose(term: str, hyphen: bool = True) -> str:
    out = []
    for c in term:
        if c == " ":
            out.append(_SPACER)
        elif c == "'":
            out.append(r"['’]\s*")
        elif c == "-" and hyphen:
            out.append(r"[-\s]?")
        else:
            out.append(re.escape(c))
    return "".join(out)


def _bounded(term: str, body: str) -> str:
    return (r"\b" if term[0].isalnum() else "") + body + (r"\b" if term[-1].isalnum() else "")


def highlight_patterns(terms: list[str]) -> list[re.Pattern]:
    found = []
    for term in terms:
        t = _html.escape(term.strip('"').translate(_TABLE), quote=False)
        if not t:
            continue
        if t.endswith("*") and len(t) > 1:
            found.append(re.compile(r"(\b" + _loose(t[:-1]) + r"\w*)", re.I))
        else:
            found.append(re.compile("(" + _bounded(t, _loose(t)) + ")", re.I))
    return found


def match_probes(terms: list[str]) -> list[re.Pattern]:
    """Where a term stands in a text in lower case; used to decide on stitching."""
    found = []
    for term in terms:
        t = term.strip('"').translate(_TABLE).lower()
        if t:
            found.append(re.compile(r"\b" + _loose(t[:-1]) if t.endswith("*") else _bounded(t, _loose(t))))
    return found


def offset_patterns(terms: list[str]) -> list[list[re.Pattern]]:
    """For each term its spellings: as it is, and without or with blanks for hyphens."""
    found = []
    for term in terms:
        t = term.strip('"').strip().translate(_TABLE).lower()
        if not t:
            continue
        if t.endswith("*") and len(t) > 1:
            found.append([re.compile(r"\b" + _loose(t[:-1], hyphen=False))])
        else:
            spelled = dict.fromkeys([t, t.replace("-", ""), t.replace("-", " ")]) if "-" in t else {t: None}
            found.append([re.compile(_bounded(v, _loose(v, hyphen=False))) for v in spelled if v])
    return found
