"""Triage of extracted text: is it missing, is it garbled, and what became of earlier attempts to read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

QUANTILES = (0.10, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.90)
MISSING_CHARS, MISSING_CHARS_IMAGES, MISSING_MOST = 15, 10, 50
MOST_ATTEMPTS = 3


def sampled(pages: DataFrame) -> DataFrame:
    """Pages at ten fixed quantiles of a file of more than ten pages, else its first, middle and last."""
    n = pages.groupBy("file_id").agg(F.count("*").alias("n"))
    many = F.transform(F.array(*[F.lit(q) for q in QUANTILES]), lambda q: F.floor(F.col("n") * q).cast("int"))
    few = F.array(F.lit(0), F.floor(F.col("n") / 2).cast("int"), (F.col("n") - 1).cast("int"))
    at = n.select("file_id", F.explode(F.array_distinct(F.when(F.col("n") > 10, many).otherwise(few))).alias("i"))
    return pages.join(at.select("file_id", (F.col("i") + 1).cast("int").alias("page_num")), ["file_id", "page_num"], "left_semi")


def words(t: Column) -> Column:
    """Words of Latin letters, in lower case."""
    return F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\b[a-z]+\b"), F.lit(0))


def common(found: Column) -> Column:
    """Those of the words that every English text has."""
    return F.filter(found, lambda w: w.isin(*rules.STOP_WORDS))


def features(pages: DataFrame) -> DataFrame:
    """Figures of each file from its sampled pages, in one grouping."""
    t = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\r\x0b\f"))
    junk = F.lit(False)
    for p in rules.JUNK_PAGE:
        junk |= F.regexp_like("t", F.lit(p))
    found = words(F.col("t"))
    letters = F.filter(F.regexp_extract_all("t", F.lit(rules.REPEATED_CHARS), F.lit(1)), lambda c: c != "_")
    repeated = F.filter(
        F.regexp_extract_all("t", F.lit(rules.REPEATED_TOKENS), F.lit(1)),
        lambda m: F.regexp_like(m, F.lit(r"[\p{L}\p{N}]")) & ~F.regexp_like(F.regexp_replace(m, F.lit(r"[^\p{L}\p{N}]"), F.lit("")), F.lit(r"^\p{Nd}+$")),
    )
    rows = sampled(pages).select("file_id", "page_num", t.alias("t"))
    rows = rows.select("file_id", F.length("t").alias("chars"), ((F.col("t") == "") | junk).cast("int").alias("junk"), F.size(found).alias("words"), F.size(common(found)).alias("common"), F.size(letters).alias("letters"), F.size(repeated).alias("repeated"))
    return rows.groupBy("file_id").agg(
        F.count("*").alias("n_pages"), F.sum("chars").alias("total_chars"), F.max("chars").alias("max_chars"), F.sum("junk").alias("junk_pages"),
        F.sum("words").alias("n_words"), F.sum("common").alias("n_common"), F.sum("letters").alias("n_repeated_chars"), F.sum("repeated").alias("n_repeated_tokens"),
    )


def status(found: DataFrame, images: bool = False) -> DataFrame:
    """(file_id, status): 'redo', 'missing' or null. The order of the rules decides: a file of empty pages is 'redo'."""
    ratio = F.when(F.col("n_words") > 50, F.col("n_common") / F.col("n_words")).otherwise(F.lit(0.0))
    average = F.col("total_chars") / F.col("n_pages")
    missing = (average < (MISSING_CHARS_IMAGES if images else MISSING_CHARS)) & (F.col("max_chars") < MISSING_MOST)
    decided = (
        F.when(F.col("junk_pages") / F.col("n_pages") > 0.4, "redo")
        .when((F.col("n_words") < 10) & (F.col("total_chars") > 500), "redo")
        .when(F.col("n_repeated_chars") > F.when(ratio >= 0.10, 50).otherwise(10), "redo")
        .when(F.col("n_repeated_tokens") > 8, "redo")
        .when(missing, "missing")
        .when((F.col("n_words") > 50) & (ratio < 0.055), "redo")
    )
    return found.select("file_id", decided.alias("status"))


def exempted(found: DataFrame, never: list[str], not_redo: list[str], name: str = "filename") -> DataFrame:
    """No status for files that are exempt, and none of 'redo' for those exempt from that."""
    keep = ~F.col(name).isin(*never) if never else F.lit(True)
    redo = ~F.col(name).isin(*not_redo) if not_redo else F.lit(True)
    return found.withColumn("status", F.when(keep & (redo | (F.col("status") != "redo")), F.col("status")))


def next_queue(queue: DataFrame, attempts: DataFrame) -> DataFrame:
    """(path, attempts, state): queue (path, attempts) after results (path, ok). Success clears, the third failure poisons."""
    both = queue.join(attempts, "path", "full_outer")
    failed = F.coalesce("attempts", F.lit(0)) + 1
    return both.select(
        "path", F.when(F.col("ok").isNull(), F.coalesce("attempts", F.lit(0))).when(F.col("ok"), F.lit(0)).otherwise(failed).cast("int").alias("attempts"),
        F.when(F.col("ok").isNull(), "waiting").when(F.col("ok"), "done").when(failed >= MOST_ATTEMPTS, "poisoned").otherwise("requeued").alias("state"),
    )
