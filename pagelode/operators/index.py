"""The inverted index: token arrays of pages, and postings that are sorted and cut by token."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .query import And, Not, Or, Phrase


def document_frequency(pages: DataFrame) -> DataFrame:
    """(token, df, tf) over all pages."""
    one = postings(pages).select("token", F.size("positions").alias("n"))
    return one.groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


def postings(pages: DataFrame) -> DataFrame:
    """(token, file_id, page_num, positions), without a shuffle: a page is one row, so its tokens are sorted with their
    positions inside it, and cut where the next token begins."""
    each = F.sort_array(F.transform(text.tokens(F.col("text")), lambda t, i: F.struct(t.alias("token"), i.alias("pos"))))
    rows = pages.select("file_id", "page_num", each.alias("each")).where(F.size("each") > 0)
    token = lambda i: F.element_at("each", i)["token"]
    begins = F.filter(F.sequence(F.lit(1), F.size("each")), lambda i: F.when(i == 1, True).otherwise(token(i) != token(i - 1)))
    rows = rows.select("file_id", "page_num", "each", begins.alias("begins"))
    ends = F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(F.size("each") + 1))
    rows = rows.select("file_id", "page_num", "each", F.arrays_zip(F.col("begins").alias("a"), ends.alias("z")).alias("spans"))
    positions = lambda s: F.transform(F.sequence(s["a"], s["z"] - 1), lambda i: F.element_at("each", i)["pos"])
    terms = F.transform("spans", lambda s: F.struct(token(s["a"]).alias("token"), positions(s).alias("positions")))
    return rows.select("file_id", "page_num", F.explode(terms).alias("t")).select("t.token", "file_id", "page_num", "t.positions")


def sorted_postings(pages: DataFrame, parts: int) -> DataFrame:
    """Postings in segments of pages, each sorted by token, so that a token or prefix reads a small piece of each segment. Only
    the pages are dealt out; a segment is sorted in one task, so there should be more of them for larger libraries."""
    return postings(pages.repartition(parts, "file_id", "page_num")).sortWithinPartitions("token", "file_id", "page_num")


def write_postings(pages: DataFrame, path: str, parts: int) -> None:
    """Running it again compacts."""
    sorted_postings(pages, parts).write.mode("overwrite").parquet(path)


def matching_pages(posts: DataFrame, tree: object) -> DataFrame:
    """(file_id, page_num) of pages that satisfy a query's tree, from postings alone."""
    keys = ["file_id", "page_num"]
    if isinstance(tree, And):
        return reduce(lambda a, b: a.join(b, keys, "left_semi"), [matching_pages(posts, p) for p in tree.parts])
    if isinstance(tree, Or):
        return reduce(lambda a, b: a.unionByName(b), [matching_pages(posts, p) for p in tree.parts]).distinct()
    if isinstance(tree, Not):
        return matching_pages(posts, tree.keep).join(matching_pages(posts, tree.drop), keys, "left_anti")
    return _phrase_pages(posts, tree)


def _moved(k: int) -> Column:
    return F.transform("positions", lambda x: x - k)


def _phrase_pages(posts: DataFrame, p: Phrase) -> DataFrame:
    keys = ["file_id", "page_num"]
    if not p.tokens:
        return posts.where(F.lit(False)).select(*keys)
    made = None
    for k, token in enumerate(p.tokens):
        last = k == len(p.tokens) - 1
        hit = F.startswith("token", F.lit(token)) if p.prefix and last else F.col("token") == token
        rows = posts.where(hit)
        starts = _moved(k)
        if p.prefix and last:
            rows = rows.groupBy(*keys).agg(F.flatten(F.collect_list("positions")).alias("positions"))
        rows = rows.select(*keys, starts.alias(f"s{k}"))
        made = rows if made is None else made.join(rows, keys)
    common = reduce(F.array_intersect, [F.col(f"s{k}") for k in range(len(p.tokens))])
    wanted = F.array_contains(common, 0) if p.initial else F.size(common) > 0
    return made.where(wanted).select(*keys)
