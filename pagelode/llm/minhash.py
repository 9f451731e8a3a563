"""Near-duplicate texts by DartMinHash signatures and banded joining.

Darts fall on the plane of weight and rank of each element (word shingle) as a Poisson process that depends on the element
alone. Cells of the plane hold one dart in the mean, and a cell's darts come from a hash of element and cell, so that only
cells below the weight of the element and below a rank bound are thrown: about K ln K darts for K coordinates, however
large the set. Each dart also names a coordinate; a coordinate keeps its dart of least rank. Two sets agree in a coordinate
with the probability of their weighted Jaccard similarity. Where a coordinate got no dart the bound is doubled.

Candidates come from bands of coordinates. Every text of a bucket is compared with the bucket's centre (the text that shares
the most with its buckets); then, in buckets that still hold texts of different classes, all texts of different classes are
compared, in blocks. So no pair of a bucket is lost, and a group of copies costs about as many comparisons as it has texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .components import components
from .runtime import map_arrow, written

THRESHOLD = 0.8
RECALL = 0.999
MOST_BANDS = 40
BLOCK = 512
SLICE = 1 << 19
CELLS = 1 << 18
_POISSON = np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1.0, *range(1, 14)])])
_TOP = np.uint64(2**64 - 1)


def tune(threshold: float = THRESHOLD, recall: float = RECALL, most_bands: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the longest bands that find a pair at the threshold with the wanted chance."""
    rows = 1
    while ceil(log(1 - recall) / log(1 - threshold ** (rows + 1))) <= most_bands:
        rows += 1
    return ceil(log(1 - recall) / log(1 - threshold**rows)), rows


def signatures(elements: np.ndarray, first: np.ndarray, coordinates: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Signatures (row, coordinate) of sets of hashed elements; a row without elements has all bits set everywhere.

    ``first``: where the rows begin in ``elements``, with the total at the end. Without ``weights`` each weighs 1 and
    repeated elements don't matter; with them an element must not be repeated within a row.
    """
    n = len(first) - 1
    out = np.full((n, coordinates), _TOP)
    count = np.diff(first)
    total = count.astype(float) if weights is None else np.add.reduceat(np.append(weights, 0.0), np.minimum(first[:-1], len(weights))) * (count > 0)
    todo = np.flatnonzero(total > 0)
    aim = coordinates * (log(coordinates) + 3)
    while len(todo):
        cells = np.cumsum(aim + count[todo])
        at = 0
        while at < len(todo):
            upto = max(at + 1, int(np.searchsorted(cells, (cells[at - 1] if at else 0) + CELLS)))
            _throw(out, todo[at:upto], elements, first, total, aim, weights)
            at = upto
        todo = todo[(out[todo] == _TOP).any(axis=1)]
        out[todo] = _TOP
        aim *= 2
    return out


def _throw(out: np.ndarray, rows: np.ndarray, elements: np.ndarray, first: np.ndarray, total: np.ndarray, aim: float, weights: np.ndarray | None) -> None:
    k = out.shape[1]
    count = first[rows + 1] - first[rows]
    at = np.repeat(first[rows] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    row = np.repeat(np.arange(len(rows)), count)
    bound = aim / total[rows]
    element, slab = elements[at], np.zeros(len(at), np.int64)
    weight = None
    if weights is not None:  # slabs [0, 1), [1, 2), [2, 4), ... of the weight axis
        weight = weights[at]
        slabs = 1 + np.ceil(np.log2(np.maximum(weight, 1.0))).astype(np.int64)
        row, element, weight = np.repeat(row, slabs), np.repeat(element, slabs), np.repeat(weight, slabs)
        slab = np.arange(len(row)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
    height = np.left_shift(1, np.maximum(slab - 1, 0))
    cells = np.ceil(bound[row] * height).astype(np.int64)
    cell = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells)
    which = np.repeat(np.arange(len(row)), cells)
    h = words.mix(element[which] + words.mix((cell.astype(np.uint64) << np.uint64(8)) + slab[which].astype(np.uint64)))
    darts = np.searchsorted(_POISSON, (h >> np.uint64(11)).astype(float) * 2.0**-53, "right")
    of = np.repeat(np.arange(len(h)), darts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = words.mix(h[of] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(words.BASE))
    which = which[of]
    rank = (cell[of].astype(np.uint64) << np.uint64(32) | dart >> np.uint64(32)) >> np.maximum(slab[which] - 1, 0).astype(np.uint64)
    on = rank < (bound[row[which]] * 2.0**32).astype(np.uint64)
    if weight is not None:
        low = np.where(slab[which] == 0, 0, height[which])
        on &= low + height[which] * ((words.mix(dart) >> np.uint64(11)).astype(float) * 2.0**-53) < weight[which]
    coordinate = ((dart & np.uint64(0xFFFFFFFF)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    best = np.full(len(rows) * k, _TOP)
    np.minimum.at(best, row[which[on]] * k + coordinate[on], rank[on])
    out[rows] = best.reshape(len(rows), k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each row; the number of the band is part of it."""
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(words.BASE), (len(signature), bands)).copy()
    parts = signature.reshape(len(signature), bands, rows)
    for k in range(rows):
        h = words.mix(h * np.uint64(words.BASE) + parts[:, :, k])
    return h.view(np.int64)


def signed(units: DataFrame, bands: int, rows: int, k: int = words.SHINGLE) -> DataFrame:
    """(uid, f1, f2, bands) for each unit with a word: f1 and f2 are a 128-bit hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, texts = batch.column(0), batch.column(1)
            for i, j in words.slices(texts, SLICE):
                part = texts.slice(i, j - i)
                elements, first = words.Words(part).shingles(k)
                some = np.flatnonzero(np.diff(first) > 0)
                if not len(some):
                    continue
                keys = band_keys(signatures(elements, first, bands * rows)[some], bands, rows)
                prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(part[int(r)].as_py().encode()) for r in some), np.int64).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * bands, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([uid.slice(i, j - i).take(pa.array(some)), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), lists], ["uid", "f1", "f2", "bands"])

    return map_arrow(units.select("uid", "text"), run, "uid bigint, f1 bigint, f2 bigint, bands array<bigint>")


def _sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    elements, first = words.Words(texts).shingles(k)
    return [np.unique(elements[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least the threshold."""
    small, large = sorted((len(a), len(b)))
    if not small or small < threshold * large - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= threshold * (small + large - both) - 1e-9


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, k: int = words.SHINGLE) -> DataFrame:
    """The pairs (a, b) whose texts have the similarity; ``texts``: (uid, text)."""
    left, right = (texts.select(F.col("uid").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                x, y = _sets(part.column(2), k), _sets(part.column(3), k)
                yield part.select(["a", "b"]).filter(pa.array([similar(p, q, threshold) for p, q in zip(x, y, strict=True)], pa.bool_()))

    return map_arrow(joined, run, "a bigint, b bigint")


def _tile(table: pa.Table, threshold: float, k: int) -> pa.Table:
    """Pairs of labels that some pair of texts of the tile links."""
    label, side = (np.asarray(table.column(c).combine_chunks()) for c in ("label", "side"))
    sets = _sets(table.column("text").combine_chunks(), k)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), size)
    known, of, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often > 1)  # a shingle of one text alone is in no intersection
    column = np.full(len(known), -1)
    column[shared] = np.arange(len(shared))
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, len(shared), 4096):
        on = (column[of] >= low) & (column[of] < low + 4096)
        m = np.zeros((len(sets), min(4096, len(shared) - low)), np.float32)
        m[owner[on], column[of][on] - low] = 1
        both += m @ m.T
    i, j = np.nonzero(both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6)
    on = (label[i] < label[j]) & (side[i] + side[j] == 0)
    found = np.unique(np.stack([label[i[on]], label[j[on]]], axis=1), axis=0)
    return pa.table({"a": pa.array(found[:, 0].copy(), pa.int64()), "b": pa.array(found[:, 1].copy(), pa.int64())})


def classes(units: DataFrame, threshold: float = THRESHOLD, bands: int | None = None, rows: int | None = None, k: int = words.SHINGLE) -> DataFrame:
    """(uid, label) for every unit that is linked with another or a copy of one: the smallest uid of its class.

    ``units``: (uid long, text). Units link where the Jaccard similarity of their sets of ``k``-word shingles is at least
    the threshold; units without a word link with nothing. A class is what links connect. Rows of one uid are one unit: where
    their texts differ, each finds copies and candidates, and similarity is that of the text that sorts first.
    """
    if bands is None or rows is None:
        bands, rows = tune(threshold)
    units = units.where("uid is not null")
    marks = written(signed(units, bands, rows, k), "signatures")
    heads = written(marks.groupBy("f1", "f2").agg(F.min("uid").alias("uid"), F.max("uid").alias("last"), F.first("bands").alias("bands")), "texts", release=True)
    inside = heads.select("uid", F.explode("bands").alias("key"))
    # joins are of plain tables, so that a bucket of very many texts can be split
    shared = written(inside.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets-shared", release=True)
    members = written(inside.join(shared, "key"), "buckets", release=True)

    worth = members.groupBy("uid").agg(F.sum(F.log2("n")).alias("worth"))
    centres = members.join(worth, "uid").groupBy("key").agg((-F.max(F.struct("worth", (-F.col("uid")).alias("u")))["u"]).alias("centre"))
    centres = written(centres, "centres", release=True)
    pairs = members.join(centres, "key").where("uid <> centre").select(F.col("uid").alias("a"), F.col("centre").alias("b")).distinct()
    pairs = written(pairs, "pairs")
    wanted = members.select("uid").distinct()
    # a merge join at every size: the wanted ids grow with the texts, so they are never broadcast
    texts = written(units.join(wanted.hint("merge"), "uid", "left_semi").groupBy("uid").agg(F.min("text").alias("text")), "texts-wanted", release=True)
    links = written(verified(pairs, texts, threshold, k), "links", release=True)
    label = components(links).withColumnRenamed("node", "uid")

    # what is left: buckets of three texts or more with more than one class; equal buckets once
    named = members.join(label, "uid", "left").select("key", "uid", F.coalesce("label", "uid").alias("label"))
    mixed = named.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("l1"), F.max("label").alias("l2"), F.sum(F.xxhash64("uid").cast("decimal(20,0)")).alias("s"))
    mixed = mixed.where("n > 2 and l1 < l2").groupBy("n", "s").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    left = written(named.join(mixed, "key"), "mixed-buckets")
    own = F.pmod(F.xxhash64("uid", "key"), F.col("blocks")).cast("int")
    tiles = left.withColumn("p", own).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("p") == F.col("q"), 0).when(F.col("p") < F.col("q"), -1).otherwise(1)
    tiles = tiles.select("key", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), side.alias("side"), "label", "uid").join(texts, "uid")
    more = tiles.groupBy("key", "p", "q").applyInArrow(lambda t: _tile(t, threshold, k), "a bigint, b bigint")
    more = written(more, "links-left")
    if not more.isEmpty():
        label = components(links.unionByName(more)).withColumnRenamed("node", "uid")
    of_head = heads.join(label, "uid", "left").where("label is not null or last > uid").select("f1", "f2", F.coalesce("label", "uid").alias("label"))
    return marks.select("uid", "f1", "f2").join(of_head, ["f1", "f2"]).select("uid", "label")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``class_id`` (the smallest key of the class) and ``kept`` (whether the row's key is that).

    Texts link as :func:`classes` says. A text that is null or has no word, and a row without a key, is a class of its own.
    Rows with one key are one document, also where their texts differ (see :func:`classes`): all of them are kept or none.
    Columns of these names are replaced. An empty table gives an empty table.
    """
    docs = docs.drop("class_id", "kept")
    found = classes(docs.select(F.col(key).alias("uid"), F.col(text).alias("text")), threshold)
    found = found.groupBy("uid").agg(F.min("label").alias("class_id")).withColumnRenamed("uid", "__uid")
    joined = docs.join(found.hint("merge"), F.col(f"`{key}`") == F.col("__uid"), "left").drop("__uid")
    joined = joined.withColumn("class_id", F.coalesce(F.col("class_id"), F.col(f"`{key}`")))
    return joined.withColumn("kept", F.coalesce(F.col("class_id") == F.col(f"`{key}`"), F.lit(True)))
