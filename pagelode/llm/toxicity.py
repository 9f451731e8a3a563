"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: its words in lower case and their leading letters. The machine gives a text a bias,
a weight for each term and, for each pair of terms, the product of their factors. So pairs that matter only together (an
insult and the mention of a group) get a weight of their own, which sums of term weights can't give.

The fit reads a bounded sample of labelled rows (``ROWS_PER_CLASS`` for each class); scoring reads whole texts of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import words
from .langid import Runs
from .runtime import map_arrow, unit_hash

BITS = 20
FACTORS = 6
ROWS_PER_CLASS = 4000
#: Penalty on squared weights, the deviation (in standard errors) of a term from which it holds mostly as it is, and the
#: penalty on squared factors for each term of their texts.
PENALTY, TELLING, PAIRS = 0.03, 8.0, 1.0
STEPS, RATE = 100, 0.1
STEM = 5
CUT = 0.7
SLICE = 1 << 20


@dataclass
class Machine:
    """Bias, slot of each hashed term (-1: not in use), and weights and factors by slot. All of fixed size."""

    bias: float
    slot: np.ndarray
    weight: np.ndarray
    factors: np.ndarray


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed term) of each distinct term of each text."""
    runs = Runs(texts)
    if not len(runs.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = runs.end - runs.start
    h = np.zeros(len(size), np.uint64)
    value = words.mix(runs.cp.astype(np.uint64) + np.uint64(11))
    stems = np.zeros(len(size), np.uint64)
    top = int(size.max())
    live = np.arange(len(size))
    for k in range(top):
        live = live[size[live] > k]
        h[live] = words.mix(h[live] * np.uint64(words.BASE) + value[runs.start[live] + k])
        if k == STEM - 1:
            stems[live] = h[live] ^ np.uint64(0x5555)
    bits = np.uint64(64 - BITS)
    row = np.repeat(np.arange(len(texts)), np.diff(runs.first))
    whole = (h >> bits).astype(np.int64)[runs.which]
    stem = (stems >> bits).astype(np.int64)[runs.which]
    long = (size > STEM)[runs.which]
    key = np.unique(np.concatenate([row << BITS | whole, row[long] << BITS | stem[long]]))
    return key >> BITS, key & ((1 << BITS) - 1)


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(machine: Machine, rows: int, row: np.ndarray, slot: np.ndarray) -> np.ndarray:
    z = np.full(rows, machine.bias) + np.bincount(row, weights=machine.weight[slot], minlength=rows)
    for f in range(machine.factors.shape[1]):
        v = machine.factors[slot, f]
        z += 0.5 * (np.bincount(row, weights=v, minlength=rows) ** 2 - np.bincount(row, weights=v * v, minlength=rows))
    return z


def train(row: np.ndarray, term: np.ndarray, label: np.ndarray, seed: int = 4) -> Machine:
    """Fit by Adam over all rows on the logistic loss and the penalties. ``row`` ascends. Every term seen gets a slot."""
    n = len(label)
    slots = np.full(1 << BITS, -1, np.int32)
    share = float(label.mean()) if n else 0.0
    if not n or share in (0.0, 1.0):
        return Machine(4.0 if share == 1.0 else -4.0, slots, np.zeros(0), np.zeros((0, FACTORS)))
    used = np.unique(term)
    slots[used] = np.arange(len(used), dtype=np.int32)
    slot = slots[term].astype(np.int64)
    by_slot = np.argsort(slot, kind="stable")
    of = row[by_slot]
    filled, starts = np.unique(row, return_index=True)
    begins = np.flatnonzero(np.concatenate([[True], np.diff(slot[by_slot]) > 0]))
    size = np.bincount(row, minlength=n)
    # a weight is held back the more, the less its term tells by itself; none is left out
    docs, bad = np.bincount(slot, minlength=len(used)), np.bincount(slot, weights=label[row], minlength=len(used))
    z = np.abs(bad - docs * share) / np.sqrt(docs * share * (1 - share))
    firm = PENALTY * (1 + np.minimum(TELLING / np.maximum(z, 0.1), 10.0) ** 4)
    # terms of long texts meet many others, so their factors are held back as much
    hold = PAIRS * np.maximum(1.0, np.add.reduceat(size[of].astype(float), begins) / np.diff(np.append(begins, len(of))))[:, None]
    rng = np.random.Generator(np.random.PCG64(seed))
    params = [np.array([np.log(share / (1 - share))]), np.zeros(len(used)), rng.normal(0, 0.02, (len(used), FACTORS)).astype(np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, STEPS + 1):
        bias, weight, factors = params
        total = np.zeros((n, FACTORS), np.float32)
        total[filled] = np.add.reduceat(factors[slot], starts)
        zed = bias[0] + np.bincount(row, weights=(weight - 0.5 * (factors**2).sum(1))[slot], minlength=n) + 0.5 * (total**2).sum(1)
        off = _chance(zed) - label
        pull = np.add.reduceat(off[of], begins)
        met = np.add.reduceat((off[:, None] * total).astype(np.float32)[of], begins)
        grads = [np.array([off.sum()]), pull + firm * weight, (met - pull[:, None] * factors + hold * factors).astype(np.float32)]
        rate = RATE * min(1.0, 2.0 * (1 - step / (STEPS + 1))) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        for p, g, (m1, m2) in zip(params, grads, moments, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p -= (rate * m1 / (np.sqrt(m2) + 1e-8)).astype(p.dtype)
    bias, weight, factors = params
    return Machine(float(bias[0]), slots, weight.astype(np.float32), factors)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", rows_per_class: int = ROWS_PER_CLASS, seed: int = 4) -> Machine:
    """A machine from the rows of ``docs`` that ``labels`` marks 0 or 1; other labels and rows without a text are left out.

    About ``rows_per_class`` rows of each class are taken by a hash of the key; the bias makes up for the rates. Without rows
    of both classes every text gets the same score.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    counts = dict(marks.groupBy("y").count().collect())
    if not counts:
        return Machine(-4.0, np.full(1 << BITS, -1, np.int32), np.zeros(0), np.zeros((0, FACTORS)))
    rate = F.coalesce(*[F.when(F.col("y") == y, F.lit(min(1.0, rows_per_class / n))) for y, n in counts.items()])
    chosen = marks.where(unit_hash("k", seed=seed) < rate)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(chosen), "k").select("y", "t")  # bounded by the sample

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            row, term = terms(texts)
            first = np.searchsorted(row, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(term, pa.int32()))], ["y", "terms"])

    sample = map_arrow(rows, hashed, "y int, terms array<int>").toArrow().combine_chunks()
    lists = sample.column("terms").combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.int32()))
    size = np.asarray(lists.value_lengths())
    term = np.asarray(lists.flatten()).astype(np.int64)
    order = np.lexsort([[int(x) for x in size], _digest(term, size)]) if len(size) else np.zeros(0, int)  # the same order however rows arrive
    row = np.repeat(np.arange(len(size)), size)
    rank = np.empty(len(size), int)
    rank[order] = np.arange(len(size))
    again = np.argsort(rank[row], kind="stable")
    y = np.asarray(sample.column("y").combine_chunks()).astype(float)[order] if len(size) else np.zeros(0)
    machine = train(rank[row][again], term[again], y, seed)
    if len(y) and 0.0 < y.mean() < 1.0:  # so far the bias is that of the sample
        machine.bias += np.log(min(1.0, rows_per_class / counts[0]) / min(1.0, rows_per_class / counts[1]))
    return machine


def _digest(term: np.ndarray, size: np.ndarray) -> np.ndarray:
    if not len(size):
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(term.astype(np.uint64)))])
    at = np.concatenate([[0], np.cumsum(size)])
    return total[at[1:]] - total[at[:-1]]


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``score`` (0 to 1) and ``predicted`` (1 from ``CUT`` on).

    A null or empty text, or one without a term that the fit knows, gets the score of the bias alone. Rows, repeated ones
    too, stay; columns of these two names are replaced.
    """
    added = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted", text)]
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # 2 ** BITS slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column, chances = batch.column(text), [np.zeros(0)]
            for i, j in words.slices(column, SLICE):
                texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
                row, term = terms(texts)
                slot = m.slot[term]
                on = slot >= 0
                chances.append(_chance(_sums(m, len(texts), row[on], slot[on])))
            p = np.concatenate(chances)
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(p), pa.array((p >= CUT).astype(np.int32))], [f.name for f in kept + added])

    return map_arrow(docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text)), run, StructType(kept + added))
