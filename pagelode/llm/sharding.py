"""A uniform shuffle of rows into shards of exact sizes by a hypergeometric communication matrix.

Rows stand in source partitions that depend only on their content, so a lost task is repeated with the same outcome. How
many rows of a source partition go to each shard is drawn exactly (multivariate hypergeometric); which ones follows from a
seeded order within the partition; after the exchange a second seeded order within the shard gives the slots. Both orders
are cut into ranges of the hash, so no task holds more than about ``RANGE_ROWS`` rows.
"""

from __future__ import annotations

from math import lgamma, log, pi

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 50_000
MOST_SOURCES = 20_000


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that are at most one apart, larger ones first."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def communication_matrix(sources: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Counts (source, shard) with the given margins, drawn as a uniform shuffle would make them."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left = np.array(shards, np.int64)
    out = np.zeros((len(sources), len(shards)), np.int64)
    for i, n in enumerate(sources):
        rest, todo = int(left.sum()), int(n)
        for j in range(len(shards)):  # one shard after another, each by a plain hypergeometric draw
            others = rest - int(left[j])
            got = todo if others == 0 else int(_hypergeometric(rng, int(left[j]), others, todo))
            out[i, j] = got
            rest, todo = others, todo - got
        left -= out[i]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Good ones among a sample without replacement, of any size.

    Beyond what numpy draws: of two binomial numbers with one chance, the first is hypergeometric given their sum. So the
    first is drawn (of the smaller side), and taken with the second's chance to make up the sum, as a share of its greatest
    chance; seven draws in ten are taken, or more.
    """
    if sample == 0 or good == 0:
        return 0
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, sample))
    if good > bad:
        return sample - _hypergeometric(rng, bad, good, sample)
    if 2 * sample > good + bad:
        return good - _hypergeometric(rng, good, bad, good + bad - sample)
    p = sample / (good + bad)
    most = _log_binomial(int((bad + 1) * p), bad, p)
    while True:
        x = int(rng.binomial(good, p))
        if 0 <= sample - x <= bad and np.log(rng.random()) <= _log_binomial(sample - x, bad, p) - most:
            return x


def _log_binomial(x: int, n: int, p: float) -> float:
    """Logarithm of a binomial chance, without the loss of digits that gamma functions of large numbers have."""
    if x in (0, n):
        return n * (np.log1p(-p) if x == 0 else np.log(p))
    rest = lambda k: (1 / 12 - (1 / 360 - 1 / 1260 / k**2) / k**2) / k if k > 15 else lgamma(k + 1) - (k + 0.5) * log(k) + k - 0.5 * log(2 * pi)  # noqa: E731  # Stirling's
    return rest(n) - rest(x) - rest(n - x) - _away(x, n * p) - _away(n - x, n * (1 - p)) + 0.5 * log(n / (2 * pi * x * (n - x)))


def _away(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, by its series where both are close."""
    if abs(x - mean) > 0.1 * (x + mean):
        return x * log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, term, k = (x - mean) * v, 2 * x * v, 3
    while True:
        term *= v * v
        after = total + term / k
        if after == total:
            return total
        total, k = after, k + 2


def shard(df: DataFrame, shards: int, seed: int = 0, sources: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (0 to the shard's size - 1, no gaps).

    Every row goes to exactly one place, so repeated rows get places of their own, and all assignments of rows to places
    are equally likely up to the quality of a 64-bit hash. ``keys``: the columns that a row's order is hashed from (all
    by default); rows that agree in them all are interchangeable. Nulls and empty texts are ordinary values. An empty
    table gives an empty table. Columns named shard or slot are replaced. ``sources`` is the number of source partitions,
    by default one for each ``RANGE_ROWS`` rows, at most ``MOST_SOURCES``.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    df = df.drop("shard", "slot")
    columns = [F.col(f"`{c}`") for c in (keys or df.columns)]
    rows_h = F.xxhash64(F.lit(seed), *columns)
    total = None
    if sources is None:
        total = df.count()
        sources = max(1, min(MOST_SOURCES, -(-total // RANGE_ROWS)))
    marked = df.withColumn("__source", F.pmod(rows_h, F.lit(sources)).cast("int"))
    found = dict(marked.groupBy("__source").count().collect())  # one number a source partition
    counts = [found.get(i, 0) for i in range(sources)]
    matrix = communication_matrix(counts, shard_sizes(sum(counts), shards), seed)
    upto = matrix.cumsum(axis=1)

    # within a source: an order by a second hash; the first upto[i][0] rows go to shard 0, and so on
    order = F.xxhash64(F.lit(seed + 1), *columns)
    local = Window.partitionBy("__source").orderBy("__order", *[c.asc_nulls_first() for c in columns])
    limits = df.sparkSession.createDataFrame([(i, upto[i].tolist()) for i in range(sources)], "__source int, __upto array<bigint>")
    placed = (
        marked.withColumn("__order", order)
        .withColumn("__rank", F.row_number().over(local))
        .join(F.broadcast(limits), "__source")  # sources x shards numbers
        .withColumn("shard", F.size(F.filter("__upto", lambda u: u < F.col("__rank"))))
    )

    # within a shard: a third hash, cut into ranges that are counted first
    ranges = max(1, -(-sum(counts) // (shards * RANGE_ROWS)))
    third = F.xxhash64(F.lit(seed + 2), *columns)
    placed = placed.withColumn("__order", third).withColumn("__range", _range_of(third, ranges))
    sizes = placed.groupBy("shard", "__range").count()
    before = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    last = Window.partitionBy("shard", "__range").orderBy("__order", *[c.asc_nulls_first() for c in columns])
    ranked = placed.withColumn("__at", F.row_number().over(last))
    return ranked.join(F.broadcast(starts) if ranges * shards <= 100_000 else starts, ["shard", "__range"]).select(
        *[F.col(f"`{c}`") for c in df.columns], F.col("shard").cast("int").alias("shard"), (F.col("__start") + F.col("__at") - 1).cast("long").alias("slot")
    )


def _range_of(h: Column, ranges: int) -> Column:
    return F.floor(F.shiftrightunsigned(h, 32).cast("double") * (ranges / 2.0**32)).cast("int")
