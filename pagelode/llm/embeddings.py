"""Near-duplicate vectors by PCA-ordered tiled comparison.

Unit vectors are turned onto their principal axes, so that the leading dimensions hold most of every product. Vectors with a
cosine of ``threshold`` differ by at most sqrt(2 - 2 threshold) on any axis. So for labels of more than ``GRID_ROWS`` vectors,
cells of that width on the ``CELL_AXES`` leading axes come first, and a cell of more than ``BLOCK`` vectors is parted into
such cells on the ``PART_AXES`` axes after them; only neighbouring ones make tiles, which are pairs of blocks of about
``BLOCK`` vectors. A vector is copied once for each block near it on all these axes, not for each block of its label. In a
tile, products are accumulated ``STEP`` dimensions at a time; what is still to come is at most the product of the two suffix
norms, and pairs that can't reach the threshold are dropped. The pairs left are computed in double precision from the vectors
as given.

A tile returns the number of links of each vector and, for each vector with links, the smallest vector that its links reach
within the tile. So its output grows with its vectors, not with their pairs. Equal vectors are compared once for all copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import map_arrow, written

THRESHOLD = 0.93
BLOCK = 2048
GRID_ROWS = 16 * BLOCK
CELL_AXES, PART_AXES = 4, 3
STEP = 16
SLACK = 1e-9


def _matrices(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, matrix) of a column of lists without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths().fill_null(0))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    at = np.cumsum(size) - size
    return [(int(d), rows := np.flatnonzero(size == d), flat[at[rows][:, None] + np.arange(d)]) for d in np.unique(size)]


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _sound(vectors: DataFrame, node: str, vector: str, label: str) -> DataFrame:
    """Rows that can link: a label, an id, and a vector that isn't zero and has finite components only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col(vector).cast("array<double>")
    ok = F.col(node).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    return vectors.where(ok).select(F.col(node).alias("node"), F.col(label).alias("label"), v.alias("vector"))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes (columns, strongest first) by dimension, from second moments summed over all unit vectors."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _matrices(batch.column(0)):
                u = _units(x)
                sums[d] = sums.get(d, 0) + u.T @ u
        for d, m in sums.items():
            i, j = np.indices((d, d))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d), pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(m.ravel())], ["d", "i", "j", "v"])

    cells = map_arrow(vectors.select("vector"), part, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).toPandas()  # dimensions squared
    found: dict[int, np.ndarray] = {}
    for d, g in cells.groupby("d"):
        m = np.zeros((int(d), int(d)))
        m[g.i, g.j] = g.v
        values, axes = np.linalg.eigh((m + m.T) / 2)
        found[int(d)] = np.ascontiguousarray(axes[:, np.argsort(-values)])
    return found


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches by the pairs."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, least)
        while (after := new[new]).tolist() != new.tolist():
            new = after
        if np.array_equal(new, label):
            return label
        label = new


def _compared(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with a cosine of at least the threshold; of a block with itself each pair once."""
    d = x.shape[1]
    turned_x, turned_y = _units(x) @ axes, _units(y) @ axes
    rest_x, rest_y = (np.sqrt(np.cumsum((t**2)[:, ::-1], axis=1)[:, ::-1]) for t in (turned_x, turned_y))
    norm_x, norm_y = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (x, y))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for top in range(0, len(x), 256):
        rows = slice(top, top + 256)
        done = min(STEP, d)
        reach = turned_x[rows, :done] @ turned_y[:, :done].T
        bound = np.outer(rest_x[rows, done], rest_y[:, done]) if done < d else 0.0
        i, j = np.nonzero(reach + bound >= threshold - SLACK)
        value = reach[i, j]
        i = i + top
        if same:
            on = i < j
            i, j, value = i[on], j[on], value[on]
        while done < d and len(i):
            upto = min(done + STEP, d)
            value = value + np.einsum("ij,ij->i", turned_x[i, done:upto], turned_y[j, done:upto])
            done = upto
            on = value + (rest_x[i, done] * rest_y[j, done] if done < d else 0.0) >= threshold - SLACK
            i, j, value = i[on], j[on], value[on]
        for k in range(0, len(i), 1 << 15):
            p, q = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            sure = np.einsum("ij,ij->i", x[p], y[q]) / (norm_x[p] * norm_y[q]) >= threshold
            found.append((p[sure], q[sure]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _tile(table: pa.Table, axes: dict[int, np.ndarray], threshold: float) -> pa.Table:
    node, copies, side = (np.asarray(table.column(c).combine_chunks()) for c in ("node", "copies", "side"))
    _, _, x = _matrices(table.column("vector"))[0]  # a tile has one dimension
    same = bool((side == 0).any())
    left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    i, j = _compared(x[left], x[right], axes[x.shape[1]], threshold, same)
    i, j = left[i], right[j]
    n = np.bincount(i, weights=copies[j], minlength=len(node)) + np.bincount(j, weights=copies[i], minlength=len(node))
    least = node.copy()
    if len(i):
        label = _labels(len(node), i, j)
        lowest = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(lowest, label, node)
        least = lowest[label]
    on = n > 0
    return pa.table({"node": node[on], "least": least[on], "n": n[on].astype(np.int64)})


def link(vectors: DataFrame, node: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(node, n_links, component_id, kept) for every row of ``vectors``.

    Vectors link where labels are equal and the cosine is at least the threshold. Vectors that are null, empty, zero or hold
    a null or a component that isn't finite link with nothing, nor do rows without a label or an id, nor vectors of unequal
    length. Each row counts as a vector of its own, so equal rows link with one another. A row without links is its own
    component. An empty table gives an empty table.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    sound = _sound(vectors, node, vector, label)
    distinct = written(sound.groupBy("label", "vector").agg(F.min("node").alias("node"), F.count("*").alias("copies")), "vectors")
    axes = principal_axes(distinct)
    shared = vectors.sparkSession.sparkContext.broadcast(axes)  # dimensions squared
    width = float(np.sqrt(2 - 2 * threshold)) + 1e-9

    axes_used = CELL_AXES + PART_AXES

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros((batch.num_rows, axes_used), np.int32)
            for d, rows, x in _matrices(batch.column("vector")):
                turned = _units(x) @ shared.value[d][:, :axes_used]
                cells[rows, : turned.shape[1]] = np.floor(turned / width)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * axes_used), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "at"])

    placed = map_arrow(distinct, leading, "label " + dict(distinct.dtypes)["label"] + ", vector array<double>, node bigint, copies bigint, at array<int>")
    placed = written(placed.withColumn("d", F.size("vector")), "vectors-placed")
    sizes = placed.groupBy("label", "d").agg((F.count("*") > GRID_ROWS).alias("grid"))
    cell = F.when(F.col("grid"), F.slice("at", 1, CELL_AXES)).otherwise(F.array_repeat(F.lit(0), CELL_AXES)).alias("cell")
    placed = placed.join(sizes, ["label", "d"]).select("label", "d", "vector", "node", "copies", cell, F.slice("at", CELL_AXES + 1, PART_AXES).alias("part"), "grid")
    full = placed.groupBy("label", "d", "cell").agg((F.first("grid") & (F.count("*") > BLOCK)).alias("parted"))
    whole = F.array_repeat(F.lit(0), PART_AXES)
    placed = placed.join(full, ["label", "d", "cell"]).withColumn("part", F.when(F.col("parted"), F.col("part")).otherwise(whole)).drop("grid")
    placed = written(placed, "vectors-dealt")
    cells = placed.groupBy("label", "d", "cell", "part", "parted").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cells = written(cells, "vector-cells")

    # half of the neighbours of each cell, of those the parts that are neighbours too, and the pairs of their blocks
    steps = [o for o in product((-1, 0, 1), repeat=CELL_AXES) if o >= (0,) * CELL_AXES]
    beside = F.explode(F.array(*[F.array(*map(F.lit, o)) for o in steps])).alias("step")
    others = cells.select("label", "d", F.col("cell").alias("cell2"), F.col("part").alias("part2"), F.col("parted").alias("parted2"), F.col("blocks").alias("blocks2"))
    tiles = cells.select("*", beside).withColumn("cell2", F.zip_with("cell", "step", lambda x, y: x + y)).join(others, ["label", "d", "cell2"])
    near = F.forall(F.zip_with("part", "part2", lambda x, y: F.abs(x - y)), lambda x: x <= 1) | ~F.col("parted") | ~F.col("parted2")
    own = F.col("cell") == F.col("cell2")
    tiles = tiles.where(near & (~own | (F.col("part") <= F.col("part2"))))
    same = own & (F.col("part") == F.col("part2"))
    tiles = tiles.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("q", F.explode(F.sequence(F.when(same, F.col("p")).otherwise(0), F.col("blocks2") - 1)))
    tile = F.struct("label", "d", "cell", "part", "p", "cell2", "part2", "q").alias("tile")
    end = lambda cell, part, block, side: F.struct(F.col(cell).alias("cell"), F.col(part).alias("part"), F.col(block).alias("block"), F.lit(side).alias("side"))
    ends = F.explode(F.when(same & (F.col("p") == F.col("q")), F.array(end("cell", "part", "p", 0))).otherwise(F.array(end("cell", "part", "p", -1), end("cell2", "part2", "q", 1))))
    members = tiles.select("label", "d", tile, ends.alias("e")).select("label", "d", "tile", "e.*")
    keys = ["label", "d", "cell", "part"]
    blocks = placed.join(cells.drop("parted"), keys).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks", "parted")
    dealt = blocks.join(members, [*keys, "block"]).select("tile", "side", "node", "copies", "vector")
    found = written(dealt.groupBy("tile").applyInArrow(lambda t: _tile(t, shared.value, threshold), "node bigint, least bigint, n bigint"), "vector-links")

    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    labels = components(found, "node", "least").withColumnRenamed("label", "component")
    per = distinct.join(counts, "node", "left").join(labels, "node", "left")
    per = per.select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("component"))
    # equal vectors of a label have one row in ``per``
    back = sound.join(per, ["label", "vector"]).select("node", "n", "component")
    rows = vectors.select(F.col(node).alias("node")).withColumn("ok", F.lit(0))
    ids = back.groupBy("node").agg(F.max("n").alias("n"), F.min("component").alias("component"))
    return rows.join(ids, "node", "left").select(
        F.col("node").alias(node), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component_id"),
        F.coalesce(F.coalesce("component", "node") == F.col("node"), F.lit(True)).alias("kept"),
    )
