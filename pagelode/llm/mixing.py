"""Mixing of sources to target weights by hierarchical budgets.

Leaves are (domain, language, source). A budget of tokens goes from the whole to domains, to languages, to sources, at each
level by weight; a child never gets more than its subtree can supply in ``epochs`` epochs, and what it can't take goes to its
siblings by their weights. Only where all siblings are full is a subtree given less than its share, and so the shortage goes
to the siblings of its parent. Each leaf then gives whole epochs and a prefix of one more, in an order seeded for the epoch.

Budgets are made by windows over tables of nodes, so there can be any number of leaves. Prefixes are found without sorting a
leaf: the order's hash is cut into ranges, tokens are summed for each range, and only the range in which the budget ends is
sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import looked_up, unit_hash, written

RANGE_ROWS = 512
LEVELS = ("domain", "lang", "source")
KEYS = [f"__{level}" for level in LEVELS]


def _shared(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``nodes`` (weight, supply, amount: that of the parent) with ``got``: shares of the amount by weight, none over its
    supply, where what is over goes to the others by weight.

    In order of supply for each unit of weight, a node is full as long as an even rate for it and all after it would exceed
    its supply; the others get the rate that is left for them, which is the largest of theirs.
    """
    ratio = (F.col("supply") / F.col("weight")).alias("ratio")
    order = Window.partitionBy(*parent).orderBy("ratio", *KEYS)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rate = (F.col("amount") - F.coalesce(F.sum("supply").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    ranked = nodes.select("*", ratio).withColumn("rate", rate).withColumn("full", F.col("rate") >= F.col("ratio"))
    common = F.max(F.when(~F.col("full"), F.col("rate"))).over(Window.partitionBy(*parent))
    return ranked.withColumn("got", F.when(F.col("full"), F.col("supply")).otherwise(F.greatest(F.lit(0.0), F.col("weight") * common))).drop("ratio", "rate", "full")


def budgets(leaves: DataFrame, total: float, weights: dict[tuple, float], default: float = 1.0) -> DataFrame:
    """(__domain, __lang, __source, goal) for every leaf. ``leaves``: the three keys and what each can ``supply``.

    ``weights``: by path (a domain, a domain and language, a leaf); others weigh ``default``. A node with a weight of nought
    or less, or below one, gets nothing.
    """
    spark = leaves.sparkSession
    at = leaves.select(*KEYS, F.col("supply").cast("double").alias("supply"))
    for depth in (1, 2, 3):
        named = [(*p, *[None] * (3 - depth), float(w)) for p, w in weights.items() if len(p) == depth]
        given = spark.createDataFrame(named, ", ".join(f"w{i} string" for i in range(3)) + ", w double")  # as many as the caller names
        same = F.lit(True)
        for i in range(depth):
            same &= F.col(KEYS[i]).eqNullSafe(F.col(f"w{i}"))
        at = at.join(F.broadcast(given), same, "left").withColumn(f"weight{depth}", F.coalesce("w", F.lit(float(default)))).drop("w0", "w1", "w2", "w")
    at = at.withColumn("open", (F.least("weight1", "weight2", "weight3") > 0) & (F.col("supply") > 0))
    amount: DataFrame | None = None
    for depth in (1, 2, 3):
        keys, up = KEYS[:depth], KEYS[: depth - 1]
        nodes = at.where("open").groupBy(*keys).agg(F.sum("supply").alias("supply"), F.first(f"weight{depth}").alias("weight"))
        for key in KEYS[depth:]:
            nodes = nodes.withColumn(key, F.lit(""))
        if amount is None:
            nodes, parent = nodes.withColumn("amount", F.lit(float(total))), [F.lit(0)]
        else:
            same = F.lit(True)
            for key in up:
                same &= F.col(key).eqNullSafe(F.col("up" + key))
            nodes, parent = nodes.join(amount, same).drop(*["up" + key for key in up]), up
        shared = _shared(nodes, parent)
        amount = shared.select(*[F.col(key).alias("up" + key) for key in keys], F.col("got").alias("amount"))
    same = F.lit(True)
    for key in KEYS:
        same &= F.col(key).eqNullSafe(F.col("up" + key))
    goal = F.when(F.col("amount").isNotNull(), F.floor(F.least("amount", "supply") + 1e-6)).otherwise(0).cast("long")
    return at.join(amount, same, "left").select(*KEYS, goal.alias("goal"))


def mix(docs: DataFrame, domain: Column, weights: dict[tuple, float], share: float = 1.0, tokens: Column | None = None, text: str = "text",
        lang: str = "lang", source: str = "source", key: str = "doc_id", epochs: int = 1, seed: int = 10, default: float = 1.0) -> DataFrame:
    """The rows chosen, with ``epoch`` (1, 2, ...): a row comes once for each epoch that takes it.

    The budget is ``share`` of all tokens (words by default; a null or empty text has none and takes none). A prefix ends
    before the first row that would exceed the leaf's budget. Null domains, languages and sources are keys of their own.
    Rows with one key and text are ordered alike and each counts. An empty table gives an empty table; a column named
    epoch is replaced.
    """
    docs = docs.drop("epoch")
    if tokens is None:
        trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))
        tokens = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[ \\t-\\r]+")))
    path = [domain.cast("string"), F.col(lang).cast("string"), F.col(source).cast("string")]
    marked = docs.withColumns(dict(zip(KEYS, path, strict=True)) | {"__tokens": tokens.cast("long")})
    leaves = marked.groupBy(*KEYS).agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("rows"))
    leaves = written(leaves, "mix-leaves")
    whole = leaves.agg(F.sum("tokens")).first()[0] or 0  # one number
    goals = budgets(leaves.withColumn("supply", F.col("tokens") * epochs), share * whole, weights, default)
    same = F.lit(True)
    for k in KEYS:
        same &= F.col(k).eqNullSafe(F.col("g" + k))
    plan = leaves.join(goals.select(*[F.col(k).alias("g" + k) for k in KEYS], "goal"), same)
    some = F.col("tokens") > 0
    plan = plan.select(
        *[F.col(k).alias("p" + k) for k in KEYS], F.when(some, F.floor(F.col("goal") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("int").alias("__whole"),
        F.when(some, F.col("goal") % F.greatest("tokens", F.lit(1))).otherwise(0).cast("long").alias("__rest"), F.ceil(F.col("rows") / RANGE_ROWS).cast("int").alias("__ranges"),
    )
    joined = looked_up(marked, written(plan, "mix-plan"), {k: "p" + k for k in KEYS})
    order = unit_hash(F.col(key).cast("string"), F.col(text), F.col("__whole"), seed=seed)
    joined = joined.withColumn("__u", order).withColumn("__range", F.floor(F.col("__u") * F.col("__ranges")).cast("int"))
    sums = joined.groupBy(*KEYS, "__rest", "__range").agg(F.sum("__tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy(*KEYS).orderBy("__range"))
    ends = sums.withColumn("upto", upto).where("upto > __rest")
    ends = ends.groupBy(*KEYS).agg(F.min(F.struct("__range", (F.col("upto") - F.col("t")).alias("before"))).alias("end"))
    ends = ends.select(*[F.col(k).alias("e" + k) for k in KEYS], F.col("end.__range").alias("__end"), F.col("end.before").alias("__before"))
    placed = looked_up(joined, written(ends, "mix-ends"), {k: "e" + k for k in KEYS})
    # a leaf without an end has no tokens at all
    inner = placed.where(F.col("__end").isNull() | (F.col("__range") != F.col("__end")))
    inner = inner.withColumn("__taken", F.coalesce(F.col("__range") < F.col("__end"), F.lit(False)))
    edge = placed.where(F.col("__range") == F.col("__end"))
    so_far = F.sum("__tokens").over(Window.partitionBy(*KEYS).orderBy("__u", key, text).rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("__taken", F.col("__before") + so_far <= F.col("__rest"))
    chosen = inner.unionByName(edge).withColumn("__times", F.col("__whole") + F.col("__taken").cast("int")).where("__times > 0")
    return chosen.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("epoch"))

