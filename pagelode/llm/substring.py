"""Removal of passages that repeat across documents, by MinHash banding of paragraphs.

Two kinds of paragraphs are signed. Lines of at least ``LEAST_WORDS`` words are near-duplicates where their sets of five-word
shingles have a Jaccard similarity of 0.8: bands of their signatures find the candidates, exact sets decide, and components
group them.

Passages also stand in the middle of lines, so every run of ``GRAM`` words is a sliding paragraph. Its signature is one MinHash
coordinate: the least hash of its shingles, which names the place where that shingle begins (its anchor). Neighbouring
paragraphs mostly share their anchor, so a text has about one for each six words. The band is the hash of the ``GRAM`` words
from the anchor on. Any ``2 * GRAM - 5`` equal words of two texts have an anchor in common, hence so has any passage of
``LEAST_WORDS`` words with at most one word changed: the recall of the bands is one, whatever the hashes. Colliding paragraphs
are compared word by word with the first document that holds them, also ``EDGE`` words to either side, and join up to exact
runs along one alignment. A passage is a run of ``LEAST_WORDS`` words, or two runs with one word changed, put in or left out
between them (edit distance one) that reach as far together.

Texts that repeat a phrase of less than ``GRAM`` words over and over have no one alignment. A stretch of ``LEAST_WORDS`` words
of that kind is known by its phrase, wherever in the phrase it begins, and repeats any other of the same phrase.

What repeats stays in the document with the smallest key and goes from the others. What is not found: a passage each of
whose anchors also stands, in other surroundings, in a document with a smaller key still, since paragraphs are compared with
the first holder alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import words
from .minhash import classes, tune
from .runtime import map_arrow, remove_written, written

LEAST_WORDS = 50
GRAM = 15
EDGE = 10
MOST_BANDS = 16
SLICE = 1 << 20
_BLANKS = b" \t\r\x0b\x0c"


def anchors(texts: pa.Array) -> tuple[words.Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, row, word, key) of the anchors of each text: ``word`` counts over all rows, ``key`` hashes GRAM words from it."""
    w = words.Words(texts)
    n, none = len(w.hash), np.zeros(0, np.int64)
    if n < GRAM:
        return w, none, none, none
    padded = np.concatenate([w.hash, np.zeros(GRAM, np.uint64)])
    value = np.zeros(n, np.uint64)
    for j in range(words.SHINGLE):
        value = value * np.uint64(words.BASE) + padded[j : n + j]
    value = words.mix(value)
    ends = np.repeat(w.first[1:], np.diff(w.first))
    at = np.flatnonzero(np.arange(n) + GRAM <= ends)  # where a sliding paragraph begins
    if not len(at):
        return w, none, none, none

    def lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(value[b] < value[a], b, a)  # the first of equal ones

    least, span = np.arange(n), 1
    size = GRAM - words.SHINGLE + 1
    while 2 * span <= size:  # least of 1, 2, 4, ... shingles
        least = lower(least, least[np.minimum(np.arange(n) + span, n - 1)])
        span *= 2
    found = np.unique(lower(least[at], least[at + size - span]))
    found = found[found + GRAM <= ends[found]]
    key = np.zeros(len(found), np.uint64)
    for j in range(GRAM):
        key = key * np.uint64(words.BASE) + w.hash[found + j]
    row = np.searchsorted(w.first, found, "right") - 1
    # Where a text repeats a phrase shorter than a gram, the gram counts once for each time that it doesn't overlap itself
    order = np.lexsort([found, key, row])
    near = (np.diff(found[order]) < GRAM) & (np.diff(key[order]) == 0)
    on = np.ones(len(found), bool)
    on[order[1:][near]] = False
    return w, row[on], found[on], words.mix(key[on]).view(np.int64)


def _sliding(own: DataFrame, full: bool) -> DataFrame:
    """(uid, key) of the anchors, or with ``full`` also the text's version and the number of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for i, j in words.slices(texts, SLICE):
                w, row, at, key = anchors(texts.slice(i, j - i))
                of = pa.array(row)
                columns = [batch.column(0).slice(i, j - i).take(of), pa.array(key)]
                if full:
                    columns += [batch.column(1).slice(i, j - i).take(of), pa.array((at - w.first[row]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "key", "version", "w"][: len(columns)])

    return map_arrow(own.select("uid", "version", "text"), run, "uid bigint, key bigint" + (", version int, w int" if full else ""))


def _runs(own: DataFrame) -> DataFrame:
    """(uid, version, earlier, shift, a, b): word ranges that a document with a smaller id holds too, as far as they go."""
    # Minima are combined before the shuffle; a paragraph of one document alone goes no further
    held = _sliding(own, False).groupBy("key").agg(F.min("uid").alias("earlier"), F.max("uid").alias("last")).where("earlier < last").drop("last")
    held = written(held, "paragraphs-held", release=True)  # a join of two plain tables, so that a key of very many rows can be split
    met = written(_sliding(own, True).join(held.hint("merge"), "key"), "paragraphs-met", release=True)
    first = met.where("uid = earlier").groupBy("key").agg(F.min(F.struct("version", "w")).alias("h")).select("key", F.col("h.version").alias("held_as"), F.col("h.w").alias("w_held"))
    first = written(first, "paragraphs-first", release=True)
    pairs = met.where("earlier < uid").join(first.hint("merge"), "key")
    parts = pairs.select("uid", "version", "earlier", "held_as", (F.col("w") - F.col("w_held")).alias("shift"), F.col("w").alias("a"), (F.col("w") + GRAM).alias("b"))
    grams = _joined(parts, ["uid", "version", "earlier", "held_as", "shift"])

    # runs that with the words around them, or with the next run, may reach LEAST_WORDS
    by = Window.partitionBy("uid", "version", "earlier").orderBy("a", "b", "shift")
    near = lambda f: F.coalesce(F.abs(f("a") - F.col("a")), F.lit(1 << 30)) <= LEAST_WORDS
    around = near(lambda c: F.lag(c).over(by)) | near(lambda c: F.lead(c).over(by))
    grams = grams.withColumn("near", around).where(F.col("near") | (F.col("b") - F.col("a") >= LEAST_WORDS - 2 * EDGE)).drop("near")
    grams = written(grams, "runs-met", release=True)
    return _widened(grams, own)


def _widened(grams: DataFrame, own: DataFrame) -> DataFrame:
    """Runs with the equal words before and after them, up to EDGE on either side."""
    ends = F.explode(F.array(
        F.struct(F.col("uid").alias("doc"), F.col("version").alias("as"), F.col("a").alias("at")), F.struct(F.col("uid").alias("doc"), F.col("version").alias("as"), F.col("b").alias("at")),
        F.struct(F.col("earlier").alias("doc"), F.col("held_as").alias("as"), (F.col("a") - F.col("shift")).alias("at")),
        F.struct(F.col("earlier").alias("doc"), F.col("held_as").alias("as"), (F.col("b") - F.col("shift")).alias("at")),
    ))
    # no more places than a text has words, however many documents ask for them
    asked = grams.select(ends.alias("e")).select("e.*").distinct().groupBy("doc", "as").agg(F.collect_list("at").alias("at"))
    joined = own.join(asked.hint("merge"), (F.col("uid") == F.col("doc")) & (F.col("version") == F.col("as"))).select("doc", "as", "at", "text")

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in words.slices(batch.column(3), SLICE):
                part = batch.slice(i, j - i)
                w = words.Words(part.column(3))
                lists = part.column(2)
                row = np.repeat(np.arange(j - i), np.asarray(lists.value_lengths()))
                at = np.asarray(lists.flatten()) + w.first[row]
                short = np.maximum(w.hash >> np.uint64(32), np.uint64(1)).astype(np.uint32)
                sides = []
                for places in (at[:, None] - 1 - np.arange(EDGE), at[:, None] + np.arange(EDGE)):
                    inside = (places >= w.first[row][:, None]) & (places < w.first[row + 1][:, None])
                    sides.append(np.where(inside, short[np.clip(places, 0, max(0, len(short) - 1))], np.uint32(0)).astype(np.uint32))
                of, steps = pa.array(row), pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * (4 * EDGE))
                columns = [part.column(0).take(of), part.column(1).take(of), lists.flatten(), *(pa.Array.from_buffers(pa.binary(), len(at), [None, steps, pa.py_buffer(x.tobytes())]) for x in sides)]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "as", "at", "before", "after"])

    # copies of a row ask alike and get alike
    seen = map_arrow(joined, looked, "doc bigint, as int, at int, before binary, after binary").groupBy("doc", "as", "at").agg(F.first("before").alias("before"), F.first("after").alias("after"))
    seen = written(seen, "words-around", release=True)

    def beside(rows: DataFrame, doc: str, version: str, at: Column, side: str, name: str) -> DataFrame:
        words_there = seen.select(F.col("doc").alias("__doc"), F.col("as").alias("__as"), F.col("at").alias("__at"), F.col(side).alias(name))
        same = (F.col(doc) == F.col("__doc")) & (F.col(version) == F.col("__as")) & (at == F.col("__at"))
        return rows.join(words_there.hint("merge"), same).drop("__doc", "__as", "__at")

    rows = grams
    for end, side in (("a", "before"), ("b", "after")):
        rows = beside(rows, "uid", "version", F.col(end), side, f"{side}_mine")
        rows = beside(rows, "earlier", "held_as", F.col(end) - F.col("shift"), side, f"{side}_theirs")
    rows = rows.select("uid", "version", "earlier", "shift", "a", "b", "before_mine", "before_theirs", "after_mine", "after_theirs")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, three, four = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, EDGE) for c in range(6, 10))
            in_a_row = lambda x, y: np.cumprod((x == y) & (x > 0), axis=1).sum(axis=1)
            ends = [np.asarray(batch.column(4)) - in_a_row(one, two), np.asarray(batch.column(5)) + in_a_row(three, four)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(x.astype(np.int32)) for x in ends)], ["uid", "version", "earlier", "shift", "a", "b"])

    return _joined(map_arrow(rows, compared, "uid bigint, version int, earlier bigint, shift int, a int, b int"), ["uid", "version", "earlier", "shift"])


def _joined(ranges: DataFrame, keys: list[str], *others: Column) -> DataFrame:
    """Ranges [a, b) of each key that overlap or touch, as one."""
    before = Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    marked = ranges.withColumn("__new", F.coalesce((F.col("a") > F.max("b").over(before)).cast("int"), F.lit(1)))
    numbered = marked.withColumn("__n", F.sum("__new").over(Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__n").agg(F.min("a").alias("a"), F.max("b").alias("b"), *others).drop("__n")


def _passages(runs: DataFrame) -> DataFrame:
    """(doc, version, a, b, earlier): runs of LEAST_WORDS words, and pairs of runs at an edit distance of one."""
    by = Window.partitionBy("uid", "version", "earlier").orderBy("a", "b", "shift")
    last = F.lag(F.struct("a", "b", "shift")).over(by)
    pairs = runs.withColumn("last", last)
    gap = F.col("a") - F.col("last.b")
    other = gap - F.col("shift") + F.col("last.shift")  # the gap in the earlier document
    edited = gap.between(0, 1) & other.between(0, 1) & (gap + other > 0) & (F.col("b") - F.col("last.a") >= LEAST_WORDS)
    taken = pairs.withColumn("a", F.when(F.coalesce(edited, F.lit(False)), F.col("last.a")).otherwise(F.col("a"))).where(F.col("b") - F.col("a") >= LEAST_WORDS)
    return taken.select(F.col("uid").alias("doc"), "version", "a", "b", "earlier")


def periodic(w: words.Words) -> tuple[np.ndarray, ...]:
    """(row, first word, words, key) of stretches of LEAST_WORDS words or more that repeat a phrase of less than GRAM words."""
    n, row = len(w.hash), w.row_of_word()
    taken = np.zeros(n + 1, bool)
    found: list[tuple[int, int, int]] = []
    for period in range(1, GRAM):
        if n <= period:
            break
        equal = np.zeros(n - period + 2, np.int8)
        equal[1:-1] = (w.hash[period:] == w.hash[:-period]) & (row[period:] == row[:-period])
        edge = np.flatnonzero(np.diff(equal))
        starts, ends = edge[::2], edge[1::2] + period  # words [start, end) have the period
        for a, b in zip(*(x[ends - starts >= LEAST_WORDS].tolist() for x in (starts, ends)), strict=True):
            if not taken[a:b].all():  # else a shorter period is known
                taken[a:b] = True
                found.append((a, b, period))
    at = np.array([f[0] for f in found], np.int64)
    key = np.full(len(found), np.iinfo(np.uint64).max, np.uint64)
    periods = np.array([f[2] for f in found], np.int64)
    for turn in range(GRAM):  # the least of the phrase's turns
        on = np.flatnonzero(periods > turn)
        h = np.zeros(len(on), np.uint64)
        for j in range(GRAM):
            h = h * np.uint64(words.BASE) + w.hash[at[on] + turn + j]
        key[on] = np.minimum(key[on], words.mix(h))
    rows = row[at] if len(at) else at
    return rows, at - w.first[rows], np.array([f[1] - f[0] for f in found], np.int64), key.view(np.int64)


def _lines(own: DataFrame) -> DataFrame:
    """(doc, version, w, n, text, key): lines of LEAST_WORDS words or more with their text, and periodic stretches with their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for i, j in words.slices(texts, SLICE):
                w = words.Words(texts.slice(i, j - i))
                begins = np.unique(np.concatenate([w.offsets[:-1], np.flatnonzero(w.bytes == 10) + 1]))
                words_before = np.append(np.searchsorted(w.start, begins), len(w.start))
                long = np.flatnonzero(np.diff(words_before) >= LEAST_WORDS)
                one, n = words_before[long], np.diff(words_before)[long]
                row = np.searchsorted(w.first, one, "right") - 1
                raw = w.bytes.tobytes()
                lines = [raw[a:b].decode() for a, b in zip(w.start[one].tolist(), w.end[one + n - 1].tolist(), strict=True)]
                rows, at, count, key = periodic(w)
                of = pa.array(np.concatenate([row, rows]))
                numbers = [pa.array(np.concatenate(x).astype(np.int32)) for x in ((one - w.first[row], at), (n, count))]
                last = [pa.array(lines + [None] * len(rows), pa.string()), pa.array([None] * len(row) + key.tolist(), pa.int64())]
                yield pa.RecordBatch.from_arrays([c.slice(i, j - i).take(of) for c in batch.columns[:2]] + numbers + last, ["doc", "version", "w", "n", "text", "key"])

    return map_arrow(own.select("uid", "version", "text"), run, "doc bigint, version int, w int, n int, text string, key bigint")


def _repeated_lines(own: DataFrame) -> DataFrame:
    """(doc, version, a, b, earlier) of long lines whose class has a line in a document with a smaller id, and of periodic
    stretches whose phrase such a document repeats too."""
    # numbered once and for all by being written; so ids of documents can be any 64-bit numbers
    both = written(_lines(own).withColumn("uid", F.monotonically_increasing_id()), "long-lines", release=True)
    lines, stretches = both.where("key is null"), both.where("key is not null")
    bands, rows = tune(0.8, 0.999, MOST_BANDS)
    label = written(classes(lines.select("uid", "text"), 0.8, bands, rows), "line-classes", release=True)
    place = [F.col("w").alias("a"), (F.col("w") + F.col("n")).alias("b")]
    named = lines.select("uid", "doc", "version", *place).join(label.hint("merge"), "uid")
    named = named.select(F.col("label").alias("key"), "doc", "version", "a", "b")
    found = _late(named).unionByName(_late(stretches.select("key", "doc", "version", *place)))
    found = written(found, "lines", release=True)
    remove_written(both)
    return found


def _late(named: DataFrame) -> DataFrame:
    """(doc, version, a, b, earlier) of the ranges whose key a document with a smaller id has too."""
    first = written(named.groupBy("key").agg(F.min("doc").alias("earlier")), "holders", release=True)  # so that a large class can be split
    return named.join(first.hint("merge"), "key").where("earlier < doc").select("doc", "version", "a", "b", "earlier")


def _version(text: Column) -> Column:
    return F.hash(text)


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, version, spans, earlier): for each text that repeats other documents, ranges (first word, word after the last) in
    order, apart from one another, and the ids of the documents that hold them already (the smallest for each range).

    Rows with one key count as one document, and don't repeat one another; where their texts differ, ``version`` (the
    text's hash) tells which text the ranges belong to. Null and empty texts, and rows without a key, have no passages.
    """
    own = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("uid"), _version(F.col(text)).alias("version"), F.col(text).alias("text"))
    both = _repeated_lines(own).unionByName(written(_passages(_runs(own)), "runs", release=True))
    merged = _joined(both, ["doc", "version"], F.min("earlier").alias("earlier"))
    return merged.groupBy("doc", "version").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"), F.array_sort(F.collect_set("earlier")).alias("earlier"))


def _bytes_of(texts: pa.Array, spans: list[list[dict]]) -> list[list[tuple[int, int]]]:
    """Word ranges of each text as byte ranges."""
    w = words.Words(texts)
    out = []
    for r, ranges in enumerate(spans):
        base, start = int(w.first[r]), int(w.offsets[r])
        out.append([(int(w.start[base + s["a"]]) - start, int(w.end[base + s["b"] - 1]) - start) for s in ranges])
    return out


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without byte ranges. A line of which only blanks are left goes as a whole; two blanks that meet become one."""
    raw, kept, at = text.encode(), [], 0
    for a, b in spans:
        left, right = a, b
        while left > at and raw[left - 1] in _BLANKS:
            left -= 1
        while right < len(raw) and raw[right] in _BLANKS:
            right += 1
        opens = left == 0 or raw[left - 1] == 10 or (left == at and (not kept or kept[-1].endswith(b"\n")))
        closes = right == len(raw) or raw[right] == 10
        if opens and closes:
            a, b = left, min(right + 1, len(raw))
            if b == len(raw) and a > at and raw[a - 1] == 10 and right == len(raw):
                a -= 1  # the last line takes the line end before it along
        elif a > 0 and b < len(raw) and raw[a - 1] in _BLANKS and raw[b] in _BLANKS:
            b += 1
        if a > at:
            kept.append(raw[at:a])
        at = max(at, b)
    return b"".join([*kept, raw[at:]]).decode()


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the repeated passages cut out of the text, and with ``spans`` (byte ranges of the text as it was) and
    ``earlier`` (ids of the documents that hold them) as :func:`repeats` finds them.

    Both are empty for documents that repeat nothing, whose text stays as it is (null stays null). Rows, repeated ones too,
    and other columns stay; columns of these two names are replaced. An empty table gives an empty table.
    """
    docs = docs.drop("spans", "earlier")
    found = written(repeats(docs, text, key).withColumnsRenamed({"doc": "__doc", "version": "__version"}), "repeats", release=True)
    same = (F.col(f"`{key}`") == F.col("__doc")) & (_version(F.col(f"`{text}`")) == F.col("__version"))
    joined = docs.join(found.hint("merge"), same, "left").drop("__doc", "__version")
    added = StructType([StructField("spans", ArrayType(StructType([StructField("a", LongType()), StructField("b", LongType())]))), StructField("earlier", ArrayType(LongType()))])
    schema = StructType(docs.schema.fields + added.fields)
    place, width = docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, cuts, ids = batch.column(place), batch.column(width), batch.column(width + 1)
            ranges: list = [[] for _ in range(batch.num_rows)]
            some = np.flatnonzero(np.asarray(cuts.is_valid()))
            if len(some):
                texts = column.to_pylist()
                for i in some.tolist():
                    ranges[i] = _bytes_of(column.slice(i, 1), [cuts[i].as_py()])[0]
                    texts[i] = _cut(texts[i], ranges[i])
                column = pa.array(texts, pa.string())
            lists = [pa.array([[{"a": a, "b": b} for a, b in r] for r in ranges], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))]
            lists.append(pa.array([x or [] for x in ids.to_pylist()], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([column if i == place else batch.column(i) for i in range(width)] + lists, schema.fieldNames())

    return map_arrow(joined.select(*[F.col(f"`{c}`") for c in schema.fieldNames()]), run, schema)
