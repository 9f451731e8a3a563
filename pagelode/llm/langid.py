"""Language identification by interpolated Kneser-Ney character models.

A text is its runs of letters (and the marks on them), in lower case. Each run is scored by itself, with a start and an end
symbol, so the score of a run depends on the run alone and is computed once for all its copies in a slice. The model of a
language holds, for each order, n-gram and context hashes in sorted arrays. The language with the lowest cross-entropy for
each symbol wins; a text is rejected where even that is far above what texts of the language have, as measured on rows
that were left out of the counts.

The fit reads a bounded sample of labelled rows (``rows_per_lang``); everything else reads whole texts of all rows. Languages
are held in blocks of ``BLOCK``, one model each; texts are scored by one block after another and keep the best so far, so
there can be any number of languages.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from . import words
from .hashing import NONE, Table
from .runtime import map_arrow, unit_hash, written

ORDER = 5
DISCOUNT = 0.75
ROWS_PER_LANG = 600
BLOCK = 256
ASIDE = 0.2
UNKNOWN = "und"
SLICE = 1 << 20
CACHE = 400_000
#: A text is rejected only beyond this many times the largest deviation seen, and by at least this much for each symbol.
REJECT_TIMES, REJECT_LEAST = 3.0, 1.0
#: Symbols that count as evidence for the score at most, and how much each counts.
EVIDENCE_SYMBOLS, EVIDENCE = 400, 0.5
_START, _END = 0x110000, 0x110001
_CACHES: dict[str, tuple] = {}


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of letters, of letters and marks, and the lower case of each code point."""
    letter = np.zeros(0x110002, bool)
    mark = np.zeros(0x110002, bool)
    lower = np.arange(0x110002, dtype=np.uint32)
    for c in [*range(0xD800), *range(0xE000, 0x110000)]:
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            letter[c] = True
            if len(low := chr(c).lower()) == 1:
                lower[c] = ord(low)
        elif kind == "M":
            mark[c] = True
    return letter, letter | mark, lower


class Runs:
    """Runs of letters of some texts: distinct runs (``start``/``end`` in ``cp``), which one each run is, and runs of each row."""

    def __init__(self, texts: list[str]):
        letter, inside, lower = _letters()
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.cp = lower[cp]
        n = len(cp)
        solid = np.zeros(n + 2, bool)
        solid[1:-1] = inside[cp]
        opens = np.zeros(n + 1, bool)
        opens[first] = True
        start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | opens[:-1]))
        end = np.flatnonzero(solid[1:-1] & (~solid[2:] | opens[1:])) + 1
        has = np.concatenate([[0], np.cumsum(letter[cp])])
        real = has[end] > has[start]
        start, end = start[real], end[real]
        self.first = np.searchsorted(start, first)
        key = self._hash(start, end)
        _, at, self.which = np.unique(key, return_index=True, return_inverse=True)
        self.start, self.end = start[at], end[at]

    def _hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = words.mix(self.cp.astype(np.uint64) + np.uint64(1))
        size = (1 << 20) + 1
        if len(value) < size:
            power, inverse = words.powers(len(value) + 1)
        else:  # one very long text: powers of the same base, as many as it has code points
            power = np.full(len(value) + 1, words.BASE, np.uint64)
            inverse = np.full(len(value) + 1, words.BASE_INVERSE, np.uint64)
            power[0] = inverse[0] = 1
            power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value * power[:-1], out=total[1:])
        return words.mix((total[end] - total[start]) * inverse[start])

    def grams(self, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each symbol of each distinct run and its end: the run, and hashes of the 1-, 2-, ... ``order``-gram ending there.

        The history before a run is start symbols, so hashes of longer grams reach into them.
        """
        size = self.end - self.start
        total = int((size + 1).sum())
        run = np.repeat(np.arange(len(size)), size + 1)
        at = np.arange(total) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
        source = np.minimum(np.repeat(self.start, size + 1) + at, max(0, len(self.cp) - 1))
        symbol = np.where(at < size[run], self.cp[source] if len(self.cp) else 0, _END).astype(np.uint64)
        value = words.mix(symbol + np.uint64(3))
        hashes, h = [], np.zeros(total, np.uint64)
        begin = words.mix(np.array([_START + 3], np.uint64))[0]
        for k in range(order):
            back = np.where(at >= k, value[np.maximum(np.arange(total) - k, 0)], begin)
            h = words.mix(h * np.uint64(words.BASE) + back + np.uint64(k))
            hashes.append(h)
        return run, hashes


@dataclass
class Order:
    """One order of one language: sorted hashes with the discounted share of each n-gram, and with the backoff weight of each context."""

    grams: np.ndarray
    shares: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray


@dataclass
class Model:
    """A block of languages. ``name`` is a digest of all that its chances follow from; workers cache by it."""

    langs: list[str]
    alphabet: int
    orders: list[list[Order]] = field(default_factory=list)
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    name: str = ""


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def _context_hashes(runs: Runs, run: np.ndarray, hashes: list[np.ndarray]) -> list[np.ndarray]:
    """Hash of the context of each symbol for each order: the gram of one symbol less that ends before it."""
    first = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, bool)
    out = [np.zeros(len(run), np.uint64)]
    start = np.zeros(1, np.uint64)
    begin = words.mix(np.array([_START + 3], np.uint64))[0]
    for k in range(len(hashes) - 1):
        start = words.mix(start * np.uint64(words.BASE) + begin + np.uint64(k))
        before = np.concatenate([np.zeros(1, np.uint64), hashes[k][:-1]])
        out.append(np.where(first, start[0], before))
    return out


def _fit_language(spelled: list[str], counts: np.ndarray, alphabet: int) -> list[Order]:
    runs = Runs(spelled)
    weight = np.bincount(runs.which, weights=counts, minlength=len(runs.start))
    run, hashes = runs.grams(ORDER)
    contexts = _context_hashes(runs, run, hashes)
    times = weight[run]
    orders: list[Order] = []
    for n in range(ORDER, 0, -1):
        gram, at = np.unique(hashes[n - 1], return_index=True)
        context = contexts[n - 1][at]
        if n == ORDER:
            where = np.searchsorted(gram, hashes[n - 1])
            count = np.bincount(where, weights=times, minlength=len(gram))
        else:  # continuation counts: distinct symbols before the gram
            longer, at_longer = np.unique(hashes[n], return_index=True)
            where = np.searchsorted(gram, hashes[n - 1][at_longer])
            count = np.bincount(where, minlength=len(gram)).astype(float)
        known, inside = np.unique(context, return_inverse=True)
        total = np.bincount(inside, weights=count, minlength=len(known))
        off = np.minimum(count, DISCOUNT)
        orders.append(Order(gram, (count - off) / total[inside], known, np.bincount(inside, weights=off, minlength=len(known)) / total))
    return orders[::-1]


def _log_chances(model: Model, hashes: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
    """Natural logarithms of the interpolated chances, one column a language."""
    out = np.empty((len(hashes[0]), len(model.langs)), np.float32)
    for k, orders in enumerate(model.orders):
        p = np.full(len(hashes[0]), 1.0 / model.alphabet)
        for n, o in enumerate(orders):
            p = _find(o.grams, o.shares, hashes[n], 0.0) + _find(o.contexts, o.weights, contexts[n], 1.0) * p
        out[:, k] = np.log(p)
    return out


def _scored(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Summed log chances (text, language), and the number of symbols of each text."""
    runs = Runs(texts)
    n = len(model.langs)
    sums, symbols = np.zeros((len(texts), n)), np.zeros(len(texts), np.int64)
    if not len(runs.start):
        return sums, symbols
    if model.name not in _CACHES:
        _CACHES.clear()
        _CACHES[model.name] = (Table(20), [np.zeros((0, n), np.float32)])
    table, logs = _CACHES[model.name]
    run, hashes = runs.grams(ORDER)
    key = hashes[-1] & ~np.uint64(1)
    new = np.flatnonzero(table.get(key) == NONE)
    if len(new):
        if table.used + len(new) > CACHE:
            table, logs = _CACHES[model.name] = (Table(int(np.ceil(np.log2(2 * max(CACHE, len(key)))))), [np.zeros((0, n), np.float32)])
            new = np.arange(len(key))
        contexts = _context_hashes(runs, run, hashes)
        fresh, at = np.unique(key[new], return_index=True)
        at = new[at]
        made = _log_chances(model, [h[at] for h in hashes], [c[at] for c in contexts])
        table.add(fresh, np.arange(table.used, table.used + len(fresh), dtype=np.int32))
        logs[0] = np.concatenate([logs[0], made])
    of = table.get(key)
    row = np.repeat(np.arange(len(texts)), np.diff(runs.first))
    for k in range(n):
        by_run = np.bincount(run, weights=logs[0][of, k], minlength=len(runs.start))
        sums[:, k] = np.bincount(row, weights=by_run[runs.which], minlength=len(texts))
    size = (runs.end - runs.start + 1)[runs.which]
    return sums, np.bincount(row, weights=size, minlength=len(texts)).astype(np.int64)


def _best(model: Model, sums: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of the best language, its cross-entropy, a score, and whether it is rejected."""
    each = -sums / np.maximum(symbols, 1)[:, None]
    best = each.argmin(axis=1)
    lowest = each[np.arange(len(best)), best]
    # The sums as evidence, tempered since neighbouring symbols are not independent
    evidence = -(each - lowest[:, None]) * np.minimum(symbols, EVIDENCE_SYMBOLS)[:, None] * EVIDENCE
    score = 1 / np.exp(np.maximum(evidence, -700)).sum(axis=1)
    away = lowest - model.mean[best] if model.mean is not None else np.zeros(len(best))
    limit = np.maximum(REJECT_LEAST, REJECT_TIMES * (model.spread[best] if model.spread is not None else 0) / np.sqrt(np.maximum(symbols, 1)))
    return best, lowest, score, away > limit


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_lang: int = ROWS_PER_LANG, seed: int = 3) -> list[Model]:
    """Models of the languages of ``docs``, in blocks; rows with a null text or language are left out.

    Of each language about ``rows_per_lang`` rows are taken by a hash of the key; a fifth of them measures what is normal,
    unless that fifth would be all. Texts of a language without a measured row are never rejected: nothing says what is
    normal there, and models of few rows find other clean texts of their language far from what they saw.
    Without any labelled row there is no model, and no language is known.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    counts = rows.groupBy("l").agg(F.count("*").alias("count"), F.max(unit_hash("k", seed=seed + 1)).alias("top")).collect()  # a row for each language
    rate = sorted((r["l"], min(1.0, rows_per_lang / r["count"]), r["top"] >= ASIDE) for r in counts)
    if not rate:
        return []
    rates = docs.sparkSession.createDataFrame(rate, "l string, rate double, apart boolean")
    taken = rows.join(F.broadcast(rates), "l").where(unit_hash("k", seed=seed) < F.col("rate"))  # a row for each language
    taken = taken.select("l", "t", (F.col("apart") & (unit_hash("k", seed=seed + 1) < ASIDE)).alias("aside"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        found: dict[str, Counter] = {}
        for batch in batches:
            for name, t, aside in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not aside:
                    runs = Runs([t])
                    n = np.bincount(runs.which, minlength=len(runs.start)).tolist()
                    spelled = runs.cp.tobytes().decode("utf-32-le")
                    c = found.setdefault(name, Counter())
                    for a, b, k in zip(runs.start.tolist(), runs.end.tolist(), n, strict=True):
                        c[spelled[a:b]] += k
        for name, c in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["l", "w", "n"])

    table = map_arrow(taken, counted, "l string, w string, n bigint").groupBy("l", "w").agg(F.sum("n").alias("n"))
    names = [r[0] for r in rate]
    blocks = [names[i : i + BLOCK] for i in range(0, len(names), BLOCK)]
    if len(blocks) > 1:
        table = written(table, "language-words")
    models, symbols = [], set()
    for block in blocks:
        words_of = (table if len(blocks) == 1 else table.where(F.col("l").isin(block))).toArrow()  # bounded by the sample of a block
        langs = sorted(set(words_of.column("l").to_pylist()))
        digest = hashlib.blake2b(repr((seed, ORDER, DISCOUNT)).encode())
        spelled = []
        for name in langs:
            t = words_of.filter(pa.compute.equal(words_of.column("l"), name)).sort_by("w")
            spelled.append((t.column("w").to_pylist(), np.array(t.column("n").to_pylist(), float)))
            symbols |= {c for w in spelled[-1][0] for c in w}
            digest.update("\0".join([name, *spelled[-1][0]]).encode() + spelled[-1][1].tobytes())
        models.append((langs, spelled, digest))
    alphabet = len(symbols) + 2
    made = []
    for langs, spelled, digest in models:
        if langs:
            model = Model(langs, alphabet, name=f"{alphabet}-{digest.hexdigest()}")
            model.orders = [_fit_language(w, n, alphabet) for w, n in spelled]
            made.append(model)

    known = {name: (m, k) for m in made for k, name in enumerate(m.langs)}
    normal = predict(taken.where("aside").select("l", "t"), made, "t").select("l", "lang_pred", "cross_entropy", "n_symbols").where("l = lang_pred and n_symbols > 0").toPandas()
    for m in made:
        m.mean, m.spread = np.full(len(m.langs), np.inf), np.zeros(len(m.langs))
    for name, own in normal.groupby("l"):
        m, k = known[name]
        m.mean[k] = np.average(own.cross_entropy, weights=own.n_symbols)
        m.spread[k] = max(0.5, float((np.abs(own.cross_entropy - m.mean[k]) * np.sqrt(own.n_symbols)).quantile(0.99)))
    return made


def predict(docs: DataFrame, models: list[Model], text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` without its text (unless ``keep_text``), with ``lang_pred``, ``score`` (0 to 1), ``cross_entropy``, ``n_symbols`` and ``rejected``.

    A null text, or one without a letter, gets the language "und", score 0 and no cross-entropy, and is rejected. Equal
    texts get equal results; ties go to the language that sorts first. Columns of these names are replaced.
    """
    names = [f.name for f in _ADDED]
    others = [c for c in docs.columns if (keep_text or c != text) and c not in names]
    found = docs
    for i, model in enumerate(models or [Model([], 1, name="none")]):
        last = i + 1 >= len(models)
        found = _mapped(found, model, text, others if last else list(dict.fromkeys([*others, text])), i > 0)
    return found


_ADDED = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("cross_entropy", DoubleType()), StructField("n_symbols", LongType()), StructField("rejected", BooleanType())]


def _better(batch: pa.RecordBatch, columns: list[pa.Array]) -> list[pa.Array]:
    """Of what earlier blocks found and what this one did, the lower cross-entropy; the score is that among all languages."""
    was = [batch.column(f"__was_{f.name}") for f in _ADDED]
    old, new = (np.asarray(c[2].fill_null(np.inf), dtype=float) for c in (was, columns))
    a, b = np.asarray(was[1], dtype=float), np.asarray(columns[1], dtype=float)
    some = np.isfinite(new) & np.isfinite(old)
    weight = np.minimum(np.asarray(columns[3], dtype=float), EVIDENCE_SYMBOLS) * EVIDENCE
    least = np.where(some, np.minimum(old, new), 0.0)
    total = sum(np.exp(-np.minimum((np.where(some, h, 0.0) - least) * weight, 700)) / np.where(some, s, 1.0) for h, s in ((old, a), (new, b)))
    score = np.where(some, 1 / total, np.maximum(a, b))
    take = pa.array(new < old)
    picked = [pa.compute.if_else(take, n, o) for n, o in zip(columns, was, strict=True)]
    picked[1] = pa.array(score)
    return picked


def _mapped(docs: DataFrame, model: Model, text: str, others: list[str], again: bool) -> DataFrame:
    """The columns ``others`` and the prediction by a model; with ``again`` the better of it and the one that is there."""
    kept = [docs.schema[c] for c in others]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that the fit reads for a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column(text)
            parts = []
            for i, j in words.slices(column, SLICE):
                texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
                if not model.langs:
                    parts.append(([UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts), np.zeros(len(texts), np.int64), np.ones(len(texts), bool)))
                    continue
                sums, symbols = _scored(model, texts)
                best, lowest, score, rejected = _best(model, sums, symbols)
                some = symbols > 0
                parts.append((
                    [model.langs[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0),
                    [h if s else None for h, s in zip(lowest.tolist(), some, strict=True)], symbols, rejected | ~some,
                ))
            columns = [pa.concat_arrays([pa.array(p[k], t) for p in parts]) if parts else pa.array([], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()))]
            if again:
                columns = _better(batch, columns)
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + columns, [f.name for f in kept + _ADDED])

    wanted = [F.col(f"`{c}`") for c in dict.fromkeys([*others, text])]
    if again:
        wanted += [F.col(f.name).alias(f"__was_{f.name}") for f in _ADDED]
    return map_arrow(docs.select(*wanted), run, StructType(kept + _ADDED))
