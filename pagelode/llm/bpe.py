"""Byte-level BPE: encoding and decoding of whole texts by a given vocabulary of ranked byte strings.

Distinct pieces of a slice of texts are padded into matrices by length. In each round every row merges its leftmost pair
of least rank; ranks of pairs come from an open-addressing hash table; merged rows are compacted and finished rows leave
the matrix. Pieces longer than ``LONG`` bytes take a heap instead, since rounds over a row cost the square of its length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .hashing import NONE, Table
from .runtime import map_arrow

LONG = 256
CACHE_PIECES = 500_000
SLICE = 1 << 19
#: Fixed value: the split of the public vocabularies, which Splitter does without a regex engine.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MADE: dict[tuple, "Encoder"] = {}


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file (base64 token, blank, rank), by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Vocabulary:
    """Tables for encoding and decoding; they are a few MB, fixed by the vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.pattern, self.tokens = pattern, tokens
        rank = {t: i for i, t in enumerate(tokens) if t}
        self.byte_id = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for i, t in enumerate(tokens):
            for cut in range(1, len(t)):
                if (a := rank.get(t[:cut])) is not None and (b := rank.get(t[cut:])) is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(i)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        self.pairs = Table(max(4, int(np.ceil(np.log2(len(keys) * 3 + 1)))))
        self.pairs.add(keys, np.array(merged, np.int32))
        lengths = np.array([len(t) for t in tokens], np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(lengths)])

    def pair_ids(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merged pairs (the rank of a pair is its id); a large number where there is none or an id is negative."""
        keys = left.astype(np.uint32).astype(np.uint64) << np.uint64(32) | right.astype(np.uint32).astype(np.uint64)
        return self.pairs.get(keys.ravel()).reshape(left.shape)

    def decode(self, ids: np.ndarray) -> bytes:
        start, size = self.at[ids], self.at[ids + 1] - self.at[ids]
        return self.flat[ragged(start, size)].tobytes()


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes start[0], ..., start[0]+size[0]-1, start[1], ..."""
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return np.arange(total) + np.repeat(start - (end - size), size)


class Splitter:
    """Cuts code points where ``SPLIT`` does, by runs of letters, numbers, white space and others, without the regex engine."""

    def __init__(self) -> None:
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.kind = np.full(0x110000, 3, np.uint8)
        for k, pattern in enumerate((r"\s", r"\p{L}", r"\p{N}")):
            self.kind[np.frombuffer("".join(regex.findall(pattern, everything)).encode("utf-32-le"), np.uint32)] = k
        self.value = words.mix(np.arange(1, 0x110001, dtype=np.uint64)) | np.uint64(1)

    def cuts(self, cp: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of the pieces. ``first``: where the texts begin, with the total at the end."""
        n = len(cp)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.kind[cp]
        edge = np.ones(n + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[first] = True
        start = np.flatnonzero(edge[:-1])
        end = np.append(start[1:], n)
        opens = np.zeros(n + 1, bool)
        opens[first] = True
        cut = np.zeros(n + 1, bool)
        cut[start] = True
        space = kind[start] == 0
        last = end[space & ~opens[end]] - 1  # white space before something else in the same text
        cut[last] = True
        blank = last[cp[last] == 32]
        cut[blank + 1] = False  # one blank goes with what follows it
        tick = start[(cp[start] == 39) & (end - start == 1) & cut[start]]
        if len(tick):
            ahead = np.concatenate([cp, np.zeros(2, cp.dtype)])
            a, b = ahead[tick + 1], ahead[tick + 2]
            inside = ~opens[tick + 1]
            one = inside & np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
            two = inside & ~opens[np.minimum(tick + 2, n)] & np.logical_or.reduce([(a == ord(x)) & (b == ord(y)) for x, y in ("re", "ve", "ll")])
            for at, size in ((tick[one], 2), (tick[two & ~one], 3)):
                cut[at + 1] = False
                cut[at + size] = True
        return np.flatnonzero(cut[:-1])

    def hashes(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        power, inverse = words.powers(len(cp))
        total = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(self.value[cp] * power, out=total[1:])
        return words.mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)) & ~np.uint64(1)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.split = regex.compile(vocabulary.pattern).findall
        self.whole = {t: i for i, t in enumerate(vocabulary.tokens) if t}
        self.splitter = Splitter() if vocabulary.pattern == SPLIT else None
        self.known = Table(int(np.ceil(np.log2(2 * CACHE_PIECES))))
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _matrix(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of at most ``width`` bytes, one after another, and how many each has."""
        n = len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        tokens = np.full((n, width), -1, np.int32)
        tokens[np.arange(width) < size[:, None]] = self.v.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.v.pair_ids(tokens[:, :-1], tokens[:, 1:])
        done, count, row = np.full((n, width), -1, np.int32), size.copy(), np.arange(n)
        while len(row):
            best = ranks.argmin(axis=1)  # the leftmost of the least
            lines = np.arange(len(row))
            least = ranks[lines, best]
            over = least == NONE
            if over.any():
                done[row[over], : tokens.shape[1]] = tokens[over]
                count[row[over]] = size[over]
                on = ~over
                row, size, tokens, ranks, best, least = row[on], size[on], tokens[on], ranks[on], best[on], least[on]
                if not len(row):
                    break
                lines = np.arange(len(row))
            last = tokens.shape[1] - 1
            tokens[lines, best] = least
            tokens = tokens[np.arange(last + 1) != best[:, None] + 1].reshape(len(row), last)
            if last == 1:
                ranks = np.full((len(row), 1), NONE, np.int32)
                done[row, :1], count[row] = tokens, 1
                break
            gone = np.minimum(best + 1, last - 1)  # where two pairs met, one is left
            ranks = ranks[np.arange(last) != gone[:, None]].reshape(len(row), last - 1)
            size = size - 1
            right = best < last - 1
            ranks[lines[right], best[right]] = self.v.pair_ids(least[right], tokens[lines[right], best[right] + 1])
            left = best > 0
            ranks[lines[left], best[left] - 1] = self.v.pair_ids(tokens[lines[left], best[left] - 1], least[left])
        return done[np.arange(width) < count[:, None]], count

    def _long(self, piece: bytes) -> np.ndarray:
        ids = self.v.byte_id[np.frombuffer(piece, np.uint8)]
        ranks = self.v.pair_ids(ids[:-1], ids[1:])
        heap = [(int(r), i) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        token, rank = ids.tolist(), ranks.tolist() + [int(NONE)]
        nxt, prv = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        alive = [True] * len(token)

        def renew(i: int) -> None:
            j = nxt[i]
            rank[i] = int(self.v.pair_ids(np.array([token[i]]), np.array([token[j]]))[0]) if j < len(token) else int(NONE)
            if rank[i] != NONE:
                heapq.heappush(heap, (rank[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or rank[i] != r:
                continue
            j = nxt[i]
            token[i], alive[j], nxt[i] = r, False, nxt[j]
            if nxt[j] < len(token):
                prv[nxt[j]] = i
            renew(i)
            if prv[i] >= 0:
                renew(prv[i])
        return np.array([t for t, a in zip(token, alive, strict=True) if a], np.int32)

    def pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after another, and how many each has."""
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(texts):
            n = len(p)
            buckets.setdefault(0 if p in self.whole else -1 if n > LONG else 4 * ((n + 3) // 4) if n <= 32 else 1 << (n - 1).bit_length(), []).append(i)
        flat, sizes, order = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for width, members in buckets.items():
            if width == 0:
                flat.append(np.array([self.whole[texts[i]] for i in members], np.int32))
                sizes.append(np.ones(len(members), np.int64))
            elif width < 0:
                coded = [self._long(texts[i]) for i in members]
                flat += coded
                sizes.append(np.array([len(x) for x in coded], np.int64))
            else:
                rows = max(1, (1 << 17) // width)
                for k in range(0, len(members), rows):
                    ids, count = self._matrix([texts[i] for i in members[k : k + rows]], width)
                    flat.append(ids)
                    sizes.append(count)
            order.append(np.array(members, np.int64))
        ids, size, where = np.concatenate(flat), np.concatenate(sizes), np.argsort(np.concatenate(order))
        return ids[ragged((np.cumsum(size) - size)[where], size[where])], size[where]

    def _known(self, count: int) -> None:
        """Make room for ``count`` more pieces."""
        if self.known.used + count > CACHE_PIECES:
            self.known, self.flat, self.at = Table(int(np.ceil(np.log2(2 * max(CACHE_PIECES, count))))), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        ids, size = self.pieces(pieces)
        code = np.arange(len(self.at) - 1, len(self.at) - 1 + len(size), dtype=np.int32)
        self.flat = np.concatenate([self.flat, ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
        return code

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and the first of each with the total at the end."""
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if self.splitter is None or first[-1] > 2 * SLICE:
            return self._by_regex(texts)
        whole = "".join(texts)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        start = self.splitter.cuts(cp, first)
        end = np.append(start[1:], len(cp)) if len(start) else start
        key = self.splitter.hashes(cp, start, end)
        new = np.flatnonzero(self.known.get(key) == NONE)
        if len(new):
            if self.known.used + len(new) > CACHE_PIECES:
                self._known(len(key))
                new = np.arange(len(key))
            fresh, at = np.unique(key[new], return_index=True)
            at = new[at]
            raw = [whole[a:b].encode("utf-8") for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            self.known.add(fresh, self._learn(raw))
        code = self.known.get(key)
        size = self.at[code + 1] - self.at[code]
        ids = self.flat[ragged(self.at[code], size)]
        per_row = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, first)]
        if self.v.decode(ids) != whole.encode("utf-8"):  # two pieces with one hash
            return self._by_regex(texts)
        return ids, per_row

    def _by_regex(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.split(t) for t in texts]
        code: dict[str, int] = {}
        for row in split:
            for p in row:
                code.setdefault(p, len(code))
        ids, size = self.pieces([p.encode("utf-8") for p in code])
        at = np.concatenate([[0], np.cumsum(size)])
        codes = np.array([code[p] for row in split for p in row], np.int64)
        per_row = np.concatenate([[0], np.cumsum(size[codes])])[np.concatenate([[0], np.cumsum([len(r) for r in split])]).astype(np.int64)]
        return ids[ragged(at[codes], size[codes])], per_row


def encoder(tokens: list[bytes], pattern: str) -> Encoder:
    """The encoder of a Python process, kept for its next tasks."""
    key = (len(tokens), hash(tuple(tokens)), pattern)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Encoder(Vocabulary(tokens, pattern))
    return _MADE[key]


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with an array column of the token ids of each text.

    A null or empty text has no ids. Rows, repeated ones too, and all other columns stay as they are; an existing column
    of the name ``ids`` is replaced. Special tokens are never made: their strings are ordinary text.
    """
    return _mapped(docs, tokens, pattern, text, lambda array, enc: {ids: _id_lists(array, enc)}, f"{ids} array<int>")


def decode(coded: DataFrame, tokens: list[bytes], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``coded`` with a binary column of the bytes that the ids stand for; null or no ids: no bytes. An unknown id is an error."""
    def bytes_of(array: pa.Array, enc: Encoder) -> dict[str, pa.Array]:
        return {out: pa.array([enc.v.decode(np.asarray(x or [], np.int64)) for x in array.to_pylist()], pa.binary())}

    return _mapped(coded, tokens, ".", ids, bytes_of, f"{out} binary")


def digests(docs: DataFrame, tokens: list[bytes], pattern: str, text: str = "text") -> DataFrame:
    """``docs`` without its text: with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of encoding and decoding it.

    Same rules as :func:`encode` and :func:`decode`; ids and bytes stay within a task, so they are never shuffled or written.
    """
    def both(array: pa.Array, enc: Encoder) -> dict[str, pa.Array]:
        count, hashed, back = [], [], []
        for i, j in words.slices(array, SLICE):
            ids, first = enc.encode([t or "" for t in array.slice(i, j - i).to_pylist()])
            bounds = first.tolist()
            raw = ids.astype("<u4").tobytes()
            plain = enc.v.decode(ids)
            at = np.concatenate([[0], np.cumsum(enc.v.at[ids + 1] - enc.v.at[ids])])[first].tolist()
            count += np.diff(first).tolist()
            hashed += [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)]
            back += [hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
        return {"n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(hashed, pa.string()), "decoded_sha256": pa.array(back, pa.string())}

    return _mapped(docs, tokens, pattern, text, both, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", drop=text)


def _id_lists(array: pa.Array, enc: Encoder) -> pa.Array:
    parts = []
    for i, j in words.slices(array, SLICE):
        ids, first = enc.encode([t or "" for t in array.slice(i, j - i).to_pylist()])
        parts.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def _mapped(df: DataFrame, tokens: list[bytes], pattern: str, column: str, make, added: str, drop: str | None = None) -> DataFrame:
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(added).fieldNames()
    kept = [f for f in df.schema.fields if f.name not in names and f.name != drop]
    schema = StructType(kept + StructType.fromDDL(added).fields)
    shared = df.sparkSession.sparkContext.broadcast((tokens, pattern))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*shared.value)
        for batch in batches:
            made = make(batch.column(column), enc)
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [made[n] for n in names], [f.name for f in kept] + names)

    wanted = list(dict.fromkeys([f.name for f in kept] + [column]))
    return map_arrow(df.select(*[F.col(f"`{c}`") for c in wanted]), run, schema)
