"""Encoding texts with a public byte-level BPE tokenizer (problem 6).

Texts are cut by the tokenizer's pattern; the distinct pieces of a batch that
are not known yet are encoded together. Pieces of like length are rows of a
padded matrix of token ids. In each round every row merges its leftmost pair of
minimum rank, the matrix is compacted, the two pairs next to the merge are
looked up again in a hash table of pairs, and rows without a pair leave.

Text that looks like a marker is ordinary text. Null and empty texts have no
ids. A vocabulary is a file given by its path; it is read on the driver and
broadcast, its size being that of the vocabulary and not of the data.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.session import spread

#: The pattern published with the vocabulary: contractions, words, numbers, signs, white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Widest matrix; longer pieces, where rounds times width would be quadratic, take a heap.
WIDEST = 256
#: Pieces a worker remembers; it forgets all of them at once when there are more.
REMEMBERED = 400_000
#: Characters encoded at a time.
CHARS = 2_000_000

_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Byte ids and the hash table of pairs: (left, right) -> rank, merged id."""

    def __init__(self, bytes_to_id: np.ndarray, pairs: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.bytes = bytes_to_id.astype(np.int32)
        size = 1 << max(4, (4 * len(pairs) - 1).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, _NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        slots: dict[int, int] = {}
        for (left, right), (rank, merged) in pairs.items():
            key = left << 32 | right
            slot = ((key * int(_MIX)) & (2**64 - 1)) >> int(self.shift)
            while slot in slots:
                slot = (slot + 1) & self.mask
            slots[slot] = key
            self.keys[slot], self.ranks[slot], self.merged[slot] = key, rank, merged

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; a rank of ``_NONE`` where there is none."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = ((key.view(np.uint64) * _MIX) >> self.shift).astype(np.int64)
        held = self.keys[slot]
        open_ = np.flatnonzero((held != key) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            held = self.keys[slot[open_]]
            open_ = open_[(held != key[open_]) & (held != -1)]
        return self.ranks[slot], self.merged[slot]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a ``.tiktoken`` rank file or a ``.json`` file with merges."""
        if path.endswith(".json"):
            return cls._merges(path)
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        single = np.array([ranks[bytes([b])] for b in range(256)])
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = (rank, rank)
        return cls(single, pairs)

    @classmethod
    def _merges(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = model["vocab"]
        # Printable bytes stand for themselves in such files, the others for characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        sign = dict(zip(shown, map(chr, shown))) | {b: chr(256 + i) for i, b in enumerate(hidden)}
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pairs.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        return cls(np.array([ids[sign[b]] for b in range(256)]), pairs)


def encode_pieces(vocabulary: Vocabulary, pieces: list[bytes]) -> list[list[int]]:
    """The ids of each piece."""
    out: list[list[int]] = [[] for _ in pieces]
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    low = 0
    while low < WIDEST:
        high = low + max(2, low // 2)  # lengths of a bucket differ by a half at most
        rows = np.flatnonzero((lengths > low) & (lengths <= min(high, WIDEST)))
        width = min(high, WIDEST)
        for at in range(0, len(rows), max(1, 4_000_000 // width)):
            _bucket(vocabulary, pieces, rows[at : at + max(1, 4_000_000 // width)], width, lengths, out)
        low = high
    for row in np.flatnonzero(lengths > WIDEST).tolist():
        out[row] = _by_heap(vocabulary, pieces[row])
    return out


def _bucket(vocabulary, pieces, rows, width, lengths, out) -> None:
    joined = b"".join(pieces[r].ljust(width, b"\0") for r in rows.tolist())
    ids = vocabulary.bytes[np.frombuffer(joined, np.uint8)].reshape(len(rows), width)
    size = lengths[rows]
    ids = np.where(np.arange(width) < size[:, None], ids, -1).astype(np.int32)
    ranks = np.full((len(rows), width), _NONE, np.int32)
    merged = np.zeros((len(rows), width), np.int32)
    if width > 1:
        r, m = vocabulary.find(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        ranks[:, :-1], merged[:, :-1] = r.reshape(len(rows), -1), m.reshape(len(rows), -1)
        ranks[:, :-1][ids[:, 1:] < 0] = _NONE
    while len(rows):
        best = ranks.argmin(1)  # the leftmost of the least
        line = np.arange(len(rows))
        over = ranks[line, best] == _NONE
        if over.any():
            for row, values, n in zip(rows[over].tolist(), ids[over].tolist(), size[over].tolist()):
                out[row] = values[:n]
            keep = ~over
            rows, ids, ranks, merged, size, best = rows[keep], ids[keep], ranks[keep], merged[keep], size[keep], best[keep]
            if not len(rows):
                return
            width = int(size.max())
            ids, ranks, merged = ids[:, :width], ranks[:, :width], merged[:, :width]
            line = np.arange(len(rows))
        ids[line, best] = merged[line, best]
        # Close the gap: what is right of the merge moves one place to the left.
        place = np.arange(width - 1)
        source = place + (place > best[:, None])
        ids = np.concatenate([np.take_along_axis(ids, source, 1), np.full((len(rows), 1), -1, np.int32)], 1)
        source = place + (place >= best[:, None])
        ranks = np.concatenate([np.take_along_axis(ranks, source, 1), np.full((len(rows), 1), _NONE, np.int32)], 1)
        merged = np.concatenate([np.take_along_axis(merged, source, 1), np.zeros((len(rows), 1), np.int32)], 1)
        size = size - 1
        for left in (best - 1, best):
            ok = np.flatnonzero((left >= 0) & (left + 1 < size))
            r, m = vocabulary.find(ids[ok, left[ok]], ids[ok, left[ok] + 1])
            ranks[ok, left[ok]], merged[ok, left[ok]] = r, m
            bad = np.flatnonzero((left >= 0) & (left + 1 >= size))
            ranks[bad, left[bad]] = _NONE


def _by_heap(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """The same merges for one long piece, in n log n: a linked list and a heap of pairs."""
    ids = vocabulary.bytes[np.frombuffer(piece, np.uint8)]
    rank, merged = vocabulary.find(ids[:-1], ids[1:])
    known = np.flatnonzero(rank != _NONE).tolist()
    ids = ids.tolist()
    n = len(ids)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(int(rank[i]), i, ids[i], ids[i + 1], int(merged[i])) for i in known]
    heapify(heap)
    seen: dict[tuple[int, int], tuple[int, int]] = {}

    def push(i: int) -> None:
        j = right[i]
        if j >= n:
            return
        pair = (ids[i], ids[j])
        if pair not in seen:
            r, m = vocabulary.find(np.array(pair[:1]), np.array(pair[1:]))
            seen[pair] = (int(r[0]), int(m[0]))
        r, m = seen[pair]
        if r != _NONE:
            heappush(heap, (r, i, *pair, m))

    while heap:
        _, i, a, b, m = heappop(heap)
        if ids[i] != a or right[i] >= n or ids[right[i]] != b:
            continue  # one of the two has been merged since
        gone = right[i]
        ids[i], ids[gone] = m, -1
        right[i] = right[gone]
        if right[i] < n:
            left[right[i]] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    return [x for x in ids if x >= 0]


class Encoder:
    """Encodes texts and remembers pieces: a piece has a number, its ids lie in a pool of all."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN) -> None:
        self.vocabulary, self.cut = vocabulary, regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.used = np.empty(1 << 16, np.int32), 0
        self.starts, self.sizes = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        ids = encode_pieces(self.vocabulary, [p.encode() for p in fresh])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        first, more = len(self.known), int(sizes.sum())
        self.pool = _room(self.pool, self.used + more)
        self.starts, self.sizes = _room(self.starts, first + len(ids)), _room(self.sizes, first + len(ids))
        self.pool[self.used : self.used + more] = np.fromiter(chain.from_iterable(ids), np.int32, more)
        self.sizes[first : first + len(ids)] = sizes
        self.starts[first : first + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.used += more
        self.known.update(zip(fresh, range(first, first + len(ids))))

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin."""
        cut = [self.cut(t) if t else [] for t in texts]
        fresh = list({p for c in cut for p in c if p not in self.known})
        if len(self.known) + len(fresh) > REMEMBERED:
            self._forget()
            fresh = list({p for c in cut for p in c})
        if fresh:
            self._learn(fresh)
        pieces = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        sizes = self.sizes[pieces]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[pieces] - ends + sizes, sizes)
        per_text = np.cumsum([0, *map(len, cut)])
        return self.pool[at], np.concatenate([[0], ends])[per_text]

    def __call__(self, texts: list[str | None]) -> list[list[int]]:
        ids, bounds = self.flat(texts)
        return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """``array``, or a copy with room for ``size``."""
    if size <= len(array):
        return array
    more = np.empty(max(size, 2 * len(array)), array.dtype)
    more[: len(array)] = array
    return more


def encoded(documents: DataFrame, vocabulary: Vocabulary, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids): the ids of each document's text; one row per row of ``documents``.

    Null and empty texts give an empty list, repeated rows repeated results, an
    empty table no rows; a null ``doc_id`` is kept; other columns are ignored.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            start = chars = 0
            for end, text in enumerate(texts, 1):
                chars += len(text or "")
                if chars >= CHARS or end == len(texts):
                    ids, bounds = encoder.flat(texts[start:end])
                    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, end - start), lists], schema=schema)
                    start, chars = end, 0

    texts = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    return texts.mapInArrow(run, "doc_id bigint, ids array<int>")
