"""Evaluation texts leaking into training text (problem 7).

A random-walk embedding (CGK) reads a window of words: at each step it emits the
word under a cursor and moves on or not, as a random function of step and word
says. Windows at a small edit distance follow the same path for most steps, so
edit distance becomes Hamming distance, and sampling a few steps of the
embedding is a locality-sensitive hash of the window. Every window of every
item is hashed ``WALKS * SAMPLES`` times; so is every window of every document.
Windows that agree in one hash propose an alignment of item and document, which
is verified exactly: word by word, and where that does not do by edit distance
within a band around the alignment, so words put in or left out are seen too.

Windows have ``WINDOW`` words, the shortest passage that counts: a passage
without replaced words always agrees with itself in all hashes. A passage of 20
words or more with one word in eight replaced holds several windows with one
replaced word at most, and each agrees in a hash with a chance of a quarter or
more, so missing it in all hashes of all of them is unlikely (see the tests).

Documents are scanned in one pass without a shuffle. The items, a stated query
set, are broadcast in blocks of at most ``BLOCK`` items and ``BLOCK_CHARS``
characters, whatever their number. Where there are several blocks the words of
the documents are written once, as codes, and every block scans these.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.session import scratch, spread, written

#: Successive words that make a passage; the length of the windows.
WINDOW = 12
#: Words from which on one word in ``SPARE`` may be replaced.
LONG = 20
SPARE = 8
#: Independent walks, hashes per walk, steps of a walk, steps a hash samples.
WALKS = 6
SAMPLES = 4
STEPS = 20
PICKED = 5
#: Items, and characters of items, in one broadcast.
BLOCK = 20_000
BLOCK_CHARS = 2_000_000

_rng = np.random.Generator(np.random.PCG64(7001))
_SEEDS = _rng.integers(1, 2**63, WALKS, np.uint64) | np.uint64(1)
_PICKS = [[np.sort(_rng.choice(STEPS, PICKED, replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)]
_FOLD = np.uint64(0x9E3779B97F4A7C15)

#: Attributes of a tag; those without a value are known by name, so prose after a ``<`` is no tag.
_ATTRIBUTES = (
    r"(?:\s+(?:[a-z_:@][\w:.@-]*\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'=<>`]+)"
    r"|(?:allowfullscreen|async|autofocus|autoplay|checked|compact|controls|default|defer|disabled|hidden|loop|multiple|muted|nowrap|noshade|open|readonly|required|reversed|selected)(?=[\s/>])))*\s*/?>"
)
_BLOCK_TAGS = re.compile(rf"</?(?:p|br|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|pre|blockquote|img|section|article){_ATTRIBUTES}|<!--|-->", re.I)
_OTHER_TAGS = re.compile(rf"</?[a-z][\w:.-]*{_ATTRIBUTES}", re.I)
_LINKS = re.compile(r"\]\([^()\s]*\)")


def words(text: str | None) -> list[str]:
    """The words of a text without case, accents, punctuation, markup and invisible characters.

    Of comments only the signs go. A ``<`` that opens no well-formed tag is punctuation.
    """
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text or "-->" in text:
        text = _OTHER_TAGS.sub("", _BLOCK_TAGS.sub(" ", text))
    if "](" in text:
        text = _LINKS.sub(" ", text)
    if text.isascii():
        return text.lower().translate(_SIGNS).split()
    text = unicodedata.normalize("NFKD", text.casefold())
    return _OTHER_SIGNS.sub("", _visible(text)).split()


_SIGNS = {c: None for c in range(128) if not chr(c).isalnum() and not chr(c).isspace()}
_OTHER_SIGNS = re.compile(r"[^\w\s]+|_+")


def _visible(text: str) -> str:
    """``text`` without marks and format characters; control characters stay as white space."""
    hidden = [c for c in set(text) if ord(c) > 127 and unicodedata.category(c) in ("Mn", "Me", "Cf", "Cc")]
    return text.translate(dict.fromkeys(map(ord, hidden))) if hidden else text


def coded(tokens: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in tokens), np.uint64, len(tokens))


def hashes(codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The WALKS * SAMPLES hashes of the windows of ``width`` words at ``starts``."""
    out = np.empty((WALKS * SAMPLES, len(starts)), np.uint64)
    last = starts + width
    padded = np.append(codes, np.uint64(0))
    for walk in range(WALKS):
        moves = padded * _SEEDS[walk]
        moves ^= moves >> np.uint64(31)
        moves *= _FOLD
        moves ^= moves >> np.uint64(29)
        at, emitted = starts.copy(), []
        for step in range(STEPS):
            inside = at < last
            here = np.where(inside, at, len(codes))
            emitted.append(padded[here])
            at += ((moves[here] >> np.uint64(step)) & np.uint64(1)).astype(at.dtype) & inside
        for sample, picks in enumerate(_PICKS[walk]):
            key = np.full(len(starts), walk * SAMPLES + sample + 1, np.uint64)
            for step in picks:
                key = (key ^ emitted[step]) * _FOLD
                key ^= key >> np.uint64(32)
            out[walk * SAMPLES + sample] = key
    return out


class Index:
    """The hashed windows of a block of items, equal items as one."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        by_words: dict[tuple, list[int]] = {}
        for item, text in items:
            by_words.setdefault(tuple(words(text)), []).append(item)
        by_words.pop((), None)
        self.ids = list(by_words.values())
        self.codes = [coded(list(w)) for w in by_words]
        self.flat = np.concatenate(self.codes) if self.codes else np.empty(0, np.uint64)
        self.near = np.pad(self.flat, 1)
        self.starts = np.cumsum([0] + [len(c) for c in self.codes])
        self.vocabulary = np.unique(np.concatenate(self.codes)) if self.codes else np.empty(0, np.uint64)
        widths: dict[int, list[int]] = {}
        for number, codes in enumerate(self.codes):
            widths.setdefault(min(WINDOW, len(codes)), []).append(number)
        self.tables = {}
        for width, numbers in widths.items():
            keys, owners, offsets = [], [], []
            for number in numbers:
                starts = np.arange(len(self.codes[number]) - width + 1)
                h = hashes(self.codes[number], starts, width)
                keys.append(h.ravel())
                owners.append(np.full(h.size, number, np.int32))
                offsets.append(np.tile(starts.astype(np.int32), len(h)))
            key, owner, offset = map(np.concatenate, (keys, owners, offsets))
            order = np.argsort(key, kind="stable")
            key = key[order]
            bits = np.zeros(1 << 24, bool)
            bits[(key >> np.uint64(40)).astype(np.int64)] = True
            self.tables[width] = (key, owner[order], offset[order], np.packbits(bits, bitorder="little"))

    def scan(self, codes: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """(item number, document number) for documents ``codes[bounds[i]:bounds[i + 1]]``."""
        found: set[tuple[int, int]] = set()
        if not len(codes) or not self.codes:
            return found
        known = _member(codes, self.vocabulary)
        for width, (keys, owners, offsets, bits) in self.tables.items():
            if len(codes) < width:
                continue
            sums = np.cumsum(np.r_[0, known])
            inside = np.ones(len(codes) - width + 1, bool)
            for b in bounds[1:-1]:  # no window over the end of a document
                inside[max(0, b - width + 1) : b] = False
            # A window with more foreign words than a passage may have replaced holds none of its hashes.
            inside &= sums[width:] - sums[:-width] >= self._least(width)
            starts = np.flatnonzero(inside)
            for low in range(0, len(starts), 100_000):
                some, proposals = starts[low : low + 100_000], []
                for h in hashes(codes, some, width):
                    slot = (h >> np.uint64(40)).astype(np.int64)
                    maybe = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                    if not len(maybe):
                        continue
                    left = np.searchsorted(keys, h[maybe], "left")
                    right = np.searchsorted(keys, h[maybe], "right")
                    count = right - left
                    if not count.any():
                        continue
                    where = np.repeat(some[maybe], count)
                    index = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)
                    owner, offset = owners[index], offsets[index]
                    # Words of one window at their place in the other, or next to it; worth a look if few are not.
                    place, equal = self.starts[owner] + offset, np.zeros(len(where), np.int8)
                    for step in range(width):
                        word, at = codes[where + step], place + step
                        equal += (word == self.near[at + 1]) | (word == self.near[at]) | (word == self.near[at + 2])
                    good = equal >= self._least(width)
                    proposals.append((where[good], owner[good], where[good] - offset[good]))
                if proposals:
                    self._verify(codes, bounds, *map(np.concatenate, zip(*proposals)), found)
        return found

    @staticmethod
    def _least(width: int) -> int:
        """Words two windows of one passage share: all but two, or all of an item shorter than a window.

        Words put in push others out of the window, so that is two for one of them.
        """
        return width - 2 if width == WINDOW else width

    def _verify(self, codes, bounds, where, owners, shifts, found) -> None:
        """Compare item and document word by word along each proposed alignment."""
        documents = np.searchsorted(bounds, where, "right") - 1
        order = np.lexsort((shifts, documents, owners))
        owners, documents, shifts = owners[order], documents[order], shifts[order]
        new = np.ones(len(order), bool)
        new[1:] = (owners[1:] != owners[:-1]) | (documents[1:] != documents[:-1]) | (shifts[1:] != shifts[:-1])
        for owner, document, shift in zip(owners[new].tolist(), documents[new].tolist(), shifts[new].tolist()):
            if (owner, document) in found:
                continue
            item = self.codes[owner]
            low, high = max(shift, bounds[document]), min(shift + len(item), bounds[document + 1])
            same = item[low - shift : high - shift] == codes[low:high]
            if leaked(same, len(item)) or edited(item, codes, shift, bounds[document], bounds[document + 1]):
                found.add((owner, document))


def _member(codes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    at = np.searchsorted(vocabulary, codes)
    at[at == len(vocabulary)] = 0
    return vocabulary[at] == codes


def leaked(same: np.ndarray, length: int) -> bool:
    """Whether words equal along an alignment hold a passage of an item of ``length`` words.

    That is the whole item, WINDOW equal words in a row, or LONG words or more
    of which at most one in SPARE differs, be it at the passage's ends.
    """
    if len(same) == length and same.all():
        return True
    if len(same) < WINDOW:
        return False
    run = np.flatnonzero(np.diff(np.r_[False, same, False]))
    if len(run) and (run[1::2] - run[::2]).max() >= WINDOW:
        return True
    return _dense(same)


def _dense(same: np.ndarray) -> bool:
    """Whether LONG words or more in a row are the same but for one in SPARE."""
    if len(same) < LONG:
        return False
    score = np.cumsum(np.r_[0, np.where(same, 1, 1 - SPARE)])
    return bool((score[LONG:] >= np.minimum.accumulate(score)[: len(score) - LONG]).any())


def edited(item: np.ndarray, codes: np.ndarray, shift: int, low: int, high: int) -> bool:
    """Whether ``codes[low:high]`` holds LONG words or more of ``item`` but for one edit in SPARE.

    An edit is a word replaced, put in or left out; the length is that in the
    item. Exact for alignments that stay within ``len(item) // SPARE`` words of
    ``shift``. ``score[n, d]`` is the best score of a passage of ``n`` item words,
    ``LONG`` standing for more, that ends on diagonal ``d``: a word counts 1, an
    edit takes SPARE.
    """
    if len(item) < LONG or high - low < LONG - len(item) // SPARE:
        return False
    band = len(item) // SPARE
    width = 2 * band + 1
    score = np.full((LONG + 1, width), -1 << 20, np.int64)
    at = (np.arange(width) - band + shift) + np.arange(len(item))[:, None]
    inside = (at >= low) & (at < high)
    same = inside & (codes[np.clip(at, low, high - 1)] == item[:, None])
    if not _dense(same.any(1)):  # too few words, even if each might choose its diagonal
        return False
    gains = np.where(same, 1, np.where(inside, 1 - SPARE, -1 << 20))
    steps = SPARE * np.arange(width)
    for gain in gains:
        score[0] = 0
        kept = score + gain
        left_out = np.full_like(score, -1 << 20)  # the item's word has none in the document
        left_out[:, :-1] = score[:, 1:] + 1 - SPARE
        best = np.maximum(kept, left_out)
        score[1:] = best[:-1]
        score[LONG] = np.maximum(score[LONG], best[LONG])
        # Words of the document put in: along the diagonals, SPARE each.
        score = np.maximum.accumulate(score + steps, axis=1) - steps
        if (score[LONG] >= 0).any():
            return True
    return False


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id): the documents that hold an item or a passage of it.

    An item under several ids is given for each. Null and empty texts hold and
    are nothing; an item shorter than WINDOW words has to occur whole. Repeated
    rows of either table give one row. Other columns are ignored; empty tables
    give no rows.
    """
    spark = documents.sparkSession
    docs = spread(documents.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text"))
    blocks = _blocks(items)
    block, after = next(blocks, None), next(blocks, None)
    if block is None:
        return spark.createDataFrame([], "item_id bigint, doc_id bigint")
    if after is None:
        index = spark.sparkContext.broadcast(Index(block))
        return docs.mapInArrow(_scanner(index), "item_id bigint, doc_id bigint").distinct()
    with scratch(spark) as keep:
        words_ = written(docs.mapInArrow(_cut, "doc_id bigint, codes binary"), "words")
        found = []
        while block is not None:
            index = spark.sparkContext.broadcast(Index(block))
            rows = written(words_.mapInArrow(_scanner(index, cut=True), "item_id bigint, doc_id bigint").distinct(), "leaks")
            found.append(keep(rows))
            index.destroy()
            block, after = after, next(blocks, None)
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out.distinct()


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items, a bounded number at a time."""
    block, chars = [], 0
    for row in items.filter("item_id is not null and text is not null").select("item_id", "text").distinct().toLocalIterator():
        block.append((row[0], row[1]))
        chars += len(row[1])
        if len(block) >= BLOCK or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all texts of a batch, and where each text's begin."""
    tokens = [words(t) for t in batch.column("text").to_pylist()]
    return coded([w for t in tokens for w in t]), np.cumsum([0] + [len(t) for t in tokens])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 1000):
            part = batch.slice(low, 1000)
            codes, bounds = _tokens(part)
            rows = [codes[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "codes"])


def _scanner(index, cut: bool = False):
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                ids = part.column("doc_id").to_numpy()
                if cut:
                    rows = part.column("codes").to_pylist()
                    codes, bounds = np.frombuffer(b"".join(rows), np.uint64), np.cumsum([0] + [len(r) // 8 for r in rows])
                else:
                    codes, bounds = _tokens(part)
                found = sorted(index.value.scan(codes, bounds))
                if found:
                    rows = [(item, int(ids[d])) for number, d in found for item in index.value.ids[number]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    return scan
