"""Benchmark items found in documents, copied or nearly so.

Words (lower-cased letters and digits, split at white space and ASCII
punctuation) are the symbols. The CGK embedding walks over a window: at step
``j`` it writes the word under the pointer and then moves on or stays, as a
random bit of that word for step ``j`` says. Words edited in one of two windows
change few of the written symbols, so edit distance becomes Hamming distance.
Bit sampling hashes a few written symbols to a key; repeated choices of steps,
over independent walks, bring the recall up to its target. Windows of the
documents start at every ``STRIDE``-th word, windows of the items at every
word, so the two are aligned wherever an item occurs.

A key that meets gives a document, an item and an alignment. There the least
edit distance between the whole item and any stretch of the document is
computed exactly; the item is found if it is at most a fifth of the item's words.

Items too short for a walk are found through the pieces that an edit can't all
touch: one of ``edits + 1`` pieces stays as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitystats.llm.common import any_text, col, kept

STRIDE = 4
#: Window classes: steps of the walk; items take every walk their words allow.
WALKS = (10, 24)
#: Items of fewer words are found through their pieces.
PIECES_BELOW = 27
#: Independent walks, choices of steps for each walk and class, steps in a choice.
REPEATS, CHOICES, SAMPLED = 2, 6, (4, 5)
#: Edits allowed for each word of an item.
EDITS = 0.2
#: Items whose signatures are held at once.
BLOCK_ITEMS = 20_000
#: Words a worker remembers; windows hashed at once.
MAX_WORDS, AT_ONCE = 300_000, 1 << 15
_FILTER_BITS = 20

_SEPARATE = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word) | 1
        if len(self) < MAX_WORDS:
            self[word] = value
        return value


def word_ids(text: str, known: dict[bytes, int] | None = None) -> np.ndarray:
    """A 64-bit number for each word of a text, never 0; ``known`` remembers words."""
    words = text.encode("utf-8", "surrogatepass").translate(_SEPARATE).split()
    return np.fromiter(map((_Words() if known is None else known).__getitem__, words), np.uint64, len(words))


def _mixed(words: np.ndarray, repeat: int) -> np.ndarray:
    """Random bits of each word: bit ``j`` moves the pointer at step ``j``."""
    x = words * np.uint64(0x9E3779B97F4A7C15 + 2 * repeat)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _choices() -> list[list[list[np.ndarray]]]:
    """Steps sampled, by class and repeat: one of each equal part of the walk, the same everywhere.

    Neighbouring steps often write one word twice, so steps lie apart.
    """
    rng = np.random.default_rng(7)
    chosen = []
    for walk, sampled in zip(WALKS, SAMPLED):
        edges = np.linspace(0, walk, sampled + 1).astype(int)
        chosen.append([[np.array([rng.integers(a, b) for a, b in zip(edges, edges[1:])]) for _ in range(CHOICES)] for _ in range(REPEATS)])
    return chosen


_CHOSEN = _choices()


def _keys(padded: np.ndarray, starts: np.ndarray, walk: int, classes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(table number, a key for each start); ``padded`` has ``walk`` zeros at its end."""
    for repeat in range(REPEATS):
        bits = _mixed(padded, repeat)
        at = starts.copy()
        written = np.empty((walk, len(starts)), np.uint64)
        for step in range(walk):
            written[step] = padded[at]
            at += ((bits[at] >> np.uint64(step)) & np.uint64(1)).astype(at.dtype)
        for c in classes:
            for k, steps in enumerate(_CHOSEN[c][repeat]):
                table = (c * REPEATS + repeat) * CHOICES + k
                key = np.full(len(starts), 0x100000001B3 + table, np.uint64)
                for s in steps:
                    key = (key ^ written[s]) * np.uint64(0x9FB21C651E98DF25)
                    key ^= key >> np.uint64(28)
                yield table, key


def allowed(words: int) -> int:
    return int(EDITS * words)


class Met:
    """Keys of items, looked up by keys of documents."""

    def __init__(self, keys: np.ndarray, owners: np.ndarray, offsets: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners, self.offsets = keys[order].astype(np.uint64), owners[order], offsets[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def at(self, starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, item, offset) wherever the key of a start is one of an item."""
        hit = np.flatnonzero(self.filter[self._slot(keys)])
        starts, keys = starts[hit], keys[hit]
        first = np.searchsorted(self.keys, keys, "left")
        count = np.searchsorted(self.keys, keys, "right") - first
        which = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(starts, count), self.owners[which], self.offsets[which]


class Items:
    """Signatures of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.numbers = _Words()
        self.words = [word_ids(t or "", self.numbers) for _, t in items]
        keys, owners, offsets = [], [], []
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for n, words in enumerate(self.words):
            for c in self._fits(words):
                starts = np.arange(len(words) - WALKS[c] + 1)
                padded = np.concatenate((words, np.zeros(WALKS[c], np.uint64)))
                for _, key in _keys(padded, starts, WALKS[c], [c]):
                    keys.append(key)
                    owners.append(np.full(len(starts), n))
                    offsets.append(starts)
            if 0 < len(words) < PIECES_BELOW:
                size = len(words) // (allowed(len(words)) + 1)
                for piece in range(allowed(len(words)) + 1):
                    pieces.setdefault(size, []).append((self._gram(words[piece * size :], size)[0].item(), n, piece * size))
        self.walked = Met(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, owners, offsets)))
        self.pieces = {size: Met(np.array([k for k, _, _ in found], np.uint64), np.array([n for _, n, _ in found]), np.array([o for _, _, o in found])) for size, found in pieces.items()}
        self.classes = sorted({c for w in self.words for c in self._fits(w)})
        self.masks = [self._masks(w) for w in self.words]

    @staticmethod
    def _fits(words: np.ndarray) -> list[int]:
        """Window classes of an item: every walk its words allow."""
        return [c for c, walk in enumerate(WALKS) if len(words) >= max(PIECES_BELOW, walk + STRIDE - 1)]

    @staticmethod
    def _gram(words: np.ndarray, size: int) -> np.ndarray:
        """A key of ``size`` words from every place on."""
        n = max(0, len(words) - size + 1)
        key = np.full(n, size, np.uint64)
        for k in range(size):
            key = (key ^ words[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(28)
        return key

    @staticmethod
    def _masks(words: np.ndarray) -> dict[int, int]:
        masks: dict[int, int] = {}
        for i, w in enumerate(words.tolist()):
            masks[w] = masks.get(w, 0) | 1 << i
        return masks

    def distance(self, n: int, stretch: list[int]) -> int:
        """Least edits that turn the item into any part of ``stretch`` (bit-parallel)."""
        m, masks = len(self.words[n]), self.masks[n]
        top, full = 1 << (m - 1), (1 << m) - 1
        plus, minus, score, best = full, 0, m, m
        for w in stretch:
            eq = masks.get(w, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | (~(xh | plus) & full)
            mh = plus & xh
            score += bool(ph & top) - bool(mh & top)
            ph, mh = (ph << 1) & full, (mh << 1) & full
            plus = mh | (~(xv | ph) & full)
            minus = ph & xv
            if score < best:
                best = score
        return best

    def candidates(self, words: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, item, offset) where a key of the padded words meets an item's key."""
        if self.classes:
            walk = WALKS[self.classes[-1]]
            for part in range(0, len(begins), AT_ONCE):
                starts = begins[part : part + AT_ONCE]
                lo, hi = starts[0], starts[-1] + walk + 1
                for _, key in _keys(words[lo:hi], starts - lo, walk, self.classes):
                    yield self.walked.at(starts, key)
        for size, met in self.pieces.items():
            grams = self._gram(words, size)
            yield met.at(np.arange(len(grams)), grams)

    def search(self, texts: list[str]) -> list[dict[int, int]]:
        """For each text the items found in it, with their edits."""
        walk = max(WALKS)
        gap = np.zeros(walk + 1, np.uint64)
        parts, bounds, at = [], [], 0
        for text in texts:
            words = word_ids(text, self.numbers)
            parts += [words, gap]
            bounds.append((at, at + len(words)))
            at += len(words) + len(gap)
        if not parts:
            return []
        words = np.concatenate(parts)
        firsts, ends = np.array([b for b, _ in bounds]), np.array([e for _, e in bounds])
        begins = np.concatenate([np.arange(b, e, STRIDE) for b, e in bounds]) if bounds else np.zeros(0, np.int64)
        met = [np.stack(x, axis=1) for x in self.candidates(words, begins) if len(x[0])]
        out: list[dict[int, int]] = [{} for _ in texts]
        if not met:
            return out
        met = np.concatenate(met)
        doc = np.searchsorted(firsts, met[:, 0], "right") - 1
        # alignments a few words apart are one: the stretch that is compared has slack on both sides
        slack = np.array([max(1, allowed(len(w))) for w in self.words])[met[:, 1]]
        begin = met[:, 0] - met[:, 2]
        tried = np.unique(np.stack((doc, met[:, 1], begin // slack), axis=1), axis=0)
        now, listed = -1, []
        for d, n, block in tried.tolist():
            if d != now:
                now, base, end = d, int(firsts[d]), int(ends[d])
                listed = words[base:end].tolist()
            size = len(self.words[n])
            edits, step = allowed(size), max(1, allowed(size))
            best = out[d].get(n)
            if best == 0:
                continue
            stretch = listed[max(0, block * step - edits - base) : block * step + step + size + edits - base]
            if sum(map(self.masks[n].__contains__, stretch)) < size - edits:
                continue
            found = self.distance(n, stretch)
            if found <= edits and (best is None or found < best):
                out[d][n] = found
        return [{n: e for n, e in x.items()} for x in out]


def _items(block: tuple[tuple[int, str], ...]) -> Items:
    return kept(("items", block), lambda: Items(list(block)))


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = BLOCK_ITEMS) -> Iterator[tuple[tuple[int, str], ...]]:
    """The benchmark in blocks of bounded size; null and wordless items never occur anywhere."""
    held: list[tuple[int, str]] = []
    rows = benchmark.select(col(id_col).cast("long"), col(text_col).cast("string")).where(col(text_col).isNotNull()).distinct()
    for item, text in rows.toLocalIterator():
        held.append((item, text))
        if len(held) == size:
            yield tuple(sorted(held, key=repr))
            held = []
    if held:
        yield tuple(sorted(held, key=repr))


def _finder(block: tuple[tuple[int, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(block)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out = []
            for at in range(0, batch.num_rows, 1000):
                texts = batch.column(1).slice(at, 1000).to_pylist()
                for key, found in zip(keys[at : at + 1000], items.search(texts)):
                    out += [(key, items.ids[n], edits, 1 - edits / len(items.words[n])) for n, edits in sorted(found.items())]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["doc_id", "item_id", "edits", "similarity"])

    return run


FOUND = "doc_id long, item_id long, edits int, similarity double"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, similarity) for every item found in a document.

    ``edits`` is the least number of word edits, ``similarity`` one minus its
    share of the item's words, at least 0.8. Null texts hold nothing; repeated
    documents are reported each by itself; of items that repeat an id the
    nearest counts. The documents are read once for each block of items.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), any_text(text_col).alias("text"))
    found = None
    for block in blocks(benchmark):
        part = rows.mapInArrow(_finder(block), FOUND)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], FOUND) if found is None else found


def _clean(block: tuple[tuple[int, str], ...]):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = _items(block)
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            yield pd.Series([not x for at in range(0, len(texts), 1000) for x in items.search(texts[at : at + 1000])], dtype=bool)

    return run


def without_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, in which no benchmark item is found."""
    for block in blocks(benchmark):
        docs = docs.where(F.pandas_udf(_clean(block), "boolean", F.PandasUDFType.SCALAR_ITER)(any_text(text_col)))
    return docs
