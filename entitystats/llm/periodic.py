"""Periodic runs of words: stretches that repeat with some period.

A run is a maximal stretch whose words are equal ``period`` words apart, of at
least ``least`` words and twice its smallest period. Runs are found at dyadic
scales. At scale B a text is cut into blocks of B words, and every block is
looked for at the distances 2B to 4B - 1 behind it (1 to 3 at scale 1). A run
with such a period holds a whole block that occurs again one period later, so
no run is missed. Where a block occurs is read off the sums of squared
differences between the codes of its words and those of the text behind it,
which are correlations, computed for all blocks of a scale at once by number
theoretic transforms. Codes are small enough for every sum to stay below the
modulus: a sum is zero if and only if all codes agree. Words that share a code
are told apart when the distances, as seeds, are checked and extended word by
word.

Documents are handled together, many in one array, longest first, so that the
ones long enough for a scale are its front part.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from entitystats.llm.common import any_text, col

#: Modulus 7 * 2**20 + 1 of the transforms: 64 products of two residues stay below 2**53, where floating point is exact.
MODULUS = 7 * (1 << 20) + 1
#: A generator of its multiplicative group.
GENERATOR = 3
RADIX = 64
#: Largest transform the modulus allows; longer blocks are looked for by their front part.
MAX_SIZE = 1 << 20
#: Words handled together, unless one document alone has more.
BATCH_WORDS = 1 << 17
#: Numbers in one transformed tile.
TILE = 1 << 17

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LATE_SPACE = re.compile(r"[\x1c-\x1f]")

#: Rewrites a document's words before the search, given its id.
Rewrite = Callable[[int | None, list[str]], list[str]]


def words_of(text: str) -> list[str]:
    return text.split() if text.isascii() and not _LATE_SPACE.search(text) else _WORD.findall(text)


# ---- transforms ---------------------------------------------------------------------------------


def _reduced(x: np.ndarray) -> np.ndarray:
    """Residues in place; exact for whole numbers below 2**53, within 2 of the range [0, MODULUS]."""
    t = np.floor(x * (1.0 / MODULUS))
    t *= MODULUS
    x -= t
    return x


@lru_cache(maxsize=4096)
def _powers(root: int, rows: int, columns: int) -> np.ndarray:
    """root ** (i * j) for each row i and column j."""
    base = [1]
    for _ in range(rows * columns):
        base.append(base[-1] * root % MODULUS)
    return np.array(base, np.float64)[np.outer(np.arange(rows), np.arange(columns))]


def _root(size: int, inverse: bool) -> int:
    root = pow(GENERATOR, (MODULUS - 1) // size, MODULUS)
    return pow(root, MODULUS - 2, MODULUS) if inverse else root


def _parts(size: int) -> tuple[int, int]:
    """A size as a first radix and what remains."""
    first = min(RADIX, 1 << ((size.bit_length()) // 2))
    return first, size // first


@lru_cache(maxsize=64)
def order(size: int) -> np.ndarray:
    """The frequency at each place of a transform's result."""
    if size <= RADIX:
        return np.arange(size)
    first, rest = _parts(size)
    return (np.arange(first)[:, None] + first * order(rest)[None, :]).ravel()


def forward(x: np.ndarray, size: int) -> np.ndarray:
    """Transform of the columns of ``x``, zeros below them, in the order of ``order``.

    ``x`` has size or size / 4 rows; the transform has ``size``.
    """
    n, width = x.shape
    if size <= RADIX:
        return _reduced(_powers(_root(size, False), size, n) @ x)
    first, rest = _parts(size)
    held = n // rest
    y = _reduced(_powers(_root(first, False), first, held) @ x.reshape(held, rest * width)).reshape(first, rest, width)
    y *= _powers(_root(size, False), first, rest)[:, :, None]
    _reduced(y)
    if rest <= RADIX:
        z = _reduced(np.matmul(_powers(_root(rest, False), rest, rest), y))
    else:
        z = np.stack([forward(y[k], rest) for k in range(first)])
    return z.reshape(size, width)


def backward(x: np.ndarray, size: int, wanted: int) -> np.ndarray:
    """The first ``wanted`` rows (size or size / 2) whose transform ``x`` is, times ``size``."""
    width = x.shape[1]
    if size <= RADIX:
        return _reduced(_powers(_root(size, True), wanted, size) @ x)
    first, rest = _parts(size)
    y = x.reshape(first, rest, width)
    if rest <= RADIX:
        z = _reduced(np.matmul(_powers(_root(rest, True), rest, rest), y))
    else:
        z = np.stack([backward(y[k], rest, rest) for k in range(first)])
    z *= _powers(_root(size, True), first, rest)[:, :, None]
    _reduced(z)
    held = wanted // rest
    return _reduced(_powers(_root(first, True), held, first) @ z.reshape(first, rest * width)).reshape(wanted, width)


@lru_cache(maxsize=64)
def _scale_plan(block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """For blocks of this size: where the opposite frequencies lie, shifts by one and two blocks, and 1 / size."""
    size = 4 * block
    at = order(size)
    place = np.empty(size, np.int64)
    place[at] = np.arange(size)
    opposite = place[(-at) % size]
    # a shift by a quarter of the transform multiplies frequency k by a power of a fourth root of one
    fourth = _root(4, False)
    turns = np.array([pow(fourth, k, MODULUS) for k in range(4)], np.float64)
    return opposite, turns[at % 4][:, None], turns[(2 * at) % 4][:, None], float(pow(size, MODULUS - 2, MODULUS))


def _zero_sums(pattern: np.ndarray, windows: list[np.ndarray], own: np.ndarray, sums: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each sum of squared differences that is zero.

    ``pattern`` and ``windows`` are transforms of blocks, one a column, and of
    the three blocks each is looked for in; ``own`` and ``sums`` are the sums of
    squares of the blocks, and of the codes they are laid upon.
    """
    opposite, one, two, unit = _scale_plan(block)
    w = windows[1] * one
    w += windows[2] * two
    w += windows[0]
    _reduced(w)
    w *= pattern[opposite]
    _reduced(w)
    cross = backward(w, 4 * block, 4 * block if block == 1 else 2 * block)[: len(sums)]
    cross *= unit
    _reduced(cross)
    total = own[None, :] + sums - 2 * cross
    total -= MODULUS * np.rint(total * (1.0 / MODULUS))
    return np.nonzero(np.abs(total) < 0.5)


def matches(codes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of blocks, and distances, at which a block's codes occur again behind it.

    Distances are 2 to 4 blocks, the last excluded; 1 to 3 for blocks of one.
    The sum of squared differences is computed exactly. Of blocks beyond the
    largest transform only the front is looked for.
    """
    front = min(block, MAX_SIZE // 4)
    times = block // front
    skip = 1 if block == 1 else 2
    distances = 3 if block == 1 else 2 * front
    count = len(codes) // block
    padded = np.zeros((count + 8) * block)
    padded[: len(codes)] = codes
    squares = np.concatenate(([0.0], np.cumsum(padded * padded)))
    squares = squares[front:] - squares[:-front]  # at each place, of the next ``front`` codes
    tiles = padded.reshape(-1, front)
    rows = max(1, TILE // (4 * front))
    found_at, found_distance = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin in range(0, count, rows):
        n = min(rows, count - begin)
        blocks = begin + np.arange(n)
        f = forward(np.ascontiguousarray(tiles[begin : begin + n + 4].T), 4 * front) if times == 1 else None
        for piece in range(times):
            ahead = skip * block + 2 * front * piece
            if f is None:
                pattern, *windows = (forward(np.ascontiguousarray(tiles[blocks * times + k].T), 4 * front) for k in (0, *(ahead // front + np.arange(3))))
            else:
                pattern, windows = f[:, :n], [f[:, skip + k : skip + k + n] for k in range(3)]
            place = np.arange(distances)[:, None] + (block * blocks + ahead)[None, :]
            d, r = _zero_sums(pattern, windows, squares[block * blocks], squares[place], front)
            found_at.append((begin + r) * block)
            found_distance.append(d + ahead)
    return np.concatenate(found_at), np.concatenate(found_distance)


# ---- runs ---------------------------------------------------------------------------------------


class _Known:
    """Runs found so far, for the question which of them covers a stretch."""

    def __init__(self) -> None:
        self.starts = np.zeros(0, np.int64)
        self.ends = np.zeros(0, np.int64)
        self.periods = np.zeros(0, np.int64)
        self._index()

    def _index(self) -> None:
        at = np.argsort(self.starts, kind="stable")
        self.starts, self.ends, self.periods = self.starts[at], self.ends[at], self.periods[at]
        reach = np.maximum.accumulate(self.ends) if len(at) else self.ends
        # the run that reaches farthest among those that begin no later
        new = np.concatenate(([True], self.ends[1:] > reach[:-1])) if len(at) else np.zeros(0, bool)
        self.farthest = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) if len(at) else np.zeros(0, np.int64)

    def add(self, starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> None:
        self.starts = np.concatenate((self.starts, starts))
        self.ends = np.concatenate((self.ends, ends))
        self.periods = np.concatenate((self.periods, periods))
        self._index()

    def repeats(self, starts: np.ndarray, ends: np.ndarray, distances: np.ndarray) -> np.ndarray:
        """Whether each stretch lies in a run whose period divides the distance.

        A stretch at least twice as long as the distance, or a block with its
        repetition, lies in no two runs with periods up to half the distance:
        they would overlap by both their periods, and be one.
        """
        if not len(self.starts):
            return np.zeros(len(starts), bool)
        at = np.searchsorted(self.starts, starts, "right") - 1
        run = self.farthest[np.maximum(at, 0)]
        return (at >= 0) & (self.ends[run] >= ends) & (distances % self.periods[run] == 0)


def _agreeing(ids: np.ndarray, start: np.ndarray, distance: np.ndarray, low: np.ndarray, high: np.ndarray, step: int, forwards: bool) -> np.ndarray:
    """How many words from ``start`` on (or before it) equal those ``distance`` later, inside [low, high)."""
    length = np.zeros(len(start), np.int64)
    active = np.arange(len(start))
    reach = np.arange(step)
    per = max(1, TILE // step)
    while len(active):
        left = []
        for cut in range(0, len(active), per):
            some = active[cut : cut + per]
            base = start[some] + length[some] if forwards else start[some] - length[some] - 1
            i = base[:, None] + reach if forwards else base[:, None] - reach
            j = i + distance[some][:, None]
            inside = (i >= low[some][:, None]) & (j < high[some][:, None])
            same = inside & (ids[np.where(inside, i, 0)] == ids[np.where(inside, j, 0)])
            whole = same.all(axis=1)
            length[some] += np.where(whole, step, same.argmin(axis=1))
            left.append(some[whole])
        active = np.concatenate(left)
    return length


def find_runs(ids: np.ndarray, bounds: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of every run in documents laid end to end, longest document first.

    ``bounds`` are the places where documents begin, and the end of the last.
    """
    known = _Known()
    sizes = np.diff(bounds)
    block = 1
    while True:
        held = int(np.searchsorted(-sizes, -max(least, 4 * block if block > 1 else 2), "right"))
        if not held:
            break
        part = ids[: bounds[held]]
        colours = int(((MODULUS - 1) / min(block, MAX_SIZE // 4)) ** 0.5)
        # words get codes anew at every scale, so that two that share one part at another
        codes = (((part + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 ^ (2 * block)) >> np.uint64(24)) % np.uint64(colours)).astype(np.float64)
        at, distance = matches(codes, block)
        document = np.searchsorted(bounds, at, "right") - 1
        fits = at + block + distance <= bounds[document + 1]
        at, distance = at[fits], distance[fits]
        for low, high in ((1, 2), (2, 4)) if block == 1 else ((2 * block, 4 * block),):
            mine = (distance >= low) & (distance < high)
            _extend(ids, bounds, known, at[mine], distance[mine], block, least)
        block *= 2
    return known.starts, known.ends, known.periods


def _holding(ids: np.ndarray, at: np.ndarray, distance: np.ndarray, block: int) -> np.ndarray:
    """Whether the words of each block equal those ``distance`` later."""
    out, reach, per = np.zeros(len(at), bool), np.arange(block), max(1, TILE // block)
    for cut in range(0, len(at), per):
        i = at[cut : cut + per, None] + reach
        out[cut : cut + per] = (ids[i] == ids[i + distance[cut : cut + per, None]]).all(axis=1)
    return out


def _extend(ids: np.ndarray, bounds: np.ndarray, known: _Known, at: np.ndarray, distance: np.ndarray, block: int, least: int) -> None:
    """Check and extend seeds; what is long enough, and no repetition of a shorter period, becomes known."""
    new = ~known.repeats(at, at + block + distance, distance)
    at, distance = at[new], distance[new]
    same = _holding(ids, at, distance, block)
    at, distance = at[same], distance[same]
    by_place = np.lexsort((at, distance))
    at, distance = at[by_place], distance[by_place]
    document = np.searchsorted(bounds, at, "right") - 1
    # neighbouring blocks at one distance are one seed
    head = np.ones(len(at) + 1, bool)
    head[1:-1] = (at[1:] != at[:-1] + block) | (distance[1:] != distance[:-1]) | (document[1:] != document[:-1])
    first, last = at[head[:-1]], at[head[1:]] + block
    distance, document = distance[head[:-1]], document[head[:-1]]
    low, high = bounds[document], bounds[document + 1]
    starts = first - _agreeing(ids, first, distance, low, high, block, False)
    ends = last + _agreeing(ids, last, distance, low, high, block, True) + distance
    long_enough = ends - starts >= np.maximum(least, 2 * distance)
    starts, ends, distance = np.unique(np.stack((starts, ends, distance))[:, long_enough], axis=1)
    new = ~known.repeats(starts, ends, distance)
    known.add(starts[new], ends[new], distance[new])


# ---- documents ----------------------------------------------------------------------------------

RUN_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words, those of each run after its first period left out."""
    if not runs:
        return " ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return " ".join(itertools.compress(words, keep.tolist()))


def _searched(keys: list, texts: list[list[str]], least: int) -> pa.RecordBatch:
    """Runs of some documents, in the order given."""
    by_length = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    numbers: defaultdict[str, int] = defaultdict(itertools.count().__next__)
    bounds = np.concatenate(([0], np.cumsum([len(texts[i]) for i in by_length]))).astype(np.int64)
    ids = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(texts[i] for i in by_length)), np.int64, int(bounds[-1]))
    starts, ends, periods = find_runs(ids, bounds, least)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    owners = np.searchsorted(bounds, starts, "right") - 1
    for d, s, e, p in zip(owners.tolist(), starts.tolist(), ends.tolist(), periods.tolist()):
        found[by_length[d]].append((s - int(bounds[d]), e - s, p))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found], pa.list_(_RUN)),
            pa.array([_collapsed(t, runs) for t, runs in zip(texts, found)], pa.string()),
        ],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def _search(least: int, rewrite: Rewrite | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        texts: list[list[str]] = []
        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                words = words_of(text.as_py())
                if rewrite is not None:
                    words = rewrite(key.as_py(), words)
                keys.append(key.as_py())
                texts.append(words)
                held += len(words)
                if held >= BATCH_WORDS:
                    yield _searched(keys, texts, least)
                    keys, texts, held = [], [], 0
        if keys:
            yield _searched(keys, texts, least)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, rewrite: Rewrite | None = None) -> DataFrame:
    """Per document: doc_id, n_words, its runs by start, then period, and the text with each run cut to one period.

    Words are runs of characters other than ASCII white space; the collapsed
    text joins those that stay by one space. A null text has no words, an empty
    table gives no rows, repeated rows and null ids are searched each by itself,
    columns not named are not read. A text of any length is searched whole. No
    shuffle takes place.
    """
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), any_text(text_col).alias("text"))
    return rows.mapInArrow(_search(least, rewrite), RUN_SCHEMA)
