"""Cheapest repair of a conversation's turns, as a shortest path over whole numbers.

A repair keeps (K), reroles (R) or deletes (D) each row and may insert (I)
turns, so that the role initials that stay read ``(s?(ua)+)?``. Each edge of the
graph has one weight: its cost in the high digits and its letter in a low digit
of its own, three bits wide, whose place is the letter's place in the audit.
Audits shorter than the longest possible one end in zero digits. The least sum
of weights is then at once the cheapest repair and, of the cheapest, the one
whose audit comes first in ASCII order; nothing else is compared.

A conversation of any length is solved in slices. A slice is a table of least
weights from each state of the role pattern to each other one; tables of
neighbouring slices combine into one, so rows are dealt by range over all tasks,
however many belong to one conversation. Only the SHA-256 of a repaired text,
by its nature one chain, reads a conversation's rows in one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitystats.llm.common import col, fresh
from entitystats.session import join_per_key

#: The white space of the contract; all else is a character of the text.
BLANK_CHARS = " \t\n\x0b\x0c\r"
#: Digits of the audit letters; their order is that of ASCII.
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
BITS = 3
#: States of the role pattern: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("a", USER): ASSISTANT, ("u", ASSISTANT): USER}
ACCEPTED = (START, ASSISTANT)
#: Faults of a row.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Rows that one graph holds; longer slices combine tables.
GRAPH_ROWS = 64


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def most_inserts(self, rows: int) -> int:
        """No cheapest repair has more inserted turns than this.

        An inserted turn stands in a pair with another. Without both, the rest
        still fits the pattern, or fits it once a lone system turn goes too; if
        two deletions cost less than one insertion that is cheaper. Otherwise
        deleting every row bounds what insertions may cost.
        """
        if 2 * self.delete < self.insert:
            return 0
        return rows * self.delete // self.insert if self.insert > 0 else 2 * rows + 2


#: Least weights by (state before, state after, inserted turns).
Table = dict[tuple[int, int, int], int]


def _edges(initial: str, fault: int, costs: Costs) -> list[tuple[int, int, int, int]]:
    """(state before, state after, cost, digit) of each way to treat a row."""
    out = [(q, q, costs.delete, LETTERS["D"]) for q in range(4)]
    if fault in (BLANK, DUPLICATE):
        return out
    more = costs.truncated if fault == TRUNCATED else 0
    for (letter, before), after in STEPS.items():
        if letter == initial:
            out.append((before, after, costs.keep + more, LETTERS["K"]))
        if letter != "s":
            out.append((before, after, costs.rerole + more, LETTERS["R"]))
    return out


@lru_cache(maxsize=20_000)
def graph(rows: tuple[tuple[str, int], ...], costs: Costs, inserts: int) -> Table:
    """Least weights of the paths over a few rows, by the plain recurrence over its nodes in order.

    A node is (rows done, state, turns inserted); weights of a path with k
    inserted turns have len(rows) + k digits.
    """
    width = len(rows) + inserts
    unit = 1 << (BITS * width)
    out: Table = {}
    for begin in range(4):
        layer = {(begin, 0): 0}
        for done in range(len(rows) + 1):
            for k in range(inserts):
                digit = LETTERS["I"] << (BITS * (width - 1 - done - k))
                for (letter, before), after in STEPS.items():
                    if letter != "s" and (before, k) in layer:
                        weight = layer[before, k] + costs.insert * unit + digit
                        if weight < layer.get((after, k + 1), weight + 1):
                            layer[after, k + 1] = weight
            if done == len(rows):
                break
            following: dict[tuple[int, int], int] = {}
            edges = _edges(*rows[done], costs)
            for (state, k), weight in layer.items():
                place = BITS * (width - 1 - done - k)
                for before, after, cost, digit in edges:
                    if before == state:
                        total = weight + cost * unit + (digit << place)
                        if total < following.get((after, k), total + 1):
                            following[after, k] = total
            layer = following
        for (end, k), weight in layer.items():
            out[begin, end, k] = weight >> (BITS * (inserts - k))
    return out


def combined(left: Table, rows_left: int, right: Table, rows_right: int, inserts: int) -> Table:
    """The table of two slices that follow each other."""
    out: Table = {}
    for (a, m, k), w in left.items():
        for (m2, b, j), v in right.items():
            if m != m2 or k + j > inserts:
                continue
            digits = BITS * (rows_right + j)
            weight = (w << digits) + ((v >> digits) << (digits + BITS * (rows_left + k))) + (v & ((1 << digits) - 1))
            if weight < out.get((a, b, k + j), weight + 1):
                out[a, b, k + j] = weight
    return out


class Weights:
    """The table of rows that come one by one; halves of equal height are combined, as in a binary counter."""

    def __init__(self, costs: Costs, inserts: int) -> None:
        self.costs, self.inserts = costs, inserts
        self.open: list[tuple[str, int]] = []
        self.stack: list[tuple[Table, int]] = []

    def add(self, initial: str, fault: int) -> None:
        self.open.append((initial if initial in ("s", "u", "a") else "", fault))
        if len(self.open) == GRAPH_ROWS:
            self._close()

    def _close(self) -> None:
        self.put(graph(tuple(self.open), self.costs, self.inserts), len(self.open))
        self.open = []

    def put(self, table: Table, rows: int) -> None:
        self.stack.append((table, rows))
        while len(self.stack) > 1 and self.stack[-2][1] <= self.stack[-1][1]:
            self._merge()

    def _merge(self) -> None:
        (a, m), (b, n) = self.stack[-2:]
        self.stack[-2:] = [(combined(a, m, b, n, self.inserts), m + n)]

    def table(self) -> tuple[Table, int]:
        if self.open:
            self._close()
        while len(self.stack) > 1:
            self._merge()
        return self.stack[0] if self.stack else (graph((), self.costs, self.inserts), 0)


def least(table: Table, rows: int, inserts: int) -> tuple[int, str]:
    """Cost and audit of the least path from the start to an accepted state."""
    weight = min(w << (BITS * (inserts - k)) for (begin, end, k), w in table.items() if begin == START and end in ACCEPTED)
    digits = BITS * (rows + inserts)
    letters = format(weight & ((1 << digits) - 1), f"0{rows + inserts}o") if rows + inserts else ""
    return weight >> digits, letters.translate({48: None, 49: "D", 50: "I", 51: "K", 52: "R"})


# ---- rows ---------------------------------------------------------------------------------------


def _stood(text: Column) -> Column:
    """A text up to its last character that is not white space."""
    return F.rtrim(text, F.lit(BLANK_CHARS))


def prepared(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """Rows with a key per conversation that is never null, and a digest of role and text."""
    role, text = (F.coalesce(col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    copies = F.coalesce(col(copies_col).cast("long"), F.lit(0)) if copies_col else F.lit(1).cast("long")
    return rows.select(
        F.coalesce(F.concat(F.lit("c"), col(id_col).cast("string")), F.lit("")).alias("k"),
        col(turn_col).cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("h"),
        copies.alias("copies"),
    )


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h")]


def _with_first(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn counted together, each group marked if an earlier turn has its role and text."""
    bare = _stood(F.col("text"))
    thin = rows.select(
        "k", "turn", "role", "h", "copies",
        (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    thin = thin.groupBy("k", "turn", "role", "h", "blank", "truncated").agg(F.sum("copies").alias("copies"))
    firsts = thin.where("copies > 0").groupBy("k", "h").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first"))
    met = join_per_key(thin, firsts, ["k", "h"], "left")
    later = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return met.select("k", "turn", "role", "h", "blank", "truncated", "copies", F.coalesce(later, F.lit(False)).alias("later"))


_WEIGHT = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("inserts", pa.int32()), ("weight", pa.binary())])
_SLICE = pa.schema(
    [("k", pa.string()), ("part", pa.int64()), ("n", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
     ("low", pa.int64()), ("high", pa.int64()), ("distinct", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("weights", pa.list_(_WEIGHT))]
)
SLICE_SCHEMA = (
    "k string, part long, n long, blank long, duplicate long, truncated long, illegal long, low long, high long, distinct long, head string, tail string, "
    "weights array<struct<begin:int,end:int,inserts:int,weight:binary>>"
)
_LEGAL = {"su", "ua", "au"}


class _Slice:
    """What is known of consecutive rows of one conversation."""

    def __init__(self, key: str, costs: Costs, inserts: int) -> None:
        self.key, self.n, self.illegal, self.distinct = key, 0, 0, 0
        self.faults = [0, 0, 0, 0]
        self.low = self.high = self.head = self.tail = None
        self.weights = Weights(costs, inserts)

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if self.n and self.tail + initial not in _LEGAL:
            self.illegal += 1
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += 1
        self.head = initial if not self.n else self.head
        self.tail = initial
        self.n += 1
        self.faults[fault] += 1
        self.weights.add(initial, fault)

    def join(self, other: dict) -> None:
        """Take in the slice that follows."""
        if not other["n"]:
            return
        if self.n and self.tail + other["head"] not in _LEGAL:
            self.illegal += 1
        self.illegal += other["illegal"]
        self.distinct += other["distinct"] - (other["low"] is not None and other["low"] == self.high)
        self.low = other["low"] if self.low is None else self.low
        self.high = other["high"] if other["high"] is not None else self.high
        self.head = self.head if self.n else other["head"]
        self.tail = other["tail"]
        self.n += other["n"]
        for fault, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated")):
            self.faults[fault] += other[name]
        self.weights.put({(w["begin"], w["end"], w["inserts"]): int.from_bytes(w["weight"], "big") for w in other["weights"]}, other["n"])

    def record(self, part: int) -> dict:
        table, _ = self.weights.table()
        weights = [{"begin": a, "end": b, "inserts": k, "weight": w.to_bytes(-(-w.bit_length() // 8), "big")} for (a, b, k), w in table.items()]
        return {
            "k": self.key, "part": part, "n": self.n, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED], "illegal": self.illegal,
            "low": self.low, "high": self.high, "distinct": self.distinct, "head": self.head, "tail": self.tail, "weights": weights,
        }

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


def _slices(costs: Costs, cap: int):
    """Slices of sorted rows: k, turn, role initial, blank, truncated, copies, later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, open_slice, done = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for key, turn, initial, blank, truncated, copies, later in zip(*(c.to_pylist() for c in batch.columns)):
                if open_slice is None or open_slice.key != key:
                    if open_slice is not None:
                        done.append(open_slice.record(part))
                    open_slice = _Slice(key, costs, cap)
                for copy in range(copies):
                    fault = BLANK if blank else DUPLICATE if later or copy else TRUNCATED if truncated else SOUND
                    open_slice.add(turn, initial, fault)
            if len(done) > 1000:
                yield pa.RecordBatch.from_pylist(done, _SLICE)
                done = []
        if open_slice is not None:
            done.append(open_slice.record(part))
        if done:
            yield pa.RecordBatch.from_pylist(done, _SLICE)

    return run


class _Editor:
    """Applies an audit to rows that come in order; yields the role and text of what stays."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._fitting(), ""

    def _fitting(self) -> str:
        role = "assistant" if self.state == USER else "user"
        self.state = STEPS[role[0], self.state]
        return role

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = STEPS[role[0], self.state]
            yield role, text
        elif letter == "R":
            yield self._fitting(), text


REPORT_SCHEMA = "k string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPORT = pa.schema([("k", pa.string()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
ROWS_SCHEMA = "k string, position long, role string, text string"
_ROWS = pa.schema([("k", pa.string()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _conversations(batches: Iterable[pa.RecordBatch], costs: Costs, cap: int) -> Iterator[tuple]:
    """Of sorted slices and rows: (key, 0, slice, (cost, audit)), then (key, 1, role, text) per row that stays, then (key, 2, None, None)."""
    key = whole = editor = None
    for batch in batches:
        names = batch.schema.names
        kind, keys, copies, roles, texts = (batch.column(names.index(c)) for c in ("kind", "k", "copies", "role", "text"))
        slices = batch.column(names.index("slice"))
        for i in range(batch.num_rows):
            k = keys[i].as_py()
            if k != key:
                if key is not None:
                    yield from ((key, 1, *e) for e in editor.inserted())
                    yield key, 2, None, None
                key, whole, editor = k, _Slice(k, costs, cap), None
            if kind[i].as_py() == 0:
                whole.join(slices[i].as_py())
                continue
            if editor is None:
                path = least(*whole.weights.table(), cap)
                editor = _Editor(path[1])
                yield key, 0, whole, path
            n = copies[i].as_py()
            if n:
                role, text = roles[i].as_py(), texts[i].as_py()
                for _ in range(n):
                    yield from ((key, 1, *e) for e in editor.row(role, text))
    if key is not None:
        yield from ((key, 1, *e) for e in editor.inserted())
        yield key, 2, None, None


def _reports(costs: Costs, cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        whole, path, sha, lines = None, None, None, 0
        for key, what, a, b in _conversations(batches, costs, cap):
            if what == 0:
                whole, path, sha, lines = a, b, hashlib.sha256(), 0
            elif what == 1:
                sha.update((("\n" if lines else "") + a + ":" + b).encode())
                lines += 1
            else:
                cost, audit = path
                done.append({
                    "k": key, "gaps": whole.gaps(), "blank": whole.faults[BLANK], "duplicate": whole.faults[DUPLICATE], "truncated": whole.faults[TRUNCATED],
                    "illegal": whole.illegal, "cost": cost, "audit": audit, "repaired_sha256": sha.hexdigest(),
                })
                if len(done) >= 1000:
                    yield pa.RecordBatch.from_pylist(done, _REPORT)
                    done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, _REPORT)

    return run


def _kept_rows(costs: Costs, cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        position = 0
        for key, what, a, b in _conversations(batches, costs, cap):
            if what == 0:
                position = 0
            elif what == 1:
                done.append({"k": key, "position": position, "role": a, "text": b})
                position += 1
                if len(done) >= 1000:
                    yield pa.RecordBatch.from_pylist(done, _ROWS)
                    done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, _ROWS)

    return run


def _streams(rows: DataFrame, costs: Costs, inserts: int) -> DataFrame:
    """Slices of every conversation followed by its rows in order, sorted within partitions."""
    thin = _with_first(rows).select("k", "turn", "role", "h", "blank", "truncated", "copies", "later")
    ordered = thin.repartitionByRange("k", *_order()).sortWithinPartitions("k", *_order())
    ordered = ordered.select("k", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "truncated", "copies", "later")
    slices = ordered.mapInArrow(_slices(costs, inserts), SLICE_SCHEMA)
    packed = F.struct(*[c for c in slices.columns if c not in ("k", "part")])
    heads = slices.select("k", F.lit(0).alias("kind"), "part", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("h"), F.lit(0).cast("long").alias("copies"), F.lit("").alias("text"), packed.alias("slice"))
    tails = rows.select("k", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("part"), "turn", "role", "h", "copies", "text", F.lit(None).cast(heads.schema["slice"].dataType).alias("slice"))
    both = heads.unionByName(tails).repartition("k").sortWithinPartitions("k", "kind", "part", *_order())
    return both.select("k", "kind", "copies", "role", "text", "slice")


def _named(found: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """The conversation's own id in place of its key."""
    kind = rows.schema[id_col].dataType
    own = F.when(F.col("k") != "", F.substring(F.col("k"), F.lit(2), F.length("k"))).cast(kind)
    (name,) = fresh(found.drop("k"), id_col)
    return found.select(own.alias(name), *[c for c in found.columns if c != "k"])


def repair_reports(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, costs: Costs = Costs(), inserts: int | None = None) -> DataFrame:
    """One row per conversation: its faults, the cheapest repair's cost and audit, and the digest of the repaired text.

    ``copies_col`` says how many times a row stands (0: not at all, though its
    conversation is still reported). ``inserts`` bounds the turns that may be
    inserted; left out, it is 0 where ``Costs.most_inserts`` shows that no
    cheapest repair has any, and must be given for other costs.

    Null ids form one conversation. A null role or text is one space. Rows are
    ordered by turn, nulls first, and within a turn by role and a digest of
    role and text; equal rows are interchangeable. An empty role has no legal
    initial. Texts may be of any length, an empty table gives no rows, columns
    not named are not read.
    """
    found = _streams(prepared(rows, id_col, turn_col, role_col, text_col, copies_col), costs, _bound(costs, inserts))
    return _named(found.mapInArrow(_reports(costs, _bound(costs, inserts)), REPORT_SCHEMA), rows, id_col)


def repaired_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, costs: Costs = Costs(), inserts: int | None = None) -> DataFrame:
    """The repaired conversations: id, position from 0, role, text. Parameters and odd cases as in ``repair_reports``."""
    found = _streams(prepared(rows, id_col, turn_col, role_col, text_col, copies_col), costs, _bound(costs, inserts))
    return _named(found.mapInArrow(_kept_rows(costs, _bound(costs, inserts)), ROWS_SCHEMA), rows, id_col)


def _bound(costs: Costs, inserts: int | None) -> int:
    if inserts is None:
        if costs.most_inserts(1 << 40):
            raise ValueError("with these costs insertions may pay: state how many")
        return 0
    return inserts


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by the checksum of ``conv_id:turn``; ``copies`` says how often a row stands."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    case = F.crc32(key) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        "conv_id", "turn",
        F.when(case == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(case == 1, F.lit("")).when(case == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"),
    )
