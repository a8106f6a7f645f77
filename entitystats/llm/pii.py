"""Personal data in texts: candidates, boosted trees, calibrated thresholds.

Generators with high recall propose spans, all as built-in regular expressions
whose repetitions never back up, so a long text costs linear time. Candidates
that pass a kind's check are base spans and stay. The others are weighed by
boosted trees over features of their form and of the words before them. The
trees learn from counts of feature rows over all documents, a table bounded by
the features' ranges; a quarter of the documents is held back from the trees
and sets the threshold of each kind, the lowest at which the spans chosen there
are ``PRECISION`` right. A kind with fewer than ``LEAST_HELD`` of them takes the
margin of even odds. What failed a base check is never added, what lies inside
a base span teaches nothing, and of spans that overlap the one with the larger
margin stays. The model is applied as one SQL expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitystats.llm.boosting import BoostedTrees, fit
from entitystats.llm.common import any_text, col, fresh
from entitystats.session import settled

KINDS = ("email", "ip", "card", "phone", "secret")
#: Generators: kind, a text without which an address has no match, pattern. The first four are the base.
_LOCAL = "[A-Za-z0-9._%+-]"
GENERATORS = (
    ("email", "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", ".", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", "", r"[0-9](?:[\x20-]?[0-9]){12,}+"),
    ("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", "at", rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{{1,63}}+(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{{2,63}}+){{1,4}}+"),
    ("phone", "", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"),
    ("secret", "", r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9][A-Za-z0-9_+/-]{15,}+={0,2}+"),
)
BASE = 4
CUES = {"phone": "(?i)(?:tel|phone|call|fax|mobile|contact)", "secret": "(?i)(?:password|passwd|pwd|token|secret|api|key|auth)", "email": "(?i)mail", "card": "(?i)(?:card|visa|account)", "ip": "(?i)(?:host|address|server|ip)"}
CONTEXT_CHARS = 24
PRECISION = 0.95
#: Held-back candidates a kind needs for a threshold of its own.
LEAST_HELD = 20
ROUNDS = 12
FEATURES = ("kind", "generator", "length", "digits", "capitals", "marks", "hex", "cue", "assigned")

_SPAN = "struct<start:int,end:int,kind:int,generator:int,base:boolean,length:int,digits:int,capitals:int,marks:int,hex:int,cue:int,assigned:int>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return n.between(13, 19) & luhn(_digits(m))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _share(part: Column, whole: Column) -> Column:
    return F.floor(4 * F.length(part) / F.greatest(F.length(whole), F.lit(1))).cast("int")


def _spans(text: Column, has_digits: Column, number: int) -> Column:
    """All matches of a generator as an array of spans with features, in order."""
    kind, needed, pattern = GENERATORS[number]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(matches, F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("m"), F.char_length(gap).alias("skip"), F.right(gap, F.lit(CONTEXT_CHARS)).alias("before"))), lambda p: p["m"].isNotNull())

    def span(at: Column, p: Column) -> Column:
        m, before = p["m"], p["before"]
        return F.struct(
            (at + p["skip"]).alias("start"),
            (at + p["skip"] + F.char_length(m)).alias("end"),
            F.lit(KINDS.index(kind)).alias("kind"),
            F.lit(number).alias("generator"),
            (_passes(kind, m) if number < BASE else F.lit(False)).alias("base"),
            F.least(F.floor(F.length(m) / 4), F.lit(16)).cast("int").alias("length"),
            _share(_digits(m), m).alias("digits"),
            _share(F.regexp_replace(m, "[^A-Z]", ""), m).alias("capitals"),
            F.least(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.lit(4)).alias("marks"),
            m.rlike("^[0-9a-f]+$").cast("int").alias("hex"),
            before.rlike(CUES[kind]).cast("int").alias("cue"),
            before.rlike("[=:]\\s?[\"']?$").cast("int").alias("assigned"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        return F.struct((acc["at"] + p["skip"] + F.char_length(p["m"])).alias("at"), F.array_append(acc["out"], span(acc["at"], p).cast(_SPAN)).alias("out"))

    found = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    none = F.array().cast(f"array<{_SPAN}>")
    gate = (has_digits if kind != "email" else text.contains(needed)) & text.rlike(pattern)
    return F.when(gate, found).otherwise(none)


def candidates(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """``docs`` with an array ``out`` of candidate spans."""
    body, digits = fresh(docs, "body", "has_digits")
    texts = docs.withColumn(body, any_text(text_col)).withColumn(digits, F.col(body).rlike("[0-9]"))
    return texts.withColumn(out, F.concat(*[_spans(F.col(body), F.col(digits), n) for n in range(len(GENERATORS))])).drop(body, digits)


class Model:
    """Trees with a least margin for each kind; even odds where a kind has none."""

    def __init__(self, trees: BoostedTrees, least: dict[int, float]) -> None:
        self.trees, self.least = trees, least

    def spans(self, array: str) -> str:
        """SQL: the spans among the candidates of an array, none of which overlap unless both are base."""
        margin = self.trees.sql([f"c.{f}" for f in FEATURES])
        cases = " ".join(f"WHEN {k} THEN {m:.9f}D" if np.isfinite(m) else f"WHEN {k} THEN CAST('Infinity' AS DOUBLE)" for k, m in sorted(self.least.items()))
        least = f"CASE c.kind {cases} ELSE 0D END" if cases else "0D"
        base = f"filter({array}, c -> c.base)"
        free = f"filter({array}, c -> c.generator >= {BASE} AND NOT exists({base}, b -> b.start < c.end AND c.start < b.end))"
        rated = f"transform({free}, c -> named_struct('loss', -({margin}), 'least', {least}, 'span', c))"
        best = f"array_sort(filter({rated}, r -> -r.loss >= r.least))"
        apart = (
            f"aggregate({best}, CAST(array() AS array<{_SPAN}>), (kept, r) -> "
            "IF(exists(kept, b -> b.start < r.span.end AND r.span.start < b.end), kept, array_append(kept, r.span)))"
        )
        return f"concat({base}, {apart})"


def _right() -> Column:
    """The weak label: the base check, or for other forms a cue or an assignment before them.

    Candidates of another form inside a base span have none (null).
    """
    return F.when(F.col("c.generator") < BASE, F.col("c.base")).otherwise((F.col("c.cue") == 1) | (F.col("c.assigned") == 1))


def learn(found: DataFrame, spans: str) -> Model:
    """Fit trees and thresholds on the candidates of all documents.

    What comes to the driver is one row for each combination of features that
    occurs, fold and label: a few thousand at most, however many documents.
    """
    name = f"`{spans}`"
    clear = F.expr(f"filter({name}, c -> c.generator < {BASE} OR NOT exists({name}, b -> b.base AND b.start < c.end AND c.start < b.end))")
    each = found.select(F.explode(clear).alias("c"), (F.pmod(F.xxhash64(col(spans)), F.lit(4)) == 0).alias("held"))
    table = each.groupBy("held", _right().alias("right"), *[F.col(f"c.{f}").alias(f) for f in FEATURES]).count().collect()
    x = np.array([[r[f] for f in FEATURES] for r in table], float).reshape(-1, len(FEATURES))
    y, w = np.array([r["right"] for r in table], float), np.array([r["count"] for r in table], float)
    held = np.array([r["held"] for r in table], bool)
    order = np.lexsort(np.column_stack((x, y, held)).T) if len(x) else np.zeros(0, int)
    x, y, w, held = x[order], y[order], w[order], held[order]
    trees = fit(x[~held], y[~held], w[~held], rounds=ROUNDS)
    least: dict[int, float] = {}
    if held.any():
        margins = trees.margin(x)
        for kind in range(len(KINDS)):
            rows = held & (x[:, 0] == kind) & (x[:, 1] >= BASE)
            if w[rows].sum() < LEAST_HELD:
                continue
            least[kind] = np.inf
            for bound in np.unique(margins[rows]):
                taken = rows & (margins >= bound)
                if (w * y)[taken].sum() >= PRECISION * w[taken].sum():
                    least[kind] = float(bound) - 1e-6
                    break
    return Model(trees, least)


def _joined(spans: str, base_only: bool) -> Column:
    """``kind:start:end`` by kind and start, comma-joined."""
    kept = f"filter({spans}, s -> s.base)" if base_only else spans
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform(array_sort(array_distinct(transform({kept}, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end)))), s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')")


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of base spans, their digest, and all spans, for every row.

    Offsets are code points, ends exclusive. A null text is empty: counts 0, the
    digest of the empty string, no spans. Repeated rows are searched each by
    itself; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), any_text(text_col).alias("text"))
    found = settled(candidates(rows, "text", "spans").select("doc_id", "spans"))
    model = learn(found, "spans")
    chosen = found.withColumn("spans", F.expr(model.spans("spans")))
    counts = [F.expr(f"size(filter(spans, s -> s.base AND s.kind = {k}))").cast("long").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return chosen.select("doc_id", *counts, F.sha2(_joined("spans", True), 256).alias("base_sha256"), _joined("spans", False).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with every span replaced by its kind in brackets.

    All rows and columns stay. Overlapping spans are replaced as one, named
    after the first. Where there is a column ``length_col`` it gets the new
    number of characters of a changed text. A text without spans, or null, is
    left as it is.
    """
    (spans,) = fresh(docs, "spans")
    thin = settled(candidates(docs.select(col(text_col)), text_col, spans).select(spans))
    model = learn(thin, spans)
    found = candidates(docs, text_col, spans).withColumn(spans, F.expr(f"array_sort({model.spans(f'`{spans}`')})"))
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    text = f"`{text_col}`"
    step = (
        f"(a, s) -> IF(s.start < a.at, named_struct('out', a.out, 'at', greatest(a.at, s.end)), "
        f"named_struct('out', array_append(a.out, concat(substring({text}, a.at + 1, s.start - a.at), {names}[s.kind])), 'at', s.end))"
    )
    whole = F.expr(f"aggregate(`{spans}`, named_struct('out', CAST(array() AS array<string>), 'at', 0), {step}, a -> concat(array_join(a.out, ''), substring({text}, a.at + 1)))")
    hit = F.size(col(spans)) > 0
    changed = found.withColumn(text_col, F.when(hit, whole).otherwise(col(text_col)))
    if length_col in docs.columns:
        changed = changed.withColumn(length_col, F.when(hit, F.char_length(col(text_col)).cast(docs.schema[length_col].dataType)).otherwise(col(length_col)))
    return changed.select(*[col(c) for c in docs.columns])
