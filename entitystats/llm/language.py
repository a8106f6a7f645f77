"""Language of whole texts by cross-parsing against labelled text.

For each language a suffix automaton of a bounded sample of its labelled text
recognises every substring of the sample. A text is parsed greedily: each
phrase is the longest match from where the last phrase ended. Phrases times the
binary logarithm of the longest sample's length, divided by the number of
characters, is the cross entropy in bits a character; the language with the
least wins. Every language pays this one price for a phrase, so a label with
little text gains nothing from it.

Texts are parsed in pieces of a fixed length, so a very long text costs no
memory, and many pieces are parsed side by side, one character a step.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitystats.llm.common import col, fresh, kept

#: The sample the languages are learned from: distinct documents a language, and characters of each.
SAMPLE_DOCS = 100
SAMPLE_CHARS = 400
#: Parts of a language that are searched for the sample side by side, in turn; the last is the whole language.
PARTS = (256, 16, 1)
#: Characters of a piece; every piece begins a new phrase.
PIECE_CHARS = 1024
#: Pieces that are parsed side by side.
SIDE_BY_SIDE = 2048
#: Texts that are folded at once.
TOGETHER = 250
#: Cells of the table of frequent letters; transitions by rarer letters are looked up in a sorted list.
DENSE_CELLS = 1 << 24
UNKNOWN = "und"


def automaton(text: str, codes: dict[str, int]) -> np.ndarray:
    """The suffix automaton of a text: an array with, for each state, a dictionary of the states that follow, by character code."""
    nexts: list[dict[int, int]] = [{}]
    links, lengths, last = [-1], [0], 0
    for ch in text:
        c = codes[ch]
        cur = len(nexts)
        nexts.append({})
        links.append(0)
        lengths.append(lengths[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = links[p]
        if p >= 0:
            q = nexts[p][c]
            if lengths[q] == lengths[p] + 1:
                links[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = links[p]
                links[q] = links[cur] = clone
        last = cur
    return np.array(nexts, dtype=object)


class Parser:
    """Counts phrases of texts against each language's sample."""

    def __init__(self, samples: list[tuple[str, str]]) -> None:
        self.langs = [lang for lang, _ in samples]
        # codes are numbered from the most frequent letter on; the last one stands for all others
        letters = [ch for ch, _ in sorted(Counter(ch for _, text in samples for ch in text).items(), key=lambda x: (-x[1], x[0]))]
        codes = {ch: i for i, ch in enumerate(letters)}
        self.width = len(letters) + 1
        self.roots: list[int] = []
        rows: list[dict[int, int]] = []
        for _, text in samples:
            base = len(rows)
            self.roots.append(base)
            rows += [{c: to + base for c, to in out.items()} for out in automaton(text, codes)]
        self.dense = max(1, min(self.width, DENSE_CELLS // max(1, len(rows))))
        self.table = np.full((len(rows) + 1, self.dense), -1, np.int32)
        rare: dict[int, int] = {}
        for state, out in enumerate(rows):
            for c, to in out.items():
                if c < self.dense:
                    self.table[state, c] = to
                else:
                    rare[state * self.width + c] = to
        self.table = self.table.ravel()
        self.keys = np.array(sorted(rare), np.int64)
        self.values = np.array([rare[k] for k in self.keys.tolist()], np.int32)
        self.price = np.log2(max(2, max((len(text) for _, text in samples), default=0)))
        points = np.array([ord(ch) for ch in letters], np.uint32)
        self.code_of = np.argsort(points).astype(np.int32)
        self.points = points[self.code_of]

    def follow(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states (a row a language) after each state and its column's code; -1 where there is none."""
        to = self.table[state * self.dense + np.minimum(code, self.dense - 1)]
        if self.dense < self.width:
            rare = np.flatnonzero(code >= self.dense)
            if len(rare):
                key = np.broadcast_to(state, to.shape)[:, rare].astype(np.int64) * self.width + code[rare]
                at = np.searchsorted(self.keys, key).clip(max=max(0, len(self.keys) - 1))
                to[:, rare] = np.where(self.keys[at] == key, self.values[at], -1) if len(self.keys) else -1
        return to

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.searchsorted(self.points, points).clip(max=max(0, len(self.points) - 1))
        return np.where(self.points[at] == points, self.code_of[at], self.width - 1).astype(np.int32)

    def phrases(self, pieces: list[np.ndarray]) -> np.ndarray:
        """Phrases of each piece (row) for each language (column)."""
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        sizes = np.array([len(pieces[i]) for i in order])
        grid = np.zeros((sizes[0] if len(sizes) else 0, len(order)), np.int32)
        for k, i in enumerate(order):
            grid[: sizes[k], k] = pieces[i]
        roots = np.array(self.roots, np.int32)[:, None]
        state = np.repeat(roots, len(order), 1)
        count = np.zeros(state.shape, np.int32)
        live = np.searchsorted(-sizes, -np.arange(len(grid)), side="left")  # pieces longer than the step
        for step in range(len(grid)):
            n = live[step]
            c = grid[step, :n]
            to = self.follow(state[:, :n], c)
            ended = to < 0
            again = self.follow(roots, c)
            lone = again < 0  # a character the sample lacks is a phrase by itself
            count[:, :n] += ended & (state[:, :n] != roots)
            count[:, :n] += ended & lone
            np.copyto(to, np.where(lone, roots, again), where=ended)
            state[:, :n] = to
        count += (state != roots) & (sizes > 0)  # the phrase that the end cut off
        out = np.empty((len(order), len(self.langs)), np.int32)
        out[order] = count.T
        return out


def folded(text: str) -> str:
    """Lower case, every run of white space one space."""
    return " ".join(text.lower().split())


def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return kept(("language", samples), lambda: Parser(list(samples)))


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> tuple[tuple[str, str], ...]:
    """A sample of text for each language of the labelled rows.

    Of each language's distinct texts those with the smallest hashes are taken,
    ``sample_docs`` of them and ``sample_chars`` characters of each, so the
    sample is bounded by the number of languages. A language's sample does not
    depend on how much text the others have.
    """
    rows = labelled.select(col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", F.xxhash64("text").alias("h"), F.substring("text", 1, sample_chars).alias("head"))
    # first within a part of each language, so that no task sees more than a few hundred rows of each part
    least = rows.select("lang", "h").distinct()
    for parts in PARTS:
        within = Window.partitionBy("lang", F.pmod(F.xxhash64("h"), F.lit(parts))).orderBy("h")
        least = least.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= sample_docs)
    chosen = least.collect()
    ranks = {(r["lang"], r["h"]): r["rank"] for r in chosen}
    heads = rows.where(F.col("h").isin([h for _, h in ranks] or [None])).groupBy("lang", "h").agg(F.min("head").alias("head")).collect()
    by_lang: dict[str, list[str]] = {}
    for row in sorted((r for r in heads if (r["lang"], r["h"]) in ranks), key=lambda r: (r["lang"], ranks[r["lang"], r["h"]])):
        by_lang.setdefault(row["lang"], []).append(folded(row["head"]))
    whole = {lang: " ".join(texts) for lang, texts in by_lang.items()}
    return tuple(sorted(whole.items()))


def costs(model: Parser, texts: list[str]) -> np.ndarray:
    """Bits a character of each folded text (row) for each language (column)."""
    counts = np.zeros((len(texts), len(model.langs)), np.int64)
    waiting, owners = [], []

    def parse() -> None:
        if waiting:
            np.add.at(counts, owners, model.phrases(waiting))
            waiting.clear()
            owners.clear()

    for i, text in enumerate(texts):
        codes = model.codes(text)
        for at in range(0, len(codes), PIECE_CHARS):
            waiting.append(codes[at : at + PIECE_CHARS])
            owners.append(i)
            if len(waiting) == SIDE_BY_SIDE:
                parse()
    parse()
    return counts * model.price / np.maximum(1, [len(t) for t in texts])[:, None]


def judged(model: Parser, batch: pd.Series) -> pd.DataFrame:
    """lang, score and bits a character of some texts."""
    texts = [folded(t) if t is not None else "" for t in batch]
    bits = costs(model, texts)
    least = bits.min(axis=1)
    known = np.array([any(map(str.isalpha, t)) for t in texts], bool)
    lang = np.where(known, np.array(model.langs, object)[bits.argmin(axis=1)], UNKNOWN)
    score = np.where(known, 1 / np.exp2(-2.0 * (bits - least[:, None])).sum(axis=1), 0.0)
    return pd.DataFrame({"lang": lang, "score": score, "bits": np.where(known, least, 0.0)})


def _predictor(samples: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = parser(samples)
        for batch in batches:
            parts = [judged(model, batch.iloc[at : at + TOGETHER]) for at in range(0, len(batch), TOGETHER)]
            yield pd.concat(parts, ignore_index=True) if parts else judged(model, batch)

    return run


def predict(docs: DataFrame, samples: tuple[tuple[str, str], ...], text_col: str = "text", out: str = "predicted") -> DataFrame:
    """``docs`` with a struct ``out`` of lang, score (0 to 1) and bits a character.

    ``und`` with score 0 for a null text or one without a letter, and for every
    text where nothing was learned. Equal costs go to the first language by
    name. Repeated rows are predicted each by itself, all columns stay.
    """
    schema = "lang string, score double, bits double"
    if samples:
        value = F.pandas_udf(_predictor(tuple(samples)), schema, F.PandasUDFType.SCALAR_ITER)(col(text_col).cast("string"))
    else:
        value = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"))
    return docs.withColumn(out, value)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predicted_languages(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents that are not held out, then predict all of them."""
    samples = learn(docs.where(~held_out()))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(rows, samples).select("doc_id", "held_out", F.col("predicted.lang").alias("lang_pred"), F.col("predicted.score").alias("score"))


def recognised(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, whose language is not ``und``."""
    (out,) = fresh(docs, "predicted")
    return predict(docs, learn(docs.where(~held_out())), out=out).where(F.col(f"{out}.lang") != UNKNOWN).drop(out)
