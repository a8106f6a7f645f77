"""The pipeline's stages, each on what its predecessor kept, against plain loops."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from entitystats.llm.queries import TOKENIZER
from entitystats.session import settled
from tests.llm.test_pii import base_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Rows before the first stage and after each one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        result = settled(stage(spark, docs, SF))
        out.append(result.collect())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert result.columns == docs.columns
            docs = result
    return out


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_language(kept):
    want = {r.doc_id: r for r in kept[0] if any(map(str.isalpha, r.text or ""))}
    assert by_id(kept[1]) == want


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_near_duplicates(kept):
    prints = {r.doc_id: fingerprint(r.text) for r in kept[1]}
    group = {d: d for d in prints}

    def top(d):
        while group[d] != d:
            d = group[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                group[y] = x
    assert set(by_id(kept[2])) == {top(d) for d in ids}
    assert all(by_id(kept[1])[r.doc_id] == r for r in kept[2])


def least_edits(item, text):
    """Fewest word edits between an item and any stretch of a text."""
    n = len(text)
    row, places = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for i, word in enumerate(item, 1):
        new = np.empty(n + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        row = np.minimum.accumulate(new - places) + places
    return int(row.min())


def test_decontamination(spark, kept):
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    numbers = defaultdict(lambda: len(numbers))
    code = lambda ws: np.array([numbers[w] for w in ws], np.int64)
    items = [code(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [i for i in items if len(i)]
    clean = set()
    for r in kept[2]:
        text = code(words(r.text))
        if not any(len(np.intersect1d(item, text)) and least_edits(item, text) <= len(item) // 5 for item in items):
            clean.add(r.doc_id)
    assert set(by_id(kept[3])) == clean and len(clean) < len(kept[2])


def test_personal_data(kept):
    before = by_id(kept[3])
    assert set(before) == set(by_id(kept[4]))
    changed = 0
    for r in kept[4]:
        old = before[r.doc_id]
        if r.text != old.text:
            changed += 1
            assert r.n_chars == len(r.text) and re.search(r"\[(EMAIL|IP|CARD|PHONE|SECRET)\]", r.text)
        else:
            assert r == old and not any(base_spans(r.text or "").values())
        assert not any(base_spans(r.text or "").values())
    assert changed


def test_packing(kept):
    whole = Tokenizer.from_file(TOKENIZER)
    ids = {r.doc_id: [*whole.encode(r.text or "", add_special_tokens=False).ids, 2] for r in kept[4]}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in kept[5]:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for d, held in pieces.items():
        at = 0
        for number, (piece, start, length) in enumerate(sorted(held)):
            assert piece == number and start == at and 0 < length <= 1024
            at += length
        assert at == len(ids[d]) and len(held) == -(-len(ids[d]) // 1024)
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
