"""Concatenation, repair of conversations and periodic runs against plain loops."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from entitystats.llm import concatenation, periodic, repair
from entitystats.llm.queries import QUERIES, TOKENIZER

SF = "/root/testdata/sf0.001"
TEXTS = ["a b", None, "", "a b", "  x \n\n y 　z ", "it's 's <|endoftext|>b 12 é😀", "w" * 5000 + " " + "the end. " * 9000, "Ñandú\tq\x1cz"]
ODD = [(i if i != 3 else 0, t, "key", i, b"z") for i, t in enumerate(TEXTS)] + [(None, "n", None, None, None), (-7, "m", "x", 0, b""), (-7, "m", "x", 0, b"")]
ODD_SCHEMA = "doc_id long, text string, part string, offset int, ids binary"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(TOKENIZER)


# ---- concatenation ------------------------------------------------------------------------------


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_pieces(rows, docs, whole, capacity):
    """Every id in one piece, pieces gapless in their windows, windows full or of a power of two."""
    ids = collections.defaultdict(list)
    for i, t in docs:
        ids[i].append([*whole.encode(t or "", add_special_tokens=False).ids, 1])
    by_window, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_window[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for pieces in by_window.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        want = collections.Counter()
        for one in ids[i]:
            cuts = sorted({(r.start, r.length) for r in pieces if r.doc_tokens == len(one) and crc(one[r.start : r.start + r.length]) == r.ids_crc32})
            covered = set()
            for s, n in cuts:
                covered |= set(range(s, s + n))
            assert covered == set(range(len(one)))
            want[len(one)] += len(one)
        got = collections.Counter()
        for r in pieces:
            got[r.doc_tokens] += r.length
        assert got == want


@pytest.mark.parametrize("capacity", [8, 2048])
def test_concatenation(spark, odd, whole, capacity):
    rows = concatenation.concatenated(odd, TOKENIZER, capacity).collect()
    check_pieces(rows, [(i, t) for i, t, *_ in ODD], whole, capacity)
    assert concatenation.concatenated(odd.limit(0), TOKENIZER).count() == 0


def test_concatenation_query(spark, whole):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op11_concat_and_cut"](spark, SF).collect()
    check_pieces(rows, docs, whole, 2048)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) == total // 2048 + bin(total % 2048).count("1")


def test_windows_across_partitions(spark, whole):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(9)
    windows = {r.sequence_id: r for r in concatenation.sequences(docs, TOKENIZER, 512, powers=False).collect()}
    assert sorted(windows) == list(range(len(windows)))
    ids = [np.frombuffer(windows[k].ids, "<u4") for k in sorted(windows)]
    assert all(len(x) == 512 for x in ids[:-1]) and 0 < len(ids[-1]) < 512
    stream, texts = np.concatenate(ids).tolist(), {r.doc_id: r.text for r in docs.collect()}
    records = [(k * 512 + p.offset, p) for k in sorted(windows) for p in windows[k].pieces]
    for at, p in records:
        want = [*whole.encode(texts[p.doc_id] or "", add_special_tokens=False).ids, 1]
        assert stream[at : at + p.length] == want[p.start : p.start + p.length] and p.doc_tokens == len(want)
    assert sum(p.length for _, p in records) == len(stream)


# ---- conversations ------------------------------------------------------------------------------


def every_repair(rows, costs, inserts):
    """(cost, audit, what stays) of the cheapest repair, by listing all of them."""
    best = None

    def go(i, k, cost, audit, initials, out):
        nonlocal best
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        if k < inserts:
            for r in ("user", "assistant"):
                go(i, k + 1, cost + costs.insert, audit + "I", initials + r[0], [*out, (r, "")])
        if i == len(rows):
            return
        role, text, fault = rows[i]
        go(i + 1, k, cost + costs.delete, audit + "D", initials, out)
        if fault in (repair.BLANK, repair.DUPLICATE):
            return
        more = costs.truncated if fault == repair.TRUNCATED else 0
        go(i + 1, k, cost + costs.keep + more, audit + "K", initials + (role[:1] or "?"), [*out, (role, text)])
        for r in ("user", "assistant"):
            go(i + 1, k, cost + costs.rerole + more, audit + "R", initials + r[0], [*out, (r, text)])

    go(0, 0, 0, "", "", [])
    return best


@pytest.mark.parametrize("costs", [repair.Costs(), repair.Costs(insert=1), repair.Costs(0, 1, 3, 1, 2), repair.Costs(1, 0, 4, 2, 0)])
def test_least_weights(costs, monkeypatch):
    rng = random.Random(7)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), f"t{i}", rng.choice([0, 0, 0, 1, 2, 3])) for i in range(rng.randint(0, 5))]
        inserts = 3 if len(rows) < 4 else 2
        monkeypatch.setattr(repair, "GRAPH_ROWS", rng.choice([1, 2, 3, 64]))
        weights = repair.Weights(costs, inserts)
        for role, _, fault in rows:
            weights.add(role[:1], fault)
        want = every_repair(rows, costs, inserts)
        cost, audit = repair.least(*weights.table(), inserts)
        assert (cost, audit) == want[:2]
        editor = repair._Editor(audit)
        assert [x for r in rows for x in editor.row(*r[:2])] + list(editor.inserted()) == want[2]
        if costs.most_inserts(len(rows)) == 0:
            assert "I" not in audit


def plain_reports(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c]
        c_, t_, r, x = (" " if v is None else str(v) for v in (c, t, r, x))
        case = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        x = "" if case == 1 else re.sub("[.!?]", "", x) if case == 2 else x
        r = "user" if case == 4 else r
        by[c] += [(t, r, x)] * (0 if case == 0 else 2 if case == 3 else 1)
    out = {}
    for c, held in by.items():
        held = sorted(held, key=lambda q: (q[0] is not None, q[0] or 0, q[1], hashlib.sha256(f"{len(q[1])}:{q[1]}{q[2]}".encode()).digest()))
        turns = [q[0] for q in held if q[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, counts, faults = set(), [0] * 4, []
        for _, r, x in held:
            chars = re.findall(r"[^\x20\x09-\x0D]", x)
            k = 1 if not chars else 2 if (r, x) in seen else 3 if chars[-1] not in ".!?" else 0
            seen.add((r, x))
            counts[k] += 1
            faults.append(k)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        layer = {0: (0, "", ())}
        step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
        for (_, r, x), k in zip(held, faults):
            after = {}

            def relax(q, v, after=after):
                if q not in after or v[:2] < after[q][:2]:
                    after[q] = v

            for q, (cost, audit, kept) in layer.items():
                relax(q, (cost + 2, audit + "D", kept))
                if k in (1, 2):
                    continue
                more = 5 * (k == 3)
                if (q, r[:1]) in step:
                    relax(step[q, r[:1]], (cost + more, audit + "K", (*kept, f"{r}:{x}")))
                for z in ("user", "assistant"):
                    if (q, z[0]) in step:
                        relax(step[q, z[0]], (cost + 1 + more, audit + "R", (*kept, f"{z}:{x}")))
            layer = after
        cost, audit, kept = min(layer[q] for q in (0, 3) if q in layer)
        out[c] = (gaps, counts[1], counts[2], counts[3], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_repair_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = QUERIES["op12_integer_weight_repair"](spark, "/root/testdata/sf0.01")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == plain_reports([tuple(r) for r in rows])


def test_repair_odd(spark):
    """Null ids, turns, roles and texts, ties, repeats, an empty role, a long text, one large conversation in many slices."""
    rows = [(1, None, "user", "a."), (1, None, "user", "a."), (1, 3, None, None), (None, 1, "user", "x?"), (None, 2, "assistant", "y."), (2, 1, "", "q."), (2, 1, "assistant", "q."), (2, 2, "user", "w" * 100000)]
    rows += [(7, i, ["user", "assistant", "user"][i % 3], f"hi {i % 37}.") for i in range(900)] + [(8, 5, "user", "k.")] * 50 + [(9, -3, "system", "s"), (9, 4, "user", "")]
    rows += [(10, i, "system", "x.") for i in range(3)] + [(11, None, "assistant", "\x1c")]
    table = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, copies int, k string").repartition(7)
    got = {r[0]: tuple(r)[1:] for r in repair.repair_reports(repair.damaged(table), copies_col="copies").collect()}
    assert got == plain_reports(rows)
    kept = collections.defaultdict(list)
    for r in sorted(repair.repaired_rows(repair.damaged(table), copies_col="copies").collect(), key=lambda r: r.position):
        kept[r.conv_id].append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(kept[c]).encode()).hexdigest() == want[-1] for c, want in got.items())
    assert repair.repair_reports(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repair.repair_reports(table, costs=repair.Costs(insert=1))
    few = table.where("conv_id IN (2, 9, 10)")
    cheap = {r.conv_id: r.audit for r in repair.repair_reports(few, costs=repair.Costs(insert=1, delete=4), inserts=4).collect()}
    assert "I" in cheap[10]


# ---- runs ---------------------------------------------------------------------------------------


def plain_runs(words, least=12):
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and not any(s <= i and s + n >= j + q and q % p == 0 for s, n, p in found):
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, rewritten=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if rewritten and doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    keep = [not any(s + p <= i < s + n for s, n, p in runs) for i in range(len(words))]
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for w, k in zip(words, keep) if k)))


def test_transforms():
    rng = np.random.default_rng(0)
    for size in (4, 16, 64, 128, 1024, 8192):
        x = np.zeros((size, 2))
        x[: size // 4] = rng.integers(0, 90, (size // 4, 2))
        f, root, at = np.mod(periodic.forward(x[: size // 4].copy(), size), periodic.MODULUS), periodic._root(size, False), periodic.order(size)
        for k in (0, 1, size - 1):
            assert f[k, 0] == sum(int(v) * pow(root, int(at[k]) * n, periodic.MODULUS) for n, v in enumerate(x[: size // 4, 0])) % periodic.MODULUS
        back = periodic.backward(f, size, size // 2) * pow(size, -1, periodic.MODULUS)
        assert np.array_equal(np.mod(back, periodic.MODULUS), x[: size // 2])


@pytest.mark.parametrize("largest, tile", [(1 << 20, 1 << 17), (1 << 20, 64), (16, 256)])
def test_runs_against_loops(monkeypatch, largest, tile):
    monkeypatch.setattr(periodic, "MAX_SIZE", largest)
    monkeypatch.setattr(periodic, "TILE", tile)
    rng = random.Random(largest + tile)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, letters = rng.choice([0, 1, 12, 20, 40, 90, 200]), rng.choice([1, 2, 3, 10, 10**6])
            x = [rng.randrange(letters) for _ in range(n)]
            if n > 12 and rng.random() < 0.5:
                p, s = rng.randint(1, n // 2), rng.randrange(n // 2)
                x = [v if i < s else x[s + (i - s) % p] for i, v in enumerate(x)]
            if rng.random() < 0.2:
                x, y = [0], [0, 1]
                while len(y) <= n:
                    x, y = y, y + x
                x = y[:n]
            docs.append(x)
        docs.sort(key=len, reverse=True)
        bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
        starts, ends, periods = periodic.find_runs(np.array([v for d in docs for v in d], np.int64), bounds)
        want = [(s + b, s + n + b, p) for d, b in zip(docs, bounds.tolist()) for s, n, p in plain_runs(d)]
        assert sorted(zip(starts.tolist(), ends.tolist(), periods.tolist())) == sorted(want)


def test_runs_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op13_block_convolution_runs"](spark, SF).collect())
    assert got == sorted(plain_row(*d) for d in docs)


def test_runs_odd(spark):
    texts = ["a " * 11, "a " * 12, None, "", " \t", "x y " * 6 + "x", "é\x1cü " * 12, "\x85 " * 13, "p q r s t u v " * 3, "a b " * 20 + "c " * 20, "same words " * 9]
    rows = [(i, t, 1, "r") for i, t in enumerate(texts)] + [(None, "k " * 30, 2, None), (3, "", 0, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string").repartition(3)
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(table).collect()]
    want = []
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = plain_runs(words)
        want.append((i, len(words), runs, " ".join(w for k, w in enumerate(words) if not any(s + p <= k < s + n for s, n, p in runs))))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert periodic.periodic_runs(table.limit(0)).count() == 0


def test_one_long_text(spark):
    words = [f"w{i % 7919}" for i in range(60000)]
    (row,) = periodic.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(0, 60000, 7919)] and len(row.collapsed.split()) == 7919
