"""Corpus operators against plain loops, on small tables and odd inputs."""

import hashlib
import html as htmllib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from entitystats.llm import decontaminate, html_text, language, nearest, packing, sharding, token_store, warc
from entitystats.llm.boosting import fit
from entitystats.llm.queries import QUERIES, TOKENIZER
from entitystats.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
TEXTS = ["a b", None, "", "a b", "  x \n\n y 　z ", "it's 's <|endoftext|>b 12 é😀", "w" * 5000 + " " + "the end. " * 9000, "Ñandú\tq\x1cz"]
ODD = [(i if i != 3 else 0, t, "key", i, 1) for i, t in enumerate(TEXTS)] + [(None, "n", None, None, None), (-7, "m", "x", 0, 0), (-7, "m", "x", 0, 0)]
ODD_SCHEMA = "doc_id long, text string, law string, row int, n long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(TOKENIZER)


def plain_jump(key, n):
    key, b, j = (key or 0) % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards(spark, odd):
    rows = sharding.assign_shards(odd, 5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ODD)
    assert all((r.shard, r.grown_shard) == (plain_jump(r.doc_id, 5), plain_jump(r.doc_id, 6)) for r in rows)
    assert all(r.grown_shard in (r.shard, 5) for r in rows)
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    many = spark.range(300).selectExpr("id * 7919 - 1000000 AS k").select("k", sharding.jump_shard("k", 16).alias("s"), sharding.jump_shard("k", 1).alias("one")).collect()
    assert all(r.s == plain_jump(r.k, 16) and r.one == 0 for r in many)
    assert sharding.assign_shards(odd.limit(0)).count() == 0


def test_archive(spark):
    big, small = "é" * 600, "tiny"
    rows = [(1, "http://a\r\nX: y", big), (9, None, big), (9, "u", small), (3, "u", small), (None, "u", big), (5, "u", None), (9, None, big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, header string")
    got = warc.archived_pages(pages).collect()
    want = Counter()
    for i, _, body in rows:
        raw = (body or "").encode()
        revisit = len(raw) >= 1000 and i != 9
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None)] += 1
    assert Counter(tuple(r) for r in got) == want
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_archive_bytes_and_damage(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    warc.write_archive(spark.createDataFrame([(1, "http://u", "body")], "page_id long, url string, html string"), folder)
    (record,) = [bytes(r.record).decode() for r in warc.record_bytes(warc.read_archive(spark, folder)).collect()]
    head, body = record.split("\r\n\r\n", 1)
    assert body == "body\r\n\r\n" and head.startswith("WARC/1.1\r\n") and "Content-Length: 4" in head and "WARC-Target-URI: http://u" in head
    bad = spark.read.parquet(f"{folder}/payloads").selectExpr("digest", "encode('other', 'UTF-8') AS payload", "size", "bearer")
    bad.write.parquet(f"{folder}2/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{folder}2/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, f"{folder}2").collect()


def test_tokens_equal_whole_texts(docs, whole):
    texts = [r.text for r in docs.collect()] + [t for t in TEXTS if t]
    rng = random.Random(3)
    texts += ["".join(rng.choice(["a", "B9", " ", "  ", "\n", ".", "'s", "é", "е", "1", "-", "<|endoftext|>", "\t", "😀", "　"]) for _ in range(60)) for _ in range(300)]
    enc = encoder(TOKENIZER)
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t[:80]


def plain_ids(whole, text):
    return [*whole.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_store(spark, docs, odd, whole):
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = plain_ids(whole, r.text)
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op7_addressable_tokens"](spark, SF).collect()) == want
    rows = sorted(token_store.stored_tokens(odd, TOKENIZER).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    keys = [r.doc_id for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert Counter((r.doc_id, r.ids_crc32) for r in rows) == Counter((i, crc(plain_ids(whole, t))) for i, t, *_ in ODD)
    assert token_store.stored_tokens(odd.limit(0), TOKENIZER).count() == 0


def test_segment_access():
    rng = np.random.default_rng(0)
    for ids in (rng.integers(0, 1 << 20, 3000), np.zeros(0, int), np.full(1025, 70000), rng.integers(0, 256, 513)):
        seg = token_store.Segment(token_store.encode_ids(ids))
        assert seg.ids().tolist() == ids.tolist() == [seg[i] for i in range(len(seg))]
    with pytest.raises(ValueError):
        token_store.Segment(b"nothing at all, sorry")


@pytest.mark.parametrize("seed", range(4))
def test_local_search(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(1, 1023), rng.randint(300, 400), 513]) for _ in range(600)]
    first = packing.best_fit(sizes, 1024)
    bins = packing.improve([list(b) for b in first], sizes, 1024)
    assert sorted(i for b in bins for i in b) == list(range(600)) and max(sum(sizes[i] for i in b) for b in bins) <= 1024
    assert len(bins) <= len(first)


def test_two_for_one_empties_a_bin():
    sizes = [6, 4, 3, 3, 2, 2]
    bins = packing.improve([[0, 2], [1, 3, 4], [5]], sizes, 10)
    assert len(bins) == 2


def test_packing(spark, docs, odd, whole):
    for table, source in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd, [(i, t) for i, t, *_ in ODD])):
        rows = packing.pack(table, TOKENIZER).collect()
        want = Counter()
        for i, t in source:
            ids = plain_ids(whole, t)
            k = -(-len(ids) // 1024)
            cuts = [0, *range(len(ids) - (k - 1) * 1024, len(ids) + 1, 1024)]
            for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want[(i, p, a, b - a, crc(ids[a:b]))] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        bins = {}
        for r in rows:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for placed in bins.values():
            placed.sort()
            assert [o for o, _ in placed] == [sum(n for _, n in placed[:k]) for k in range(len(placed))] and sum(n for _, n in placed) <= 1024
        assert len(bins) <= 1.05 * -(-sum(r.length for r in rows) // 1024) + 1
    assert packing.pack(odd.limit(0), TOKENIZER).count() == 0


def test_automaton_and_phrases():
    text = "abracadabra abrac"
    table = language.automaton(text, {c: i for i, c in enumerate(sorted(set(text)))})
    model = language.Parser([("x", text), ("y", "zzzz")])
    inside = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    assert table.shape[0] <= 2 * len(text)
    rng = random.Random(2)
    for _ in range(60):
        t = "".join(rng.choice("abrcdz q") for _ in range(rng.randrange(0, 40)))
        n, at = 0, 0
        while at < len(t):
            k = at + 1
            while k < len(t) and t[at : k + 1] in inside:
                k += 1
            n, at = n + 1, k
        assert model.phrases([model.codes(t)])[0, 0] == n


def test_language(spark, odd):
    rows = QUERIES["op3_cross_parsing_language"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.96 * len(held)
    samples = (("aa", "one two three four " * 30), ("bb", "ein zwei drei vier " * 30))
    got = {(r.row, r.text): r for r in language.predict(odd, samples).collect()}
    assert got[(1, None)].predicted.lang == got[(2, "")].predicted.lang == "und"
    assert len(got) == len(ODD) - 1
    labelled = odd.withColumn("lang", odd.law)
    assert language.recognised(labelled).columns == labelled.columns and language.recognised(labelled.limit(0)).count() == 0 and language.learn(odd.selectExpr("CAST(NULL AS string) AS lang", "text")) == ()


def test_search(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((900, 24)).astype("float32")
    vectors[300:600] = vectors[0]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(2000, None, "x"), (2020, [0.0] * 24, "x"), (2040, [float("nan")] * 24, "x"), (2060, [None] * 24, "x"), (2080, [1.0], "x"), (None, [1.0] * 24, "x"), (20, vectors[20].tolist(), "x"), (2100, [], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    got = nearest.nearest(table, 20, "vec_id % 20 = 0").collect()
    x = vectors.astype(float)
    hits = 0
    for q in range(0, 900, 20):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        scores = x @ x[q]
        assert np.allclose([m[2] for m in mine], scores[[m[1] for m in mine]], atol=1e-12)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        best = sorted((i for i in range(900) if i != q), key=lambda i: (-round(scores[i], 9), i))[:20]
        hits += len(set(best) & {m[1] for m in mine})
    assert {r.query_id for r in got} == set(range(0, 900, 20)) and hits >= 0.9 * 20 * 45
    assert nearest.nearest(table.limit(0), 20, "vec_id % 20 = 0").count() == 0


def test_probe_order():
    sets = nearest.probe_sets(4, 30)
    assert sets[0] == () and len(set(sets)) == 30 and all(7 - j not in s for s in sets for j in s)


def article(page):
    part = page[page.index("<article>") + 9 :]
    part = re.split("</article>|<footer>", part)[0]
    part = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br|div|li|ul)\b[^>]*>", " ", part))
    return " ".join(htmllib.unescape(part).split())


def test_main_text(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in QUERIES["op8_tree_boosted_html"](spark, "/root/testdata/sf0.01").collect():
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_main_text_odd_pages(spark):
    model = html_text.train([r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()])
    odd = ["", "<", "<div", "<p class='x", "no tags &amp; one", "<div>" * 3000 + "deep", "</p></div>", "<script>var a = '<p>';", "<!-- open", "<a href=\"x>" * 50, "<p>" + "x " * 100000]
    assert len(html_text.main_texts(odd, model)) == len(odd)
    kept = html_text.main_texts(["<body><nav><a href=x>Home</a></nav><article><h1>A&nbsp;T</h1><p>One <b>bo</b>ld<br>two.<p>Three</article><div class=comments><p>me too</div><aside>buy</aside></body>"], model)
    assert kept == ["A T One bold two. Three"]


def test_trees_follow_their_sql(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, (400, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 1)).astype(float)
    model = fit(x, y, np.ones(400), rounds=10)
    assert ((model.margin(x) > 0) == (y > 0)).mean() > 0.98
    table = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], "a double, b double, c double")
    got = [r[0] for r in table.selectExpr(model.sql(["a", "b", "c"])).collect()]
    assert np.allclose(got, model.margin(x[:50]), atol=1e-6)


def test_decontamination(spark, docs):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = decontaminate.Items(bench)
    rng = random.Random(4)
    base = [r.text for r in docs.collect()]
    mixed, hits = [], 0
    for k in range(120):
        n = rng.randrange(len(bench))
        words = bench[n][1].split()
        for _ in range(int(0.1 * len(words))):
            words[rng.randrange(len(words))] = f"zz{rng.randrange(999)}"
        host = base[k % len(base)].split(" ")
        at = rng.randrange(len(host) + 1)
        mixed.append((n, " ".join(host[:at] + words + host[at:])))
    for (n, t), found in zip(mixed, items.search([t for _, t in mixed])):
        words = decontaminate.word_ids(t).tolist()
        assert all(e == items.distance(m, words) or e <= decontaminate.allowed(len(items.words[m])) for m, e in found.items())
        hits += n in found
    assert hits >= 0.95 * len(mixed)
    exact = {(r.doc_id, i) for r in docs.collect() for i, t in bench if t in r.text}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op10_cgk_decontamination"](spark, SF).collect()}
    assert exact <= got


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(40):
        item, text = [rng.choice("abcd") for _ in range(rng.randint(1, 9))], [rng.choice("abcd") for _ in range(rng.randint(0, 15))]
        items = decontaminate.Items([(1, " ".join(item))])
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            prev, row = row, [i]
            for j, b in enumerate(text, 1):
                row.append(min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (a != b)))
        assert items.distance(0, decontaminate.word_ids(" ".join(text)).tolist()) == min(row)


def test_decontamination_odd(spark, odd):
    bench = spark.createDataFrame([(1, "the end the end the end"), (2, None), (3, ""), (4, "a b"), (4, "a b"), (5, "q")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, bench).collect()}
    assert got == {(6, 1), (0, 4), (7, 5)}
    left = decontaminate.without_items(odd, bench)
    assert left.columns == odd.columns and left.count() == len(ODD) - 4
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0 and decontaminate.without_items(odd.limit(0), bench).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())
