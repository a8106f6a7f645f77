"""Cases in which an operator once did less than the whole job."""

import itertools
import random
import time

import numpy as np
import pandas as pd
import pytest

from entitystats.llm import decontaminate, html_text, language, nearest, packing

SF = "/root/testdata/sf0.001"


def test_rare_label_takes_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text")
    alone = dict(language.learn(docs))
    texts = [r.text for r in docs.collect()]
    before = language.judged(language.Parser(sorted(alone.items())), texts).lang.tolist()
    for label in ("ok", "hello all", "the first word of the", " ".join(texts[0].split())[:3000]):
        samples = dict(language.learn(docs.union(spark.createDataFrame([("xx", label)], docs.schema))))
        assert {k: v for k, v in samples.items() if k != "xx"} == alone and samples["xx"] == language.folded(label[: language.SAMPLE_CHARS])
        after = language.judged(language.Parser(sorted(samples.items())), texts).lang.tolist()
        assert sum(a != b for a, b in zip(after, before)) <= (label[:9] == texts[0][:9])


def edited(words, edits, rng):
    out = [[w] for w in words]
    for k, place in enumerate(rng.sample(range(len(words)), edits)):
        out[place] = ([f"new{rng.randrange(10**6)}"], [], [words[place], f"new{rng.randrange(10**6)}"])[k % 3]
    return [w for part in out for w in part]


@pytest.mark.parametrize("length", [*range(5, 60), 80, 120])
def test_items_of_every_length_are_found(length):
    rng = random.Random(length)
    texts = [[f"w{n}x{k}" for k in range(length)] for n in range(60)]
    items = decontaminate.Items([(n, " ".join(words)) for n, words in enumerate(texts)])
    for edits in {0, 1, decontaminate.allowed(length)}:
        hosts = [" ".join(["host"] * rng.randrange(30, 60) + edited(words, edits, rng) + ["q"] * 10) for words in texts]
        found = sum(n in x for n, x in enumerate(items.search(hosts)))
        assert found >= 59, (edits, found)


@pytest.mark.parametrize("kind", ["few", "one_long", "uneven"])
def test_search_of_uneven_vectors(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((15 if kind == "few" else 1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "one_long":
        x[7] *= 10
    elif kind == "uneven":
        x *= np.exp(0.7 * rng.standard_normal((len(x), 1)))
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}))
    asked = range(0, len(x), 1 if kind == "few" else 8)
    got = nearest.nearest(table, 20, "true" if kind == "few" else "vec_id % 8 = 0").toPandas().groupby("query_id")["vec_id"].apply(set)
    wanted = min(20, len(x) - 1)
    hits = 0
    for q in asked:
        scores = x @ x[q]
        scores[q] = -np.inf
        assert len(got[q]) == wanted
        hits += len(got[q] & set(np.argsort(-scores)[:wanted].tolist()))
    assert hits >= (1 if kind == "few" else 0.9) * wanted * len(asked)
    print(kind, "recall", hits / (wanted * len(asked)))


def packed(low, high, count, seed=1):
    rng = random.Random(seed)
    sizes = [rng.randint(low, high) for _ in range(count)]
    return sizes, packing.improve(packing.best_fit(sizes, 1024), sizes, 1024)


def test_search_of_packings_goes_to_its_end():
    sizes, bins = packed(260, 420, 4096)
    assert sorted(i for b in bins for i in b) == list(range(4096)) and max(sum(sizes[i] for i in b) for b in bins) <= 1024
    assert len(bins) <= 1420
    sizes, bins = packed(300, 520, 400)
    for donor, other in itertools.permutations(bins, 2):
        mine, theirs = sum(sizes[i] for i in donor), sum(sizes[i] for i in other)
        given = [sizes[i] for i in donor] + [sizes[a] + sizes[b] for a, b in itertools.combinations(donor, 2)]
        gains = [g - v for g in given for v in (0, *(sizes[i] for i in other))]
        assert not any(max(0, mine - theirs) < gain <= 1024 - theirs for gain in gains)


@pytest.mark.parametrize("before, inside, seen", [
    ("<svg class=icon/>", "", ""), ("<math/>", "", ""), ("<svg><path d='x'>", "", ""), ("<svg><svg><text>in</text></svg><text>out</text></svg>", "", ""),
    ("<svg><foreignObject><div>in</div></foreignObject><text>out</text></svg>", "", ""), ("<svg><title/><style/></svg>", "", ""),
    ("", "<math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "x=1"), ("", "<svg><text>no</text></svg>", ""),
])
def test_drawings_and_formulas(before, inside, seen):
    page = f"<body>{before}<article><p>One{inside} two.</p><p>Three</p></article></body>"
    texts = [n.text for n in html_text.nodes(html_text.parse(page)) if n.text]
    assert texts == [f"One{seen} two.", "Three"]


def test_many_letters():
    """Two scripts of 3,000 letters and 40,000 characters each; the automata stay small and tell them apart."""
    rng = random.Random(2)
    han, yi = ("".join(rng.choices([chr(first + i) for i in range(3000)], [1 / (i + 1) for i in range(3000)], k=40000)) for first in (0x4E00, 0x6000))
    latin = "".join(rng.choices("abcdefghij klmno", k=40000))
    model = language.Parser([("han", han), ("latin", latin), ("yi", yi)])
    assert model.table.nbytes + model.keys.nbytes + model.values.nbytes < 100e6
    texts = [han[100:900], latin[5:400], yi[7:700], "z", ""]
    bits = language.costs(model, texts)
    assert bits[:3].argmin(axis=1).tolist() == [0, 1, 2]
    # the same phrases as a plain search for substrings
    for text, row in zip(texts[:3], bits):
        for sample, got in zip((han, latin, yi), row):
            at, phrases = 0, 0
            while at < len(text):
                n = 1
                while at + n < len(text) and text[at : at + n + 1] in sample and text[at] in sample:
                    n += 1
                at, phrases = at + n, phrases + 1
            assert got == pytest.approx(phrases * model.price / len(text))


def test_stray_quotes_and_tags():
    def texts(node):
        return ([node.text] if node.text else []) + [t for kid in node.kids for t in texts(kid)]

    parsed = lambda page: texts(html_text.parse(page))
    assert parsed("<p title=don't>Hello world, it's a text.</p><p>More text</p>") == ["Hello world, it's a text.", "More text"]
    assert parsed("<p class=\"a>b\">x</p><p data-x='1>2' id=\"q\" >y</p><p title=\"open>z</p><p>w</p>") == ["x", "y", "z", "w"]
    assert parsed("<div><p>a<p>b</div></p></span></div>c<ul><li>1<li>2</ul>d") == ["a", "b", "c", "1", "2", "d"]
    begin = time.time()
    assert html_text.parse("<div>" * 50000 + "</section>" * 50000 + "x")
    assert time.time() - begin < 20


def test_odd_pages(spark):
    """Null, empty and repeated pages, a stray quote, columns that clash; an empty table."""
    body = "<html><body><nav><a href=x>Home</a></nav><article><p title=don't>" + "It's the first paragraph of a story. " * 8 + "</p><p>" + "And here is more of it, told slowly. " * 8 + "</p></article></body></html>"
    rows = [(1, "u", None, "t", 1), (2, "u", "", "t", 2), (3, None, body, None, 3), (3, None, body, "n", 3), (None, "v", "<p>", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(2)
    got = sorted(html_text.extracted(pages).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [r.page_id for r in got] == [1, 2, 3, 3, None] and [r.text for r in got[:2]] == ["", ""]
    assert got[2].text == got[3].text and "first paragraph" in got[2].text and "told slowly" in got[2].text
    assert all(r.n_chars == len(r.text) for r in got) and html_text.extracted(pages.limit(0)).count() == 0
