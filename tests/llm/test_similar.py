"""The Jaccard join, neighbours, pages, toxicity and the pipeline."""

import os
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from nickline.llm import jaccard, neighbours, pages, toxicity

from ..oracle import compare

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def shingles(text, k):
    w = (text or "").encode().translate(jaccard.FOLD).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def plain_join(rows, k, t):
    sets = [shingles(x, k) for _, x in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) * t.denominator >= t.numerator * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids and sets[i] else d))
    return out, len({find(i) for i, a in enumerate(sets) if a}) + sum(not a for a in sets)


def texts(n, seed=1):
    rng, out = random.Random(seed), [None, "", "  ", "a", "a b", "A  B", "a b c", "x " * 60, "x " * 30]
    while len(out) < n:
        if out[-1] and rng.random() < 0.6:
            w = rng.choice(out[9:] or ["a b c d e f g h i j k l m"]).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice("abcdefgh")
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choice("abcdefghijklmnopqrst") * 2 for _ in range(rng.randint(1, 150))))
    return out


@pytest.mark.parametrize("k, t, block", [(3, Fraction(9, 10), jaccard.BLOCK), (5, Fraction(4, 5), jaccard.BLOCK), (2, Fraction(1, 2), 300)])
def test_join(spark, monkeypatch, k, t, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    rows = [(i, x) for i, x in enumerate(texts(160))] + [(3, "a b c"), (None, "a b c"), (None, None), (200, "a"), (200, "a")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs, k=k, similarity=t).collect()]
    want, groups = plain_join(rows, k, t)
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = jaccard.distinct(docs, k=k, similarity=t)
    assert kept.columns == docs.columns and kept.count() == groups


def test_a_large_group_in_blocks_and_a_chain_across_them(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 60)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(30)]
    near = [" ".join(w if rng.random() > 0.02 else rng.choice("xyz") for w in base) for _ in range(60)]
    chain = [" ".join(f"c{j}" for j in range(i, i + 30)) for i in range(30)]  # each links with the next only
    rows = list(enumerate(near + chain + [" ".join(rng.sample(base, 12)) for _ in range(30)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    t = Fraction(8, 10)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs, k=3, similarity=t).collect())
    assert got == sorted(plain_join(rows, 3, t)[0])


def test_a_row_of_the_smallest_id_is_kept_whatever_the_order(spark):
    rows = [(1, "A B c d e f", 1), (1, "a b c d e f", 2), (2, "a b c d e f", 3), (1, "a b c d e f", 4)]
    kept = {tuple(jaccard.distinct(spark.createDataFrame(x, "doc_id long, text string, row int").repartition(n)).collect()[0]) for x in (rows, rows[::-1]) for n in (1, 3)}
    assert len(kept) == 1 and next(iter(kept))[0] == 1


def test_very_long_texts_and_one_text_in_many_rows(spark):
    rng = random.Random(9)
    long = " ".join(rng.choice("abcdefghij") + str(rng.randrange(99)) for _ in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "end " + long.upper())] + [(i, "same text of some words") for i in range(10, 200)]
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **dict.fromkeys(range(10, 200), 10)}


def test_join_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(docs).count() == 0 and jaccard.distinct(docs).count() == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for t in (Fraction(9, 10), Fraction(4, 5), Fraction(1, 2)):
        for _ in range(400):
            n = int(rng.integers(1, 60))
            a = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
            gone = int(rng.integers(0, len(a) // 2 + 1))
            b = np.unique(np.concatenate([a[gone:], rng.integers(1, 1 << 63, int(rng.integers(0, 8)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and both * t.denominator >= t.numerator * (len(a) + len(b) - both):
                for share in (0, 0.3, 0.9, 1):  # any list of frequent shingles will do
                    every = np.union1d(a, b)
                    common = np.sort(rng.choice(every, int(share * len(every)), replace=False))
                    assert np.intersect1d(jaccard.signatures(a, t, common), jaccard.signatures(b, t, common)).size


def test_tree_loses_no_link():
    rng, t = random.Random(5), Fraction(4, 5)
    base = [np.unique(np.array([rng.getrandbits(62) for _ in range(rng.randint(5, 80))], np.uint64)) for _ in range(30)]
    sets = base + [np.unique(np.concatenate([rng.choice(base)[rng.randint(0, 3) :], np.array([rng.getrandbits(62) for _ in range(rng.randint(0, 6))], np.uint64)])) for _ in range(120)]

    def groups(pairs):
        root = list(range(len(sets)))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
        return sorted(sorted(i for i in range(len(sets)) if root[i] == r) for r in set(root))

    want = [(i, j) for i in range(len(sets)) for j in range(i) if (s := len(np.intersect1d(sets[i], sets[j]))) * 5 >= 4 * (len(sets[i]) + len(sets[j]) - s)]
    assert groups(jaccard.links(sets, t)) == groups(want)


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x[50:90] = x[0]  # a frequent vector, with ties
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(1000, None, "x"), (1001, [0.0] * 24, "x"), (1002, [float("nan")] * 24, "x"), (1003, [1.0, None] * 12, "x"), (None, x[3].tolist(), "x"), (1100, [1.0, 2.0], "x"), (3, x[3].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in neighbours.search(df, df.vec_id % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        far = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(600), far)) if i != q][:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(f[2] == far[f[1]] for f in found)
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        hits += len(set(order) & {f[1] for f in found})
    assert hits >= 0.9 * 10 * len(got)
    assert [f[1] for f in got[0]] == list(range(50, 60))


def test_few_vectors_are_all_found(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0, float(-i)]) for i in range(6)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, df.vec_id == 0).collect()
    assert sorted(r.vec_id for r in got) == [1, 2, 3, 4, 5]
    assert neighbours.search(df.limit(0), df.vec_id == 0).count() == 0


PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p><article>x';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy</div><aside>side</aside>%s<div class='comments'><p>reader</p></div><form><p>f</p></form><footer>&copy; x</footer></body></html>"


def test_pages(spark):
    body = "<article><h1>One &amp; two</h1><p><b>A\n  b.<br><p>C &lt; d&nbsp;e</p><!-- c --><p></p></article>"
    plain = "<div id='content'><div><p>Long text of the page here</p><p>and more of it</p></div></div>"
    rows = [(1, "http://a.com/1", PAGE % body), (2, "http://a.com/2", PAGE % "<article><p>Two</p></article>"), (3, "http://b.com/", PAGE % plain), (4, "http://b.com/2", PAGE % plain.replace("page", "side")), (5, None, None), (6, "u", ""), (7, "u", "just text"), (8, "http://a.com/3", "<article><p>cut off <b"), (1, "http://a.com/1", PAGE % body)]
    df = spark.createDataFrame([(*r, "t", "h") for r in rows], "page_id long, url string, html string, text string, host string")
    got = {r.row.page_id: r.text for r in pages.extract(df).collect()}
    assert got[1] == "One & two\nA b.\nC < d e" and got[2] == "Two" and got[8] == "cut off"
    assert got[3] == "Long text of the page here\nand more of it" and got[4].startswith("Long text of the side")
    assert got[5] == got[6] == "" and got[7] == "just text"
    assert pages.extract(df.limit(0)).count() == 0
    assert pages.extract(df).count() == len(rows)


def extracted(spark, htmls):
    df = spark.createDataFrame([(i, f"http://h.com/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return {r.row.page_id: r.text for r in pages.extract(df).collect()}


def test_pages_without_article_elements_keep_whole_articles(spark):
    box = "<body><div id=content><h1>T%d</h1><p>First %d of it.</p><div class=box>b%d</div><p>Last %d of it.</p></div></body>"
    got = extracted(spark, [box % (i, i, i, i) for i in range(4)])
    assert got == {i: f"T{i}\nFirst {i} of it.\nb{i}\nLast {i} of it." for i in range(4)}


def test_articles_with_ids_of_their_own(spark):
    page = "<body><h1>Site %d</h1><article id=post-%d class='post-%d c%d'><p>Text %d goes on.</p></article><div class=x1>Other %d words that stand behind the text</div></body>"
    assert extracted(spark, [page % ((i,) * 6) for i in range(4)]) == {i: f"Text {i} goes on." for i in range(4)}


def test_depth_changes_nothing():
    deep = "<div>" * 300
    page = f"<body><article>{deep}<p>In it.</p><nav>Menu</nav><article>Card</article>{'</div>' * 300}<p>The rest.</p></article><footer>Foot</footer></body>"
    found, _ = pages.blocks(page)
    assert [(path[:2], said) for path, outside, said in found if not outside] == [(("body", "article"), x) for x in ("In it.", "Card", "The rest.")]
    assert pages.main_text(page, "body>article") == "In it.\nCard\nThe rest."
    assert len(pages.blocks("<div>x" * 100_000)[0]) == 100_000


def test_texts_of_the_template_are_taken_out(spark):
    notice = "<div class=x1><p>Neutral notice of the host</p></div>"
    page = "<body><main><h1>T%d</h1>" + notice + "<p>Text %d.</p><p>Said by some.</p><div class=q7><p>Comment by its reader</p></div></main></body>"
    some = "<body><main><h1>T9</h1>" + notice + "<p>Text 9.</p></main></body>"
    got = extracted(spark, [page % (i, i) for i in range(4)] + [some])
    # in the class of an element around it: the notice on all pages, the comment box on most; a sentence that only some pages share isn't
    assert got == {**{i: f"T{i}\nText {i}.\nSaid by some." for i in range(4)}, 4: "T9\nText 9."}


def test_copies_of_one_page_are_not_template(spark):
    page = "<body><script>%d</script><main><h1>T</h1><p>Text.</p></main></body>"
    assert set(extracted(spark, [page % 1] * 4).values()) == set(extracted(spark, [page % i for i in range(4)]).values()) == {"T\nText."}


def test_gradients():
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    net.p["E"] = rng.normal(size=net.p["E"].shape)
    said = toxicity.Words("some words of a text, été some of them again and again; longer ones too".encode())
    rows = np.where(rng.random((len(said.keys), 2)) < 0.3, -1, said.buckets())
    at, mask, y = rng.integers(0, len(said.keys), (5, toxicity.WINDOW)), np.ones((5, toxicity.WINDOW)), np.array([0, 1, 1, 0, 1.0])
    mask[2, 7:] = 0
    _, grads = net.gradients(rows, said.data, said.first, at, mask, y)
    assert set(grads) == set(net.p)
    for name, g in grads.items():
        for spot in (tuple(rng.integers(0, s) for s in g.shape), np.unravel_index(np.abs(g).argmax(), g.shape)):
            old = net.p[name][spot]
            net.p[name][spot] = old + 1e-5
            up, _ = net.gradients(rows, said.data, said.first, at, mask, y)
            net.p[name][spot] = old - 1e-5
            down, _ = net.gradients(rows, said.data, said.first, at, mask, y)
            net.p[name][spot] = old
            assert (up - down) / 2e-5 == pytest.approx(g[spot], rel=1e-3, abs=1e-8)


def test_words_and_filters_against_plain_loops():
    text = "Ab ab été  x9y — abcdefgh, ab; zzzzzz".lower()
    said = toxicity.Words(text.encode())
    plain = [w for w in "".join(chr(b) if 97 <= b <= 122 or b >= 128 else " " for b in text.encode()).split()]
    assert len(said) == len(plain) and len(said.keys) == len(set(plain))
    for i, w in enumerate(plain):
        k = said.kind[i]
        assert bytes(said.data[said.first[k] : said.first[k] + said.sizes()[k]]) == w.encode("latin-1")
        assert all((said.kind[i] == said.kind[j]) == (w == v) for j, v in enumerate(plain))
    filters = np.random.default_rng(3).normal(size=(toxicity.REACH, 256, 4))
    most, where = toxicity.filtered(filters, said.data, said.first, True)
    assert np.allclose(most, toxicity.filtered(filters, said.data, said.first))
    for i, w in enumerate(plain):
        padded = b"\0\0" + w.encode("latin-1") + b"\0\0"
        found = np.array([sum(filters[k][padded[j + k]] * (padded[j + k] > 0 or True) for k in range(toxicity.REACH)) for j in range(len(w))])
        assert np.allclose(found.max(0), most[said.kind[i]])
        assert (where[said.kind[i]] - said.first[said.kind[i]] == found.argmax(0)).all()
    data, first = toxicity.part(said, np.array([1, 0]))
    assert np.allclose(toxicity.filtered(filters, data, first), most[[1, 0]])


def test_windows_cover_all_words():
    for n in (0, 1, 23, 24, 25, 36, 100):
        starts = toxicity.windows(n)
        assert set(range(n)) == {w for s in starts for w in range(s, min(n, s + toxicity.WINDOW))}


def corpus(n, seed=2):
    rng, out = random.Random(seed), []
    for i in range(n):
        w = ["".join(rng.choice(["an", "th", "er", "on", "in"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(w) // 15)):
                w.insert(rng.randrange(len(w)), rng.choice(["vilest", "vilaxo", "vilumm"]))
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_toxicity(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows] + [(None, None, 0.0), (900, "", 0.0), (901, "123 !!", 0.0), (902, "ther " * 30000 + "vilest vilaxo vilest", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r.row.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i] >= 0.5) == y for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(held) >= 0.95
    assert got[None] == got[900] == got[901] == 0.0 and got[902] >= 0.5 and all(0 <= s <= 1 for s in got.values())
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and 220 <= kept.count() <= 240
    assert {r.row.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()} == got
    # a model sees no label, and texts alone make a score
    again = toxicity.score(docs.selectExpr("doc_id + 1000 as doc_id", "text"), model).collect()
    assert {r.row.doc_id - 1000 if r.row.doc_id else None: r.score for r in again} == got


def test_ids_of_any_type_and_repeated_ids(spark):
    rows = [(f"id-{i}", t, y) for i, t, y in corpus(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [("id-7", f"other text {k}") for k in range(50)], "doc_id string, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id string, toxic long")
    one, two = (toxicity.learn(d, labels, rows=40) for d in (docs, docs.repartition(5)))
    assert one["slope"] == two["slope"] and all((one["weights"][k] == two["weights"][k]).all() for k in one["weights"])


@tables
def test_predictions_follow_from_scores_and_ids(spark):
    got = toxicity.op1_toxicity(spark, FOLDER).collect()
    assert len(got) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.learn(docs, none)).collect()] == [0.0, 0.0]
    assert toxicity.score(docs.limit(0), toxicity.learn(docs.limit(0), none)).count() == 0


@tables
@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op")))
def test_matches_sql(spark, name):
    compare(spark, FOLDER, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name])


@tables
def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        new = stage(spark, docs, FOLDER)
        if k < 4:
            assert new.columns == docs.columns
        new = corpus_pipeline.saved(new, "test")
        assert 0 < new.count() <= docs.count()
        docs = new
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted((r.doc_id, r.taken) for r in got.collect()) == sorted((r.doc_id, r.taken) for r in docs.collect())
