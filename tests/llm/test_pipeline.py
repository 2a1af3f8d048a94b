"""Each stage of the pipeline against a plain reading of its rule, and on odd and empty tables."""

import os
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nickline.llm import toxicity
from nickline.llm.common import saved, table

SMALL, FOLDER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
STAGE = dict(corpus_pipeline.STAGES)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text, pattern):
    return re.findall(pattern, (text or "").translate(LOWER))


def unlike(rows):
    """ids of the smallest of each group linked by sets of five-word shingles, and all without words."""
    sets = {}
    for r in rows:
        w = plain(r.text, r"[^\x20\x09-\x0D]+")
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted(i for i in ids if find(i) == i)


def uncontaminated(rows, items):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for r in items:
        w = plain(r.text, word)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[n].add(tuple(w[i : i + n]))
    out = []
    for r in rows:
        w = plain(r.text, word)
        hit = {p for n, known in windows.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in known for p in range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            out.append(r.doc_id)
    return sorted(out)


SECRETS = [r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{8,})", r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"]


def ids_of(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_what_a_plain_reading_keeps(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns

    kept = saved(STAGE["toxicity"](spark, docs, FOLDER), "test-toxicity")
    assert ids_of(kept) == ids_of(toxicity.op1_toxicity(spark, FOLDER).filter("predicted = 0")) and kept.columns == columns

    was = kept.collect()
    kept = saved(STAGE["near_copies"](spark, kept, FOLDER), "test-near")
    assert ids_of(kept) == unlike(was) and kept.columns == columns

    was = kept.collect()
    kept = saved(STAGE["decontamination"](spark, kept, FOLDER), "test-decontaminated")
    assert ids_of(kept) == uncontaminated(was, table(spark, FOLDER, "benchmark").collect()) and kept.columns == columns

    was = {r.doc_id: r for r in kept.collect()}
    kept = saved(STAGE["secrets"](spark, kept, FOLDER), "test-secrets")
    now = {r.doc_id: r for r in kept.collect()}
    assert now.keys() == was.keys() and kept.columns == columns
    for i, r in now.items():
        before, after = was[i].text or "", r.text or ""
        found = any(re.search(p, before) for p in SECRETS)
        assert not found or "[secret]" in after
        assert not any(re.search(p, after) for p in SECRETS[1:])
        assert after == before or "[secret]" in after
        assert r.text is None or r.n_chars == len(after)

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in now.items()}
    mix = STAGE["mixing"](spark, kept, FOLDER).collect()
    total, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, r in now.items():
        total[r.source] += size[i]
        largest[r.source] = max(largest[r.source], size[i])
    target = {}
    for r in mix:
        assert 0 < r.taken <= 2 * size[r.doc_id] and r.size == size[r.doc_id] and r.source_size == total[r.source]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sum(target.values()) == pytest.approx(min(1.5 * sum(total.values()), 2 * sum(total.values())), rel=1e-6)


ODD = "doc_id bigint, source string, lang string, text string, n_chars bigint, size string, taken int, score double, component_id string, n_words int, word int, c int, k int, held_out int, contaminated string, row int, key string, s string"
WORDS = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, "a", "en", WORDS, 1), (1, "a", "en", WORDS, 1), (2, None, None, WORDS, None), (3, "b", "en", None, None), (4, None, "en", "", 0), (None, "a", "en", "alone with no id here", 1),
    (5, "a", "en", "x " * 200_000, 1), (6, "b", "de", WORDS + " extra", 1), (7, "b", "en", "password = hunter2hunter2", 3), (8, "c", "en", " \n\t ", 0),
]
#: Ids that each stage leaves; the mix takes no wordless text.
LEFT = {
    "toxicity": [None, 1, 1, 2, 3, 4, 5, 6, 7, 8], "near_copies": [None, 1, 3, 4, 5, 7, 8], "decontamination": [None, 1, 1, 2, 3, 4, 5, 6, 7, 8], "secrets": [None, 1, 1, 2, 3, 4, 5, 6, 7, 8],
}


def test_stages_take_odd_and_empty_tables(spark):
    odd = spark.createDataFrame([r + ("s", 1, 0.5, "c", 2, 3, 4, 5, 6, "y", 7, "k", "t") for r in ROWS], ODD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SMALL)
        assert set(odd.columns) <= set(out.columns)
        ids = sorted((r.doc_id for r in out.select("doc_id").collect()), key=lambda i: -1 if i is None else i)
        if name in LEFT:
            assert ids == LEFT[name], name
        else:
            assert set(ids) <= {None, 1, 2, 5, 6, 7}
        assert stage(spark, odd.limit(0), SMALL).collect() == [], name
    assert STAGE["secrets"](spark, odd, SMALL).filter(F.col("doc_id") == 7).first().text == "[secret]"  # the name goes with its value
