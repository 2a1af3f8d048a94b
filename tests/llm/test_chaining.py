"""Substring dedup by collinear chaining, against brute force over all windows of words."""

import os
import random

import numpy as np
import pytest

from nickline.llm import chaining
from nickline.llm.jaccard import word_hashes

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]


def found(spark, rows, schema="doc_id long, text string"):
    return [tuple(r) for r in chaining.passages(spark.createDataFrame(rows, schema)).collect()]


def spans(result):
    out = {}
    for d, a, b, *_ in result:
        out.setdefault(d, []).append((a, b))
    return out


def windows(rows, n=chaining.LEAST):
    """(doc_id, place) of each window of n words that a document with another text has too."""
    texts = {}
    for d, text in rows:
        texts.setdefault(text, []).append(d)
    where = {}
    for text in texts:
        w = text.lower().split()
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), []).append((text, i))
    return {(min(texts[t]), i) for at in where.values() if len({t for t, _ in at}) > 1 for t, i in at}


def check(rows, result):
    have = spans(result)
    missing = [(d, i) for d, i in windows(rows) if not any(a <= i and i + chaining.LEAST <= b for a, b in have.get(d, []))]
    assert not missing
    for _, a, b, _, c, e, m in result:
        assert min(b - a, e - c) >= chaining.LEAST


def test_exact_passages_in_many_texts(spark):
    rng = random.Random(3)
    shared = [words(rng, n) for n in (51, 60, 200)]
    rows = []
    for i in range(60):
        part = shared[i % 3] if i < 45 else []
        rows.append((i, " ".join(words(rng, rng.randint(0, 80)) + part + words(rng, rng.randint(0, 80)))))
    result = found(spark, rows)
    check(rows, result)
    assert {r[0] for r in result} == set(range(45))


def test_fuzzy_passages(spark):
    rng = random.Random(4)
    base = words(rng, 150)
    rows, planted = [(0, " ".join(words(rng, 30) + base + words(rng, 30)))], {0: (30, 180)}
    for i in range(1, 8):
        part = list(base)
        for at in sorted(rng.sample(range(5, 145), 6), reverse=True):
            kind = rng.randrange(3)
            part[at : at + 1] = [[words(rng, 1)[0]], [], [part[at], words(rng, 1)[0]]][kind]
        rows.append((i, " ".join(words(rng, 40) + part + words(rng, 20))))
        planted[i] = (40, 40 + len(part))
    result = found(spark, rows)
    assert {r[0] for r in result} == set(range(8))
    covered = {}
    for d, a, b, *_ in result:
        assert planted[d][0] <= a and b <= planted[d][1]
        covered.setdefault(d, set()).update(range(a, b))
    # ends stop at the first differing word beyond the outermost seeds, so edits near an end shorten a passage
    assert all(len(c) >= 75 for c in covered.values())


def test_short_passages_and_clean_texts_have_no_row(spark):
    rng = random.Random(5)
    line = words(rng, 40)
    rows = [(i, " ".join(words(rng, 100) + line + words(rng, 100))) for i in range(30)]
    assert found(spark, rows) == []


def test_repeating_stretches(spark):
    rng = random.Random(6)
    unit = words(rng, 3)
    rows = [(1, " ".join(words(rng, 20) + unit * 40)), (2, " ".join((unit * 30)[1:] + words(rng, 20))), (3, " ".join(words(rng, 10) + ["x"] * 300))]
    result = found(spark, rows)
    check(rows, result)
    assert {r[0] for r in result} == {1, 2}


def test_odd_rows(spark):
    rng = random.Random(7)
    long, short = " ".join(words(rng, 70)), " ".join(words(rng, 10))
    rows = [(1, long), (1, long), (5, long), (None, long), (2, None), (3, ""), (4, short), (6, short), (7, " ".join(words(rng, 30_000)) + " " + long)]
    result = [(d, a, b, o, h) for d, a, b, o, _, _, h in found(spark, rows)]
    assert {(1, 0, 70, 5, 70), (5, 0, 70, 1, 70), (None, 0, 70, 1, 70)} <= set(result)
    assert (7, 30_000, 30_070, 1, 70) in result and (1, 0, 70, 7, 70) in result
    assert {r[0] for r in result} == {1, 5, 7, None}
    assert found(spark, []) == []


def test_one_text_twice_under_one_id_is_one_document(spark):
    text = " ".join(words(random.Random(8), 60))
    assert found(spark, [(1, text), (1, text)]) == []


def test_names_that_clash(spark):
    text = " ".join(words(random.Random(9), 60))
    docs = spark.createDataFrame([(1, text, "x", 1, 2, 3), (2, text, None, 1, 2, 3)], "doc_id long, text string, s string, t int, n int, h int")
    assert {r.doc_id for r in chaining.passages(docs).collect()} == {1, 2}


def by_hash(spark, rows):
    """The rows, those of the smallest text hashes first."""
    from pyspark.sql import functions as F

    return [tuple(r) for r in spark.createDataFrame(rows, "doc_id long, text string").orderBy(F.xxhash64("text")).collect()]


def test_every_copy_in_the_first_holder_has_a_row(spark):
    rng = random.Random(12)
    passage = words(rng, 60)
    for _ in range(20):  # the text of the smaller hash has the passage twice
        twice = " ".join(words(rng, 40) + passage + words(rng, 100) + passage + words(rng, 30))
        rows = [(1, twice), (2, " ".join(words(rng, 30) + passage + words(rng, 30)))]
        if by_hash(spark, rows)[0][0] == 1:
            break
    result = found(spark, rows)
    check(rows, result)
    assert {(40, 100), (200, 260)} <= {(a, b) for d, a, b, *_ in result if d == 1}


def test_halves_quoted_elsewhere_hide_no_passage(spark):
    rng = random.Random(13)
    passage = words(rng, 80)
    rows = [(i, " ".join(words(rng, 30) + passage + words(rng, 30))) for i in range(2)]
    # under 50 words of either half in many others, so some of these hold every seed first and last
    rows += [(2 + i, " ".join(words(rng, 30) + (passage[:45] if i % 2 else passage[35:]) + words(rng, 30))) for i in range(60)]
    assert not {0, 1} & {by_hash(spark, rows)[i][0] for i in (0, 1, 2, -1, -2, -3)}
    result = found(spark, rows)
    check(rows, result)
    assert {r[0] for r in result} == {0, 1}


def test_edited_copies_between_partial_ones(spark):
    rng = random.Random(14)
    base = words(rng, 120)

    def edited(every):
        return [words(rng, 1)[0] if i % every == every // 2 else w for i, w in enumerate(base)]

    rows = [(i, " ".join(words(rng, 20) + edited(40 + i) + words(rng, 20))) for i in range(2)]
    # others hold runs of 15 words of it between their own
    rows += [(2 + i, " ".join(x for j in range(i % 30, 120, 30) for x in base[j : j + 15] + words(rng, 25))) for i in range(60)]
    assert not {0, 1} & {by_hash(spark, rows)[i][0] for i in (0, 1, 2, -1, -2, -3)}
    assert {0, 1} <= {r[0] for r in found(spark, rows)}


def test_overlapping_cuts_of_one_text(spark):
    rng = random.Random(15)
    base = words(rng, 400)
    rows = []
    for i in range(40):
        at = rng.randrange(300)
        rows.append((i, " ".join(words(rng, 20) + base[at : at + 100] + words(rng, 20))))
    check(rows, found(spark, rows))


def test_work_on_a_common_line_grows_in_proportion(spark, monkeypatch):
    rng = random.Random(16)
    line = words(rng, 30)
    made, plain = [], chaining.saved

    def counted(df, name):
        out = plain(df, name)
        if name == "chain-links":
            made.append(out.count())
        return out

    monkeypatch.setattr(chaining, "saved", counted)
    for n in (50, 200):
        assert found(spark, [(i, " ".join(words(rng, 40) + line + words(rng, 40))) for i in range(n)]) == []
    few, many = sum(made[:2]), sum(made[2:])
    assert many <= 5 * few


def test_edited_copies_among_holders_of_all_their_stretches(spark):
    rng = random.Random(17)
    base = words(rng, 120)
    rows = [(i, " ".join(words(rng, 20) + [words(rng, 1)[0] if j % (40 + i) == 20 else w for j, w in enumerate(base)] + words(rng, 20))) for i in range(2)]
    # others hold 45 words of it in a row, so all pairs of its seeds, but no passage
    rows += [(2 + i, " ".join(words(rng, 30) + base[at : at + 45] + words(rng, 30))) for i, at in enumerate(list(range(0, 76, 5)) * 8)]
    assert not {0, 1} & {by_hash(spark, rows)[i][0] for i in (0, 1, 2, -1, -2, -3)}
    covered = {}
    for d, a, b, *_ in found(spark, rows):
        covered.setdefault(d, set()).update(range(a, b))
    assert set(covered) == {0, 1} and all(len(c) >= 100 for c in covered.values())


def test_a_common_line_alone_makes_no_links_with_all_its_holders(spark, monkeypatch):
    rng = random.Random(18)
    line, made, plain = words(rng, 30), {}, chaining.saved

    def counted(df, name):
        out = plain(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(chaining, "saved", counted)
    assert found(spark, [(i, " ".join(words(rng, 40) + line + words(rng, 40))) for i in range(100)]) == []
    assert made["chain-apart"] and made["chain-others"] == 0


def test_chains_are_the_best(spark):
    """The Fenwick tree's scores against trying every predecessor."""
    rng = random.Random(10)
    for _ in range(50):
        anchors = sorted((rng.randrange(200), rng.randrange(200), rng.randrange(3, 20), False) for _ in range(rng.randrange(1, 40)))
        score = {}
        for i in sorted(range(len(anchors)), key=lambda i: anchors[i][:2]):
            x, y, n, _ = anchors[i]
            score[i] = n + max([0.0] + [score[j] - chaining.GAP * (x - u - m + y - v - m) for j, (u, v, m, _) in enumerate(anchors) if u + m <= x and v + m <= y and j in score])
        best = chaining.chains(anchors)[0]
        got = sum(anchors[i][2] for i in best)
        for i, j in zip(best, best[1:]):
            (u, v, m, _), (x, y, *_) = anchors[i], anchors[j]
            got -= chaining.GAP * (x - u - m + y - v - m)
        assert got == pytest.approx(max(score.values()))


def test_any_long_enough_run_has_a_seed():
    word = word_hashes(" ".join(words(random.Random(11), 400)).encode())
    for k, w in chaining.SEEDS:
        _, at = chaining.winnowed(word, k, w)
        assert np.diff(np.concatenate([[-1], at, [len(word) - k + 1]])).max() <= w
        inner = set((at + 0).tolist())
        h, part = chaining.winnowed(word[100:200], k, w)
        assert {p for p in (part + 100).tolist() if 100 + w <= p < 200 - k - w} <= inner


@tables
def test_whole_table(spark):
    import __spark_entry__

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    result = [tuple(r) for r in __spark_entry__.queries()["op4_chaining"](spark, FOLDER).collect()]
    rows = [(d, text or "") for d, text in docs]
    texts = dict(rows)
    check(rows, result)
    for d, a, b, o, c, e, m in result:
        u, v = texts[d].lower().split(), texts[o].lower().split()
        assert 0 <= a < b <= len(u) and 0 <= c < e <= len(v) and d != o
        assert m >= chaining.ALIKE * max(b - a, e - c)


def test_near_copies_do_not_all_meet(spark):
    """Copies with edits of their own meet a few others, and all holders only where these gave nothing."""
    rng, base, n = random.Random(19), words(random.Random(20), 150), 60
    result = found(spark, [(i, " ".join(w if rng.random() < 0.97 else words(rng, 1)[0] for w in base)) for i in range(n)])
    assert {r[0] for r in result} == set(range(n))
    assert len(result) <= 10 * n
