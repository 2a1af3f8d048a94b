"""Decontamination, secrets, licenses, mixing and archives against plain walks."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nickline.llm import archives, decontaminate, licenses, mixing, secrets

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UP))


# decontamination


def plain_hits(text, items):
    w, hit, which = words(text), set(), set()
    for k, item in items:
        iw = words(item)
        n = min(13, len(iw))
        for i in range(len(iw) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == iw[i : i + n]:
                    hit |= set(range(j, j + n))
                    which.add(str(k))
    return len(w), len(hit), sorted(which)


ITEMS = [(1, " ".join(f"q{i}" for i in range(20))), (2, "Short one"), (10, "short ONE, é"), (3, ""), (4, None), (5, "a a a a a a a a a a a a a a a")]
TEXTS = [
    None, "", "!!!", "x " * 50 + " ".join(f"Q{i}" for i in range(3, 17)) + " y", "short one", "Short-one é short", "a " * 30, "K a", "é" * 5, "short\none\x00two " * 3, " ".join(f"q{i}" for i in range(12)),
    " ".join(f"q{i}" for i in range(20)) + " z" * 900,
]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_NODES, 300])
def test_decontamination(spark, block):
    docs = spark.createDataFrame([(i % 7, t, "x") for i, t in enumerate(TEXTS)] + [(None, "short one", "y")], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.judged(decontaminate.scan(docs, bench, block_nodes=block)).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        n, hit, items = plain_hits(r.row.text, ITEMS)
        assert (r.n_words, r.n_hit, r.n_items, r["items"]) == (n, hit, len(items), items)
        assert r.items_sha256 == hashlib.sha256(",".join(items).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
        for s, c in zip(r.spans, r.chars):
            assert words(r.row.text[c.first : c.end]) == words(r.row.text)[s.first : s.end]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=6), st.integers(1, 400))
def test_blocks_hold_every_window_once(sizes, nodes):
    class Rows:
        def __getattr__(self, name):
            return lambda *a: self

        def toLocalIterator(self):
            return iter([(str(i), " ".join(f"w{i}x{j}" for j in range(n))) for i, n in enumerate(sizes)])

    import unittest.mock

    with unittest.mock.patch.object(decontaminate, "F", unittest.mock.MagicMock()):
        blocks = list(decontaminate._blocks(Rows(), "i", "t", 13, nodes))

    def windows(items):
        return [(k, tuple(w[i : i + 13])) for k, t in items for w in [t.split()] for i in range(max(1, len(w) - 12) if w else 0)]

    plain = [(str(i), " ".join(f"w{i}x{j}" for j in range(n)).encode()) for i, n in enumerate(sizes)]
    assert sorted(windows([x for b in blocks for x in b])) == sorted(windows(plain))
    for b in blocks:
        each = windows(b)
        assert sum(sum(len(w) + 1 for w in x) + 1 for _, x in each[:-1]) <= nodes


def test_no_benchmark_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, none).collect()[0].text == "a b"
    assert decontaminate.scan(docs.limit(0), none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "A", "."]), max_size=25), st.lists(st.lists(st.sampled_from(["a", "b", "é"]), max_size=16), max_size=3))
def test_automaton(text, items):
    text, items = " ".join(text), [(i, " ".join(w)) for i, w in enumerate(items)]
    search = decontaminate.automaton([(str(k), t.encode()) for k, t in items], 13)
    n, spans, which = decontaminate.occurrences(text.encode(), search)
    want = plain_hits(text, items)
    assert (n, sum(b - a for a, b in spans), sorted(str(items[k][0]) for k in which)) == want


# secrets


def plain_secrets(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


PIECES = ["password", "PassWd", "secret", "toKen", "api_key", "apikey", "=", ": ", " ", '"', "abcdefgh", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef" * 2, "é", "\n", "ſecret=abcdefgh1", "x", "token=short", "AKIAAKIAAKIAAKIA1"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_base_secrets(parts):
    text = "".join(parts)
    assert [s for s in secrets.spans(text.encode()) if s[0] in secrets.KINDS[:3]] == plain_secrets(text)


def test_checksums():
    body = "A" * 30
    good = "ghp_" + body + secrets.base62(zlib.crc32(body.encode()))
    assert secrets.spans(f"é {good} .".encode()) == [("checked", 2, 42)]
    assert secrets.spans(("ghp_" + body + "000000").encode()) == []


def test_secret_rows(spark):
    docs = spark.createDataFrame([(1, None, 0, "f"), (2, "", 0, "f"), (2, "é token = abcdefghij é", 22, "f"), (None, "x" * 100_000 + " secret: 12345678", 5, "f")], "doc_id long, text string, n_chars long, found string")
    got = {(r.row.doc_id, None if r.row.text is None else len(r.row.text)): [(s.kind, s.start, s.end) for s in r.found] for r in secrets.scan(docs).collect()}
    assert got[(1, None)] == got[(2, 0)] == [] and got[(2, 22)] == [("assign", 2, 20)] and len(got[(None, 100_017)]) == 1
    red = {(r.doc_id, r.text) for r in secrets.redacted(docs).collect()}
    assert (2, "é [secret] é") in red and (1, None) in red
    assert secrets.scan(docs.limit(0)).count() == 0


# licenses


def plain_licenses(text):
    w = words(text)
    found = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_licenses(spark):
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "apache LICENSE", "general public license mit license", "general public", "", None, "mit", "mit license " * 5, "Licensed under the very Apache License, Version 2.0 now", "Licensed under the Apache and that is all of Version 2.0", "mit\nlicense", "x" * 1000 + " mit license"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(lines)] + [(3, "mit license", "z"), (None, "mit license", "z"), (0, lines[0], "z")], "doc_id long, text string, labels string")
    got = licenses.scan(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels))
    for i, t in enumerate(lines):
        assert plain_licenses(t) in [x[:5] for x in by[i]]
    assert by[None][0][:5] == plain_licenses("mit license") and len(by[0]) == 2
    assert by[1][0][5] == "cc-by-nc" and by[9][0][5] == "apache" and by[10][0][5] == "" and by[0][0][5] == "mit"
    assert all(0 <= r.score <= 1 for r in got)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_whole_notices_with_edits_and_long_texts(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for i, (label, text) in enumerate(licenses.TEMPLATES):
        w = text.split()
        if len(w) > 60:
            for at in rng.sample(range(5, len(w) - 5), 3):
                w[at] = "edited"
        fill = " ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000 if i == 1 else 30))
        rows.append((i, f"{fill} {' '.join(w).upper()} {fill}"))
        want[i] = label
    rows.append((100, " ".join(licenses.TEMPLATES[1][1].split()[:40])))  # a third of a notice is none
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i].labels for i in want} == want or all(want[i] in got[i].labels.split(",") for i in want)
    assert "mit" in got[100].labels.split(",")  # but its first sentence is a template of its own
    assert got[1].n_words > 40_000


def test_many_templates_meet_in_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0"), (2, None)], "doc_id long, text string")
    want = sorted(map(str, licenses.scan(docs).collect()))
    monkeypatch.setattr(licenses, "BROADCAST_GRAMS", 0)
    assert sorted(map(str, licenses.scan(docs).collect())) == want


# mixing


def cheapest(patterns, quotas, copies):
    """Least cost of the largest flow, by trying all whole routes."""
    import itertools

    arcs = [(p, s) for p in patterns for s in p]
    best = (0, 0)
    for x in itertools.product(*[range(min(copies * patterns[p], quotas[s]) + 1) for p, s in arcs]):
        used = {p: sum(v for v, (q, _) in zip(x, arcs) if q == p) for p in patterns}
        if any(used[p] > copies * patterns[p] for p in patterns) or any(sum(v for v, (_, t) in zip(x, arcs) if t == s) > quotas[s] for s in quotas):
            continue
        cost = sum(k * min(patterns[p], max(0, used[p] - k * patterns[p])) for p in patterns for k in range(copies))
        best = max(best, (sum(x), -cost))
    return best


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.sampled_from([("a",), ("b",), ("a", "b"), ("b", "c")]), st.integers(1, 2), min_size=1), st.fixed_dictionaries({s: st.integers(0, 3) for s in "abc"}))
def test_routes_are_cheapest(patterns, quotas):
    out = mixing.route(patterns, quotas, 2)
    used = {p: sum(v for (q, _), v in out.items() if q == p) for p in patterns}
    for s in quotas:
        assert sum(v for (_, t), v in out.items() if t == s) <= quotas[s]
    cost = sum(k * min(patterns[p], max(0, used[p] - k * patterns[p])) for p in patterns for k in range(2))
    assert (sum(out.values()), -cost) == cheapest(patterns, quotas, 2)


@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=2)), st.integers(0, 1000), min_size=1, max_size=6))
def test_targets(sizes):
    goal = mixing.targets(sizes)
    assert all(0 <= goal[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert sum(goal.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mixing_rows(spark):
    rng = random.Random(1)
    rows = [(i % 50, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))), rng.choice(["b", "a", None, "ä"]), 5) for i in range(200)] + [(None, None, "a", 5), (7, "x y z", "a", 5), (7, "x y z", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(3)).collect()))
    for goal, part in {r.target: [x for x in got if x.target == r.target] for r in got}.items():
        assert all(0 <= r.taken <= 2 * r.size for r in part)
        assert abs(sum(r.taken for r in part) - goal) <= 5
    kept = mixing.mix(docs, keep=True)
    assert kept.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_shares_overlap(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "w " * 10, ["a"] if i % 2 else ["a", "b"]) for i in range(40)], "doc_id long, text string, member array<string>")
    got = mixing.mix(docs, sources=F.col("member")).collect()
    assert sum(r.taken for r in got) <= 800 and all(r.taken <= 2 * r.size for r in got)


# archives


def test_loser_tree():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        assert list(archives.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_archives_round_trip(spark):
    big = "q" * 1500
    rows = [(1, "http://b.a/x\ny", big), (2, None, big), (None, "http://b.a/", None), (3, "http://a.b/é", "é" * 20), (3, "http://a.b/é", "é" * 20), (5, "http://b.a/x", "\r\n\r\nWARC/1.1" * 200), (None, "u", big), (6, "http://b.a/x?q", "é" * 500), (7, "http://c.a/", "é" * 500), (8, "u", "q" * 999), (9, "u", "q" * 999)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = archives.history(pages).orderBy("range", "place").collect()
    assert [archives.order(r.asDict()) for r in got] == sorted(archives.order(r.asDict()) for r in got)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        head = max((j for j, _, x in rows if (x or "") == (h or "") and j is not None), default=None)
        revisit = len(data) >= 1000 and head is not None and i != head
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", head if revisit else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert archives.history(pages.limit(0)).count() == 0
