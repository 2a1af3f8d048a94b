"""Template deduction against plain occurrence vectors and orders."""

import itertools
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from nickline.llm import pages


def extracted(spark, htmls, **how):
    df = spark.createDataFrame([(i, f"http://h.com/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return {r.row.page_id: r.text for r in pages.extract(df, **how).collect()}


def plain_template(htmls):
    """The valid classes of one host's pages, each as a set of tokens: vectors kept whole, orders compared page by page."""
    htmls = sorted(set(htmls))
    seen = [[(p, t) for p, t, _, out in pages.sequence(h) if t is None or not out] for h in htmls]
    classes: dict = {}
    for token in {x for s in seen for x in s}:
        vector = tuple(s.count(token) for s in seen)
        n = sum(map(bool, vector))
        if n >= pages.SUPPORT * len(seen) and (token[1] is None or n >= pages.TEXT_PAGES):
            classes.setdefault(vector, set()).add(token)
    out = []
    for tokens in classes.values():
        order = sorted(tokens, key=lambda x: (sum(s.index(x) for s in seen if x in s), x[0], (x[1] is not None, x[1])))
        wrong = dict.fromkeys(order, 0)
        for s in seen:
            stood = [x for x in s if x in tokens]
            if len(set(stood)) < len(stood):
                bad = {x for i, x in enumerate(stood) if x != order[i % len(order)]}
            else:
                most = max((c for n in range(len(stood) + 1) for c in itertools.combinations(stood, n) if list(c) == sorted(c, key=order.index)), key=len)
                bad = set(stood) - set(most)
            for x in bad:
                wrong[x] += 1
        out.append(frozenset(x for x in order if wrong[x] <= pages.DISORDER * len(seen)))
    return {x for x in out if x}


def random_pages(seed):
    rng, out = random.Random(seed), []
    for i in range(6):
        rows = "".join(f"<div class=row><b>Row</b><p>{rng.randint(0, 99)}</p></div>" for _ in range(rng.randint(1, 3)))
        note = "<section>Note</section>" if i % 3 else ""
        body = f"<div class=top><p>Same</p></div>{note}<div class=mid><p>Own {i}</p>{rows}</div>"
        out.append(f"<body>{body}<div class=end>End</div></body>")
    return out


def test_templates_are_classes_of_equal_vectors(spark):
    for seed in range(3):
        htmls = random_pages(seed)
        rows = [(f"http://h.com/{i}", h) for i, h in enumerate(htmls + htmls[:2])]  # copies count once
        got = pages.templates(spark.createDataFrame(rows, "url string, html string")).collect()
        classes = json.loads(got[0].template)
        assert {frozenset((t["token"], t["text"]) for t in c["tokens"]) for c in classes} == plain_template(htmls)


@settings(max_examples=200, deadline=None)
@given(st.permutations(range(5)), st.integers(0, 5))
def test_fewest_tokens_are_out_of_order(order, n):
    order = list(order)[:n]
    want = max((len(c) for k in range(n + 1) for c in itertools.combinations(order, k) if list(c) == sorted(c)), default=0)
    got = pages._rising(order)
    assert len(got) == want and sorted(got) == [x for x in order if x in got]


def test_a_token_out_of_order_leaves_its_class(spark):
    page = "<body><div class=a>%s</div><div class=b><p>Text %d of it</p>%s</div></body>"
    note = "<p>Neutral note</p>"
    # in one place on all pages it is template; in two places by turns its paths differ, and it is no one's
    assert extracted(spark, [page % ("x", i, note) for i in range(4)])[0] == "Text 0 of it"
    html = ["<body><p>Left</p><p>Right</p><div><p>Text %d goes on for a while</p></div></body>" % i if i % 2 else "<body><p>Right</p><p>Left</p><div><p>Text %d goes on for a while</p></div></body>" % i for i in range(6)]
    classes = json.loads(pages.templates(spark.createDataFrame([(f"http://h.com/{i}", h) for i, h in enumerate(html)], "url string, html string")).first().template)
    texts = [t for c in classes for t in c["tokens"] if t["text"] is not None]
    assert len(texts) == 1  # of two that change places, one keeps the order


def test_neutral_names_only(spark):
    menu = "<div class=k1><div><a href=/>One</a></div><div>Two</div></div>"
    page = "<body>" + menu + "<div class=k4>Bought %d times, %s</div><div class=k2><h1>Title %d</h1><p>%s</p></div><div class=k3><p>Copyright The Daily</p></div></body>"
    htmls = [page % (i, "buy " * i, i, f"Word {i} " * 12) for i in range(5)]
    want = {i: f"Title {i}\n" + (f"Word {i} " * 12).strip() for i in range(5)}
    assert extracted(spark, htmls) == extracted(spark, htmls, hints=False) == want
    assert extracted(spark, htmls[:1], hints=False) == {0: want[0]}


def test_a_short_article_is_found_by_the_template_alone(spark):
    page = "<body><div class=k1>%s</div><div class=k2><p>%s</p></div></body>"
    notice = "This host says the same at length on each of its pages, " * 3
    htmls = [page % (notice, f"Short {i}.") for i in range(4)]
    assert extracted(spark, htmls) == {i: f"Short {i}." for i in range(4)}
    assert extracted(spark, htmls, template=False) != extracted(spark, htmls)


def test_a_menu_300_levels_deep(spark):
    deep = "<div>" * 300
    htmls = [f"<body><div class=k2>{deep}<nav>Menu {i}</nav>{'</div>' * 300}<p>Text {i} of the page</p></div></body>" for i in range(4)]
    assert extracted(spark, htmls) == {i: f"Text {i} of the page" for i in range(4)}


def test_a_third_of_all_pages_on_one_host_and_empty_pages(spark):
    rows = [("http://h.com/", f"<body><div class=t>Same</div><main><p>Text {i}</p></main></body>", i) for i in range(40)] + [(f"http://h{i}.com/", None if i % 2 else "", i) for i in range(20)] + [(None, "<p>x", 1)]
    df = spark.createDataFrame(rows, "url string, html string, text int")
    got = {(r.row.url, r.row.text): r.text for r in pages.extract(df).collect()}
    assert len(got) == 61 and got[("http://h.com/", 7)] == "Text 7" and got[(None, 1)] == "x" and got[("http://h1.com/", 1)] == ""
