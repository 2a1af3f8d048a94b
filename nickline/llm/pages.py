"""Main text of web pages by deducing each host's template.

A page is a sequence of tokens: its block elements, each named by its path, and its blocks of text, word for word.  Tokens whose occurrence
vectors (their counts on each page of the host) are equal form a class.  A class is valid as far as its tokens stand in the same order,
over and over, on the host's pages; tokens out of that order leave it.  Valid classes nest: a text that is in a class with an element around
it stands wherever the element does and is template; an element that stands once a page is a container, and containers nest in each other.
What the containers hold besides the template's text is their slots.  From the root the search goes into the container that holds most of its
parent's slots, as long as one does; what the innermost holds, less the template, is the main text.

HTML's own elements for menus, footers and the like hold no slots; nor do elements with a class, id or role that says so, which is for boxes
whose text differs from page to page, and for pages without a template (`hints=False` reads no such names).
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, packed, per_text, saved, small_batches, table

#: Tokens of a template occur on at least this share of the host's pages.
SUPPORT = 0.5
#: Pages of a host, different ones, that a text must stand on to be the template's: two may share a quotation.
TEXT_PAGES = 3
#: A container is entered if it holds at least this share of what its parent's slots hold.
MOST = 0.6
#: Share of a host's pages on which a token may be out of its class's order.
DISORDER = 0.1
#: Bytes of templates that may be broadcast; beyond, pages and templates meet in a shuffle.
BROADCAST_BYTES = 8_000_000

#: Elements of a path that are named: a deeper element goes by the path of its ancestor there.
NAMED = 200

#: HTML's elements without content, with raw content, and those that make no block of their own.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold no article text, and words of class, id and role that say so.
OUTSIDE = frozenset("nav header footer aside form menu dialog button fieldset head".split())
_WORD = re.compile(r"(?:^|[-_ ])(ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|nav\w*|menu|breadcrumbs?|header|masthead|footer|side-?bar|aside|comments?|disqus|respond|replies|social|share|sharing|related|recommend\w*|subscribe|newsletter|popup|modal|login|search|pagination|pager|navigation|complementary|contentinfo|form)(?:$|[-_ ])")
#: Elements that hold one block of text, which aren't entered as containers.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address figcaption caption blockquote th".split())
_SELF = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


_DIGITS = re.compile(r"\d+")


def _name(tag: str, attrs: str, hints: bool) -> tuple[str, bool]:
    """The element's part of a path, and whether it stands outside the article.  Numbers in an id, and in classes that repeat it, are the page's own: they count as equal."""
    if not attrs:
        return tag, tag in OUTSIDE
    got = {m[1].lower(): " ".join((m[2] or m[3] or m[4] or "").lower().split()) for m in _ATTR.finditer(attrs)}
    outside = tag in OUTSIDE or hints and any(_WORD.search(x) for v in got.values() for x in v.split())
    # an article's class and id may be its page's own
    said = (("role", "@"),) if tag in ("article", "main") and not outside else (("class", "."), ("id", "#"), ("role", "@"))
    if (own := got.get("id")) and _DIGITS.search(own):
        got |= {"id": _DIGITS.sub("0", own), "class": " ".join("" if c == own else c for c in got.get("class", "").split()).strip()}
    return tag + "".join(mark + got[k].replace(">", "").replace(" ", ".") for k, mark in said if got.get(k)), outside


def tokens(page: str, hints: bool = True) -> Iterator[tuple[tuple[str, ...], bool, str | None]]:
    """(path, outside, text) of each block of text and, with None as text, of each opened element, in order."""
    out, stack, text = [], [((), (), False)], []  # an open element: tag, path, whether it or one around it stands outside
    standing = Counter()  # how many elements of a tag are open
    at, end = 0, len(page)

    def flush():
        if text:
            said = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if said:
                out.append((stack[-1][1], stack[-1][2], said))

    def close(tags, scope=()):
        if not any(standing[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                standing.subtract(x[0] for x in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in scope:
                return

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            text.append(page[at:])
            break
        if lt > at:
            text.append(page[at:lt])
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):  # the page ends within a tag
                break
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = stop.start() if stop else end
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            continue
        flush()
        if closing:
            close({tag})
        elif tag not in VOID:
            close(_SELF.get(tag, {"p"} if tag not in ("html", "body") else ()), _SCOPE.get(tag, ()) if tag in _SCOPE else ("article", "main", "section", "div", "td", "li", "body", "blockquote"))
            name, outside = _name(tag, m[3], hints)
            path = stack[-1][1]
            if len(path) < NAMED:
                path = (*path, name)
                out.append((path, outside or stack[-1][2], None))
            stack.append((tag, path, outside or stack[-1][2]))
            standing[tag] += 1
    flush()
    return out


def blocks(page: str, hints: bool = True) -> tuple[list[tuple[tuple[str, ...], bool, str]], Counter]:
    """(path, outside, text) of each block of text in order, and how often each path was opened."""
    found = tokens(page, hints)
    return [x for x in found if x[2] is not None], Counter(path for path, _, said in found if said is None)


def host_of(url):
    """The host of a URL column, in lower case; the empty string where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def _text_hash(path: str, said: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}\0{said}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def sequence(page: str, hints: bool = True) -> list[tuple[str, int | None, int, bool]]:
    """(path, hash of the text or None, characters, outside) of a page's tokens in order, from the root on."""
    out: list[tuple[str, int | None, int, bool]] = [("", None, 0, False)]
    for path, outside, said in tokens(page, hints):
        at = ">".join(path)
        out.append((at, None, 0, outside) if said is None else (at, _text_hash(at, said), len(said), outside))
    return out


def _around(path: str) -> Iterator[str]:
    """The path and those around it, outermost (the root) first."""
    yield ""
    at = path.find(">")
    while at >= 0:
        yield path[:at]
        at = path.find(">", at + 1)
    if path:
        yield path


def _observed(hints: bool):
    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """host, token, text, pages, total, print, chars, place: a task's tokens, summed a batch at a time; text is a hash, null for elements.

        place: where the token stands first on a page; chars: of what an element holds, or of a text.
        """
        for batch in batches:
            sums: dict = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count, chars, place = Counter(), Counter(), {}
                for nr, (path, text, n, outside) in enumerate(sequence(page, hints)):
                    if text is not None and outside:
                        continue
                    count[path, text] += 1
                    place.setdefault((path, text), nr)
                    if text is not None:
                        chars[path, text] += n
                        for p in _around(path):
                            chars[p, None] += n
                mark = int.from_bytes(hashlib.blake2b(page.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")
                for (path, text), n in count.items():
                    s = sums.setdefault((host, path, text), [0, 0, 0, 0, 0])
                    s[0] += 1
                    s[1] += n
                    s[2] = (s[2] + n * mark) & 0x7FFF_FFFF_FFFF
                    s[3] += chars[path, text]
                    s[4] += place[path, text]
            if sums:
                yield pa.RecordBatch.from_pylist([{"host": h, "token": t, "text": x, **dict(zip(_SUMS, s))} for (h, t, x), s in sums.items()], _SEEN)

    return observe


_SUMS = ("pages", "total", "print", "chars", "place")
_SEEN = pa.schema([("host", pa.string()), ("token", pa.string()), ("text", pa.int64()), *((c, pa.int64()) for c in _SUMS)])


def misplaced(page: str, classes: list[dict], hints: bool = True) -> Iterator[tuple[int, int]]:
    """(class, place in it) of the tokens that stand out of their class's order on a page.

    A class's tokens must stand in its order, over and over.  Of a class that stands once, the fewest tokens are out of order; of others,
    those that stand where another one should.
    """
    at = {(t["token"], t["text"]): (c, k) for c, x in enumerate(classes) if len(x["tokens"]) > 1 for k, t in enumerate(x["tokens"])}
    stood: dict[int, list[int]] = {}
    for path, text, _, outside in sequence(page, hints):
        if (text is None or not outside) and (found := at.get((path, text))):
            stood.setdefault(found[0], []).append(found[1])
    for c, seen in stood.items():
        n = len(classes[c]["tokens"])
        if seen == [k % n for k in range(len(seen))]:
            continue
        if len(set(seen)) == len(seen):
            rising = _rising(seen)
            yield from ((c, k) for k in seen if k not in rising)
        else:
            yield from ((c, k) for k in sorted({k for nr, k in enumerate(seen) if k != nr % n}))


def _rising(seen: list[int]) -> set[int]:
    """The longest rising run of members, in order but not side by side."""
    ends: list[int] = []  # places in seen: the smallest end of a rising run of each length
    back: list[int] = []
    for i, x in enumerate(seen):
        n = bisect.bisect_left([seen[e] for e in ends], x) if ends and seen[ends[-1]] >= x else len(ends)
        back.append(ends[n - 1] if n else -1)
        ends[n : n + 1] = [i]
    out, i = set(), ends[-1] if ends else -1
    while i >= 0:
        out.add(seen[i])
        i = back[i]
    return out


def _checked(hints: bool):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """host, class, place, n: on how many pages of a batch a token is out of order; class -1: how many pages there are."""
        read: dict = {}
        for batch in batches:
            sums: Counter = Counter()
            for host, page, template in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if template not in read:
                    if len(read) > 1000:
                        read.clear()
                    read[template] = json.loads(template)
                sums[host, -1, -1] += 1
                for c, k in misplaced(page or "", read[template], hints):
                    sums[host, c, k] += 1
            if sums:
                yield pa.RecordBatch.from_pylist([{"host": h, "class": c, "place": k, "n": n} for (h, c, k), n in sums.items()], _WRONG)

    return check


_WRONG = pa.schema([("host", pa.string()), ("class", pa.int32()), ("place", pa.int32()), ("n", pa.int64())])


def _with(rows: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """rows with their host's template; templates are broadcast behind a check of their size, larger ones meet the rows in a shuffle."""
    size = known.agg(F.sum(F.length("template") + F.length("host"))).first()[0] or 0
    return rows.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host", how)


def templates(pages: DataFrame, url: str = "url", page: str = "html", hints: bool = True) -> DataFrame:
    """host, template: each host's valid classes of tokens with equal occurrence vectors as JSON, (once, tokens), a token as (token, text, chars).

    Equal pages of a host are one.  An occurrence vector is kept as a sum over pages, so that it adds up before the shuffle and a host with a third of all
    pages sends each task's sums only.  Tokens of under half of the host's pages belong to no template.  A second pass over the pages counts where
    tokens are out of their class's order.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.coalesce(F.col(f"`{page}`"), F.lit("")).alias("page"))
    seen = rows.distinct().mapInArrow(_observed(hints), f"host string, token string, text bigint, {', '.join(f'{c} bigint' for c in _SUMS)}")
    seen = seen.groupBy("host", "token", "text").agg(*[F.sum(c).alias(c) for c in _SUMS])
    seen = saved(seen.filter(F.col("text").isNull() | (F.col("pages") >= TEXT_PAGES)), "tokens")
    known = seen.groupBy("host").agg(F.max(F.when((F.col("token") == "") & F.col("text").isNull(), F.col("pages"))).alias("all"))
    lasting = seen.join(known, "host").filter(F.col("pages") >= SUPPORT * F.col("all"))
    # where tokens of a class stand in the same order on all of its pages, their places' sums do, too
    one = F.struct("place", "token", "text", "chars")
    classes = lasting.groupBy("host", "pages", "total", "print").agg(F.sort_array(F.collect_list(one)).alias("tokens"))
    one = F.struct((F.col("pages") == F.col("total")).alias("once"), "tokens")
    found = classes.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(one)), {"ignoreNullFields": "false"}).alias("template"))
    found = saved(found, "classes")
    drop(seen)
    wrong = _with(rows, found, "inner").select("host", "page", "template").mapInArrow(_checked(hints), "host string, class int, place int, n bigint")
    wrong = wrong.groupBy("host", "class", "place").agg(F.sum("n").alias("n"))
    wrong = wrong.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("class", "place", "n"))).alias("wrong"))
    out = found.join(wrong, "host", "left").select("host", per_text(_cleaned, "string")("template", F.to_json("wrong")).alias("template"))
    out = saved(out, "templates")
    drop(found)
    return out


def valid(classes: list[dict], wrong: list[dict]) -> list[dict]:
    """The classes without the tokens that are out of order on more than DISORDER of the pages."""
    pages = sum(w["n"] for w in wrong if w["class"] < 0)
    out = {(w["class"], w["place"]) for w in wrong if w["class"] >= 0 and w["n"] > DISORDER * pages}
    kept = [{"once": x["once"], "tokens": [t for k, t in enumerate(x["tokens"]) if (c, k) not in out]} for c, x in enumerate(classes)]
    return [x for x in kept if x["tokens"]]


def _cleaned(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for template, wrong in batches:
        out = []
        for t, w in zip(template.to_pylist(), wrong.to_pylist()):
            kept = valid(json.loads(t), json.loads(w or "[]"))
            out.append(json.dumps([{"once": x["once"], "tokens": [{k: y[k] for k in ("token", "text", "chars")} for y in x["tokens"]]} for x in kept]))
        yield pa.array(out, pa.string())


def repeated(classes: list[dict]) -> dict[int, tuple[str, int]]:
    """hash: (path, chars) of the template's texts: those with an element around them in their class."""
    out = {}
    for c in classes:
        around = {t["token"] for t in c["tokens"] if t["text"] is None}
        for t in c["tokens"]:
            if t["text"] is not None and any(p in around for p in _around(t["token"])):
                out[t["text"]] = t["token"], t["chars"]
    return out


def slot(classes: list[dict], hints: bool = True) -> str:
    """The path of the innermost container that holds most of what the slots around it hold.

    Containers are elements that stand once on each page that has them.  What a container's slots hold is its text less the template's.  From the
    root, the container that holds most of the slots is entered if that is MOST of them at least, or if it is an article or main element.
    """
    held = {t["token"]: t["chars"] for c in classes if c["once"] for t in c["tokens"] if t["text"] is None}
    for path, chars in repeated(classes).values():
        for p in _around(path):
            if p in held:
                held[p] -= chars
    children: dict[str, list[str]] = {}
    for p in held:
        name = p.rpartition(">")[2]
        if p and _tag(name) not in TEXTUAL and not any(_outside(x, hints) for x in p.split(">")):
            children.setdefault(max((q for q in _around(p) if q in held and q != p), key=len, default=""), []).append(p)
    at = ""
    while inner := [p for p in children.get(at, ()) if held[p] > 0]:
        best = max(inner, key=lambda p: (_is_main(p.rpartition(">")[2]), held[p], p))
        if held[best] < MOST * held.get(at, 0) and not _is_main(best.rpartition(">")[2]):
            break
        at = best
    return at


def _tag(name: str) -> str:
    return re.match(r"[^.#@]*", name)[0]


def _is_main(name: str) -> bool:
    return _tag(name) in ("article", "main") or name.endswith("@main")


@functools.lru_cache(10_000)
def _outside(name: str, hints: bool) -> bool:
    tag, *rest = re.split(r"[.#@]", name)
    return tag in OUTSIDE or hints and any(_WORD.search(x) for x in rest if x)


def main_text(page: str, where: str, template: frozenset[int] = frozenset(), hints: bool = True) -> str:
    """The text in the slot `where` without the template's texts.  A page without that container is its own template.

    Where nothing else stands in the slot, it is kept whole: the host's pages are copies of one article.
    """
    found, opened = blocks(page, hints)
    kept = [(">".join(path), said) for path, outside, said in found if not outside]
    inner = [x for x in kept if where and (x[0] == where or x[0].startswith(where + ">"))]
    if not inner:
        chars = Counter()
        for path, said in kept:
            for p in _around(path):
                chars[p] += len(said)
        own = slot([{"once": n == 1, "tokens": [{"token": t, "chars": chars[t], "text": None}]} for t, n in [("", 1), *((">".join(p), n) for p, n in opened.items())]], hints)
        inner = [x for x in kept if not own or x[0] == own or x[0].startswith(own + ">")]
    if template:
        inner = [x for x in inner if _text_hash(*x) not in template] or inner
    return "\n".join(said for _, said in inner)


@functools.lru_cache(1000)
def _slot_of(template: str | None, hints: bool) -> tuple[str, frozenset[int]]:
    """The slot and the texts of a template."""
    if not template:
        return "", frozenset()
    classes = json.loads(template)
    return slot(classes, hints), frozenset(repeated(classes))


def _extracted(hints: bool):
    def extracted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for page, template in batches:
            yield pa.array([main_text(p or "", *_slot_of(t, hints), hints) for p, t in zip(page.to_pylist(), template.to_pylist())], pa.string())

    return extracted


def extract(pages: DataFrame, url: str = "url", page: str = "html", hints: bool = True, template: bool = True) -> DataFrame:
    """Each row of pages as the struct `row`, with text, its main text.

    Null html is empty and gives an empty text.  Null urls share the empty host.  Repeated rows give equal texts; they count
    for the template once.  A host's only page is its own template, as all are with template=False.  An empty table gives an empty result.
    """
    spark = pages.sparkSession
    rows = packed(pages).withColumn("host", host_of(F.col(f"row.`{url}`")))
    small_batches(spark)
    out = _with(rows, templates(pages, url, page, hints), "left") if template else rows.withColumn("template", F.lit(None).cast("string"))
    return out.select("row", per_text(_extracted(hints), "string")(F.col(f"row.`{page}`"), F.col("template")).alias("text"))


def op8_pages(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))
