"""Secret scans: an Aho-Corasick prefilter, regular expressions anchored at its hits, embedded checksums.

A text goes through one automaton of keywords.  Only where a keyword stands is a regular expression matched, anchored
there.  Runs of hexadecimal digits have no keyword: the text is mapped to two byte classes, and a run of the least length is the
keyword there.  Tokens that embed a checksum are reported only if it is right.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, per_text, small_batches, table, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Tokens of 30 random characters and their CRC-32 in base 62, six digits.
CHECKED = re.compile(r"(gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----")
#: Kinds in the order in which spans of equal start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "checked", "pem")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "checked", "gho_": "checked", "ghu_": "checked", "ghs_": "checked", "ghr_": "checked", "npm_": "checked", "-----begin ": "pem"}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX_CLASS = bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))
_HEX_RUN = b"\x01" * LEAST["hex"]


def base62(n: int, digits: int = 6) -> str:
    out = ""
    for _ in range(digits):
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out


def checksum_holds(random: str, check: str) -> bool:
    return base62(zlib.crc32(random.encode())) == check


def keywords():
    out = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        out.add_word(word, (len(word), kind))
    out.make_automaton()
    return out


_search = keywords()


def _accepted(kind: str, text: str, at: int) -> tuple[int, bool] | None:
    """Where the kind's match at `at` ends and whether it counts."""
    if kind == "assign":
        m = ASSIGN.match(text, at)
        return m and (m.end(), len(m[2]) >= LEAST[kind])
    if kind == "access":
        m = ACCESS.match(text, at)
        return m and (m.end(), m.end() - at >= LEAST[kind])
    if kind == "checked":
        m = CHECKED.match(text, at)
        return m and (m.end(), checksum_holds(m[2], m[3]))
    m = PEM.match(text, at)
    return m and (m.end(), True)


def spans(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind."""
    found = []
    hits = [(end - n + 1, kind) for end, (n, kind) in _search.iter(data.lower().decode("latin-1"))]
    has_hex = _HEX_RUN in data.translate(_HEX_CLASS)
    if not hits and not has_hex:
        return []
    text, plain = data.decode("utf-8"), data.isascii()
    if hits:
        hits.sort()
        free = dict.fromkeys(KINDS, 0)
        point, byte = 0, 0
        for at, kind in hits:
            if not plain:  # hits come in order: count code points on from the last one
                point, byte = point + len(data[byte:at].decode("utf-8")), at
                at = point
            if at >= free[kind] and (m := _accepted(kind, text, at)):
                free[kind] = m[0]
                if m[1]:
                    found.append((kind, at, m[0]))
    if has_hex:
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


_LIST = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        yield pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in texts(column)], _LIST)


def _redacted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        out = [redact(t) if hit else None for t, hit in zip(texts(column), column.is_valid().to_pylist())]
        yield pa.array(out, pa.string())


def redact(data: bytes, mark: str = "[secret]") -> str:
    """The text with every found span (overlapping ones as one) replaced by the mark."""
    text, out, at = data.decode("utf-8"), [], 0
    merged: list[list[int]] = []
    for _, a, b in spans(data):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row of docs as the struct `row`, with found: its spans by start, then kind.

    No shuffle; each text is scanned whole.  Null and empty texts have no spans.  Rows are scored each for itself, so
    repeated rows and ids have repeated results; extra columns stay in `row`.
    """
    small_batches(docs.sparkSession)
    return packed(docs).withColumn("found", per_text(_found, "array<struct<kind: string, start: bigint, end: bigint>>")(F.col(f"row.`{text}`")))


def redacted(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with every secret replaced by a mark; n_chars, where there is such a column, follows.  Null texts stay null."""
    small_batches(docs.sparkSession)
    out = docs.withColumn(text, per_text(_redacted, "string")(F.col(f"`{text}`")))
    return out.withColumn(n_chars, F.when(F.col(f"`{text}`").isNull(), F.col(f"`{n_chars}`")).otherwise(F.length(F.col(f"`{text}`"))).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else out


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*KINDS[:3]))
    return found.select("row.doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


_ANY = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_SQL = {
    "assign": "(?:" + "|".join([*map(_ANY, ("password", "passwd", "secret", "token")), _ANY("api") + "_?" + _ANY("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}
_TAIL = {"assign": "len(regexp_extract(m, e, 1))", "access": "len(m)", "hex": "len(m)"}


def _matches(kind: str) -> str:
    """Matches stand between the pieces that a split by the same expression leaves, so lengths give their places."""
    e = "'" + _SQL[kind].replace("'", "''") + "'"
    return f"""SELECT rid, '{kind}' AS kind, {KINDS.index(kind)} AS nr, start, start + len(m) AS stop FROM (
      SELECT rid, e, ms[i] AS m, list_sum(list_transform(ps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) AS start
      FROM (SELECT rid, e, ms, ps, unnest(generate_series(1, len(ms))) AS i FROM (SELECT rid, {e} AS e, regexp_extract_all(t, {e}) AS ms, string_split_regex(t, {e}) AS ps FROM d) WHERE len(ms) > 0)) WHERE {_TAIL[kind]} >= {LEAST[kind]}"""


#: The base spans.  SQL has no CRC-32 for the method's own kinds, of which the test tables hold none.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_matches(k) for k in KINDS[:3])}),
s AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, nr) AS spans FROM m GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (rid)
"""
