"""WARC archives and their index, merged from sorted runs.

Every page becomes a WARC record, a response or (for a payload that another record holds) a revisit.  Spark's text writer
writes the records: a record ends in two line breaks, which is its line separator, so the archives lie wherever the
cluster's shared folder does and come from committed tasks only.  Each archive is read back as one capture run, sorted by URL key
and time; the runs are dealt out by key range, and in each range a loser tree merges them.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shared_dir, small_batches, table

#: Payloads of fewer bytes are always responses.
LEAST_REVISIT = 1000
#: Records of one archive at most; an archive is one run.
ARCHIVE_RECORDS = 5000
#: Rows of one range of the merge, about.
RANGE_ROWS = 50_000
END = "\r\n\r\n"
_EPOCH, _SPAN = 1_704_067_200, 315_360_000
_URN = "urn:nickline:page:"


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id and the WARC record of each row of pages.

    Of the rows whose payloads are equal and of at least 1000 bytes, those with the largest page_id are responses and the others revisits of it;
    a null page_id is never the largest, unless a group has no other, and then its rows are responses.  Null html is an empty
    payload; null urls are empty.  Repeated rows have a record each.  The groups' largest ids are pre-aggregated; the join
    with them is by digest, where Spark splits the partitions of very frequent payloads.
    """
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html").cast("bigint"))
    heads = rows.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("digest", "bytes").agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
    heads = heads.filter("n > 1").select(F.col("digest").alias("r_digest"), F.col("bytes").alias("r_bytes"), "head")
    rows = rows.join(heads, (F.col("digest") == F.col("r_digest")) & (F.col("bytes") == F.col("r_bytes")), "left")
    revisit = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    when = F.date_format(F.timestamp_seconds(F.lit(_EPOCH) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(_SPAN))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    urn = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")), F.lit("WARC-Date: "), when,
        F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", "%0A"), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), F.regexp_replace(urn(F.col("head")), "\r\n", ""))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(END),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str, **names) -> None:
    records(pages, **names).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


class Reader:
    """WARC records of a gzipped archive, one at a time."""

    def __init__(self, data, chunk: int = 1 << 20):
        self.data, self.chunk, self.at, self.gz, self.held = memoryview(data), chunk, 0, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        while self.at < len(self.data) or self.gz.unconsumed_tail:
            raw = self.gz.unconsumed_tail or self.data[self.at : self.at + self.chunk]
            if not self.gz.unconsumed_tail:
                self.at += self.chunk
            out = self.gz.decompress(raw, self.chunk)
            if self.gz.eof and self.gz.unused_data:
                rest, self.gz = self.gz.unused_data, zlib.decompressobj(31)
                out += self.gz.decompress(rest)
            if out:
                self.held += out
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (i := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self.more():
                return None
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def __iter__(self) -> Iterator[tuple[dict, bytes]]:
        while (head := self.until(b"\r\n\r\n")) is not None:
            lines = head.decode("utf-8").split("\r\n")
            fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:] if x)
            block = self.take(int(fields["Content-Length"]))
            if self.take(4) != b"\r\n\r\n" or not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            yield fields, block


def url_key(url: str) -> str:
    """The host's labels from last to first, then the path and query in lower case."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path + ("?" + parts.query if parts.query else "")).lower()


def capture(fields: dict, block: bytes) -> dict:
    """A record's index row; the payload of a response must have its digest."""
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    n = int(re.search(rb"Content-Length: (\d+)", head)[1])
    if fields["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda x: int(y) if (y := x.strip("<>").removeprefix(_URN)) else None
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": n, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "url_key": url_key(fields["WARC-Target-URI"]), "captured": fields["WARC-Date"]}


_KEY = ("url_key", "captured", "page_id")
ROW = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url_key string, captured string"
_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url_key", pa.string()), ("captured", pa.string())])


def order(row: dict) -> tuple:
    return row["url_key"], row["captured"], -1 if row["page_id"] is None else row["page_id"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _ARROW.append(pa.field("run", pa.string())).append(pa.field("nr", pa.int64()))
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            rows = sorted((capture(*x) for x in Reader(content.as_buffer())), key=order)
            yield pa.RecordBatch.from_pylist([r | {"run": path.as_py(), "nr": k} for k, r in enumerate(rows)], schema)


def read_runs(spark, path: str) -> DataFrame:
    """The archives' index rows, each archive a run that is sorted by URL key, time and page_id: ROW, run, nr."""
    small_batches(spark, 1)  # a row is an archive here
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(_runs, f"{ROW}, run string, nr bigint")


class LoserTree:
    """Merges sorted iterators: a node keeps the loser of its match, so a new head plays one match a level."""

    def __init__(self, runs: list, key):
        self.runs, self.key = [iter(r) for r in runs], key
        n = 1
        while n < len(self.runs):
            n *= 2
        self.n, self.heads = n, [self._next(i) for i in range(n)]
        self.losers = [0] * n
        winners = [0] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.best = winners[1]

    def _next(self, i: int):
        if i < len(self.runs):
            for row in self.runs[i]:
                return self.key(row), i, row
        return None

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and x[:2] <= y[:2]

    def __iter__(self):
        while self.runs and (head := self.heads[self.best]) is not None:
            yield head[2]
            at = self.best
            self.heads[at] = self._next(at)
            node = (at + self.n) // 2
            while node:
                if self._before(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.best = at


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: its rows come run by run, each in order."""
    schema = _ARROW.append(pa.field("range", pa.int32())).append(pa.field("place", pa.int64()))
    rows = [r for b in batches for r in b.to_pylist()]
    cuts = [0, *(i for i in range(1, len(rows)) if rows[i]["run"] != rows[i - 1]["run"]), len(rows)]
    part, out = TaskContext.get().partitionId(), []
    for place, r in enumerate(LoserTree([rows[a:b] for a, b in zip(cuts, cuts[1:])], order)):
        out.append({**{f.name: r[f.name] for f in _ARROW}, "range": part, "place": place})
        if len(out) == 5000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def merged(runs: DataFrame) -> DataFrame:
    """ROW, range, place: the captures of all runs in one global order, by range and place within it.

    Ranges are cut by URL key, time, page_id and run, so the captures of one URL may fill many of them; a range holds about
    50,000 rows and is merged in memory.
    """
    spark = runs.sparkSession
    small_batches(spark, 10_000)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), runs.count() // RANGE_ROWS + 1)
    dealt = runs.repartitionByRange(n, *_KEY, "run", "nr").sortWithinPartitions("run", "nr")
    return dealt.mapInArrow(_merge, f"{ROW}, range int, place bigint")


def history(pages: DataFrame, path: str | None = None, **names) -> DataFrame:
    """Writes pages to archives, reads them back and merges their index.  An empty table gives an empty history."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/nickline/warc-{uuid.uuid4().hex}"
    write(pages, path, **names)
    return merged(saved(read_runs(spark, path), "runs"))


def op2_archives(spark, sf_dir: str) -> DataFrame:
    found = history(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN head IS NULL OR head IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head IS NULL OR head IS NOT DISTINCT FROM page_id THEN NULL ELSE head END AS refers_to
FROM p LEFT JOIN h USING (payload_digest)
"""
