"""Test tables as court tracks: the ordinal of an event within ten days gives a sample and a player, its value a little noise."""

from __future__ import annotations

from pyspark.sql import DataFrame

MATCH = "(day(ts) - 1) {div} 10"
BY_DAY = "day(ts)"

_SHAPE = """
WITH o AS (SELECT CAST({match} AS INT) AS match_id, event_id, event_type, value,
                  row_number() OVER (PARTITION BY {match} ORDER BY ts, event_id) - 1 AS rn FROM {events}),
     p AS (SELECT match_id, rn {div} 2 AS k, rn % 2 AS slot, event_id, event_type, value,
                  100 * ((rn {div} 2) {div} 160) + least((rn {div} 2) % 160, 100) + 14 * (rn % 2) AS n FROM o)
SELECT match_id, CAST(k AS BIGINT) AS k, CAST(slot AS INT) AS slot, k * CAST(0.1 AS DOUBLE) AS time_s,
       CAST(CASE WHEN (k {div} 300) % 4 = 3 OR (event_type = 'error' AND event_id % 3 = 0) THEN 1 ELSE 2 END AS INT) AS blobs,
       CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN NULL ELSE
         CAST(3.2 AS DOUBLE) + CAST(CASE slot WHEN 0 THEN 1.2 ELSE -1.2 END AS DOUBLE) * (1 - abs((n % 28) - 14) / CAST(14.0 AS DOUBLE))
         + (value - floor(value) - CAST(0.5 AS DOUBLE)) * CAST(0.04 AS DOUBLE) END AS x,
       CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN NULL ELSE
         CAST(4.26 AS DOUBLE) + CAST(3.0 AS DOUBLE) * (1 - abs((n % 28) - 14) / CAST(14.0 AS DOUBLE))
         + (value * 7 - floor(value * 7) - CAST(0.5 AS DOUBLE)) * CAST(0.04 AS DOUBLE) END AS y,
       event_id, event_type
FROM p"""


def sql(match: str = MATCH) -> str:
    """The bridge in DuckDB's SQL."""
    return _SHAPE.format(match=match.format(div="//"), div="//", events="events")


#: The same ordinals by hours: a row's is its place within its hour and the number of its match's rows in the hours before.  A match's rows
#: needn't be sorted in one task then; a match is made of whole days, and nulls are an hour of their own.
_BY_HOURS = """
WITH e AS (SELECT CAST({match} AS INT) AS match_id, ts, coalesce(datediff(CAST(ts AS DATE), DATE'1970-01-01') * 24L + hour(ts), -9223372036854775808) AS hour_no,
                  event_id, event_type, value FROM {events}),
     h AS (SELECT hour_no, sum(n) OVER (PARTITION BY match_id ORDER BY hour_no) - n AS before FROM (SELECT hour_no, any_value(match_id) AS match_id, count(*) AS n FROM e GROUP BY hour_no)),
     r AS (SELECT *, row_number() OVER (PARTITION BY hour_no ORDER BY ts, event_id) - 1 AS place FROM e),
     o AS (SELECT match_id, event_id, event_type, value, place + before AS rn FROM r JOIN h USING (hour_no)),
     p AS"""


def track(spark, sf_dir: str, match: str = MATCH) -> DataFrame:
    """match_id, k, slot, time_s, blobs, x, y, event_id, event_type: a long table of two players' positions in metres."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")
    shape = _BY_HOURS + _SHAPE.split("p AS", 1)[1]
    return spark.sql(shape.format(match=match.format(div="div"), div="div", events="{events}"), events=events)
