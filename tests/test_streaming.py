from nickline.operators import tracks
from nickline.streaming.online import smooth_stream

SCHEMA = "match_id int, slot int, k bigint, time_s double, x double, y double"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(0, s, k, k * 0.1, None if k % 9 == 4 else 1.0 + 0.05 * k, 2.0 + 0.03 * k) for k in range(40) for s in (0, 1)]
    rows = [(*r[:5], None if r[4] is None else r[5]) for r in rows]
    for i in range(4):
        spark.createDataFrame([r for r in rows if r[2] // 10 == i], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = smooth_stream(stream).writeStream.format("memory").queryName("smoothed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.slot, r.k): (r.x, r.y, r.solid) for r in spark.table("smoothed").collect()}
    want = {(r.slot, r.k): (r.x, r.y, r.solid) for r in tracks.alpha_beta(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want
