import os

import pytest

from nickline.cli import COMMANDS, main, resolve
from nickline.plans import bridge

FOLDER = "/root/testdata/sf0.001"


def test_prefixes():
    assert resolve("ral", COMMANDS) == "rallies" and resolve("train", COMMANDS) == "train"
    for bad in ("t", "zzz"):
        with pytest.raises(SystemExit):
            resolve(bad, COMMANDS)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_rallies_to_csv(spark, tmp_path):
    bridge.track(spark, FOLDER).write.parquet(str(tmp_path / "t"))
    main(["ral", str(tmp_path / "t"), "--out", str(tmp_path / "out")], spark)
    got = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert got.columns == ["match_id", "rally_index", "start_s", "end_s"] and got.count() > 0
