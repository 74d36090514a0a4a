"""A subset is taken only when it was finished and is what its manifest says."""

import os
import shutil

import pytest

from chronoweave.sources import interactions as ix


def test_finished_subsets_only(spark, tmp_path):
    rows = spark.createDataFrame([(i, "train" if i < 8 else "test") for i in range(10)], "event_id long, split string")
    report = spark.createDataFrame([("orphans", 3)], "check string, bad long")
    stats = spark.createDataFrame([("interactions", 10.0)], "metric string, value double")
    root = str(tmp_path / "s")
    ix.write_subset(ix.Subset(rows, rows.select("event_id"), rows.select("split").distinct(), stats, report), root, target=9, tolerance=0.2)
    got = ix.read_subset(spark, root)
    assert sorted(map(tuple, got["interactions"].select("event_id", "split").collect())) == sorted(map(tuple, rows.collect())) and got["validation"].first()["bad"] == 3
    line = {r["table"]: r for r in spark.read.schema("table string, rows long, target long, deviation long, within_tolerance boolean").json(f"{root}/manifest.json").collect()}["interactions"]
    assert tuple(line)[1:] == (10, 9, 1, True)
    more = str(tmp_path / "more")
    shutil.copytree(root, more)
    rows.limit(1).select("event_id").write.mode("append").parquet(f"{more}/sources.parquet")
    with pytest.raises(ValueError, match="sources.parquet"):
        ix.read_subset(spark, more)
    half = str(tmp_path / "half")
    shutil.copytree(root, half, ignore=lambda d, names: ["manifest.json"] if os.path.basename(d) == "s" else [])
    with pytest.raises(Exception):
        ix.read_subset(spark, half)
