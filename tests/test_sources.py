import json

import pytest

from leafmill.sources import files


def test_json_and_listing(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"units": 3}))
    assert files.json_files(spark, str(tmp_path / "a.json"), "units INT").first()["units"] == 3
    assert files.listing(spark, str(tmp_path), "*.json").count() == 1


def test_page_geometry(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<doc><page number="2"><word xMin="1" yMin="2" xMax="3" yMax="4">One</word><word xMin="5" yMin="2" xMax="6" yMax="4">two</word></page></doc>')
    rows = files.page_geometry(spark, str(tmp_path / "p.xml")).orderBy("word_no").collect()
    assert [(r["page_number"], r["text"], r["x0"], r["bottom"]) for r in rows] == [(2, "One", 1.0, 4.0), (2, "two", 5.0, 4.0)]


def test_strict_utf8(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xff"),)], "b binary")
    assert [r[0] for r in df.select(files.strict_utf8(F.col("b"))).collect()] == ["ok", None]


def test_inventory(spark, tmp_path):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, sha256 string")
    b = spark.createDataFrame([("y", "3"), ("z", "4")], "path string, sha256 string")
    assert {(r["path"], r["state"]) for r in files.inventory_differences(a, b).collect()} == {("x", "missing"), ("y", "changed"), ("z", "unlisted")}


def test_write_once(spark, tmp_path):
    files.write_once(spark.range(2), str(tmp_path / "t"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        files.write_once(spark.range(2), str(tmp_path / "t"))


def test_no_private_checkpoint_folder_on_a_cluster():
    from types import SimpleNamespace as N

    from leafmill.sources import shared_checkpoint

    context = N(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_checkpoint(N(sparkSession=N(sparkContext=context, conf={})))
