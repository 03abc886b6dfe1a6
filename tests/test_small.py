"""Smaller operators: exports, fingerprints, listings, nearest vertices, rotations, indexes."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from framelore.functions import text as T
from framelore.operators import documents, polygons, preflight
from framelore.sources import media
from framelore.store import image_index


def test_exported_events(spark):
    rows = [(1, "e1", "v", "interval", 0.0, 1.0, "l", "says \"x\"", True), (2, "e2", "v", "point", 0.5, None, None, "t", False), (3, "e3", "w", "point", 0.5, None, None, "t", False), (4, "e4", None, "point", 0.5, None, None, "t", True)]
    df = spark.createDataFrame(rows, "event_key bigint, event_id string, video_id string, kind string, start_s double, end_s double, label_id string, description string, reviewed boolean")
    got = {r["video_id"]: json.loads(r["content"]) for r in documents.exported_events(df, "reviewed").collect()}
    assert [e["event_id"] for e in got["v"]["events"]] == ["e1"] and got["w"]["events"] == []
    assert len(json.loads(documents.exported_events(df, "all").where("video_id = 'v'").first()["content"])["events"]) == 2
    with pytest.raises(ValueError):
        documents.exported_events(df, "some")


def test_changed_files(spark):
    schema = "path string, length bigint, modified bigint, sha256 string"
    stored = spark.createDataFrame([("same", 1, 1, "a"), ("touched", 1, 1, "a"), ("changed", 1, 1, "a"), ("gone", 1, 1, "a")], schema)
    now = spark.createDataFrame([("same", 1, 1, None), ("touched", 1, 2, "a"), ("changed", 2, 2, "b"), ("new", 1, 1, "a")], schema)
    assert {r["path"]: r["why"] for r in media.changed_files(stored, now).collect()} == {"changed": "changed", "gone": "missing"}


def test_video_sources(tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("d/b.mp4", "d/a.MKV", "d/x.txt", "c.mov"):
        (tmp_path / n).write_bytes(b"")
    names = [p.rsplit("/", 1)[-1] for p in media.resolve_sources([str(tmp_path / "c.mov"), str(tmp_path / "d"), str(tmp_path / "c.mov")])]
    assert names == ["c.mov", "a.MKV", "b.mp4"]
    with pytest.raises(ValueError):
        media.resolve_sources([str(tmp_path / "none.mp4")])
    with pytest.raises(ValueError):
        media.resolve_sources([str(tmp_path)], limit=1)


def test_nearest_vertex(spark):
    rings = spark.createDataFrame([(1, 0, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)])], f"shape_id int, ring_no int, ring {polygons.RING}")
    points = spark.createDataFrame([(1, 1, 9.0, 1.0), (1, 2, 50.0, 50.0)], "shape_id int, point_id int, px double, py double")
    got = [(r["point_id"], r["vertex"], round(r["distance"], 3)) for r in polygons.nearest_vertex(points, rings, 5.0).collect()]
    assert got == [(1, 1, 1.414)]


def test_rotation_and_time(spark):
    df = spark.createDataFrame([(-90,), (450,), (45,), (None,)], "d int")
    assert [r[0] for r in df.select(documents.normalized_rotation(F.col("d"))).collect()] == [270, 90, None, None]
    t = spark.createDataFrame([(9009, 9, 1, 3000)], "p bigint, f bigint, n bigint, d bigint")
    assert t.select(documents.pts_seconds(*map(F.col, "pfnd"))).first()[0] == 3.0


def test_propagation_input(spark):
    keys = spark.createDataFrame([("t", 1, "visible", "human", False), ("t", 2, "visible", "ai", False), ("t", 3, "occluded", "human", True)], "track_id string, frame_index int, visibility string, origin string, reviewed boolean")
    ranges = spark.createDataFrame([("t", 5, 9, True), ("t", 20, 30, False)], "track_id string, start_frame int, end_frame int, reviewed boolean")
    seeds, held = documents.propagation_input(keys, ranges)
    assert [r["frame_index"] for r in seeds.collect()] == [1]
    assert sorted((r["start_frame"], r["end_frame"]) for r in held.collect()) == [(1, 1), (3, 3), (5, 9)]
    chosen, _ = documents.propagation_input(keys, ranges, spark.createDataFrame([("t", 2)], "track_id string, frame_index int"))
    assert [r["frame_index"] for r in chosen.collect()] == [2]


def test_private_metadata_is_left_out(spark):
    df = spark.createDataFrame([({"api_key": "x", "root": "/r", "note": "at /home/u/x", "roots_of": "/m"},)], "m map<string,string>")
    assert df.select(T.redact_map(F.col("m"))).first()[0] == {"note": "at [local-path]", "roots_of": "[local-path]"}


def test_archive_and_index(spark, tmp_path):
    files = spark.createDataFrame([("categories.json", "[]"), ("a/ü.txt", "ä")], "file string, content string")
    assert media.pack_archive(files, str(tmp_path / "x.zip")) == 2
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert z.read("a/ü.txt").decode() == "ä"
    archives = spark.read.format("binaryFile").load(str(tmp_path / "x.zip"))
    assert {r["file"] for r in media.archive_files(archives).collect()} == {"categories.json", "a/ü.txt"}
    image_index(spark.range(100).withColumnRenamed("id", "position"), str(tmp_path / "index"), 4)
    assert spark.read.parquet(str(tmp_path / "index")).where("position >= 90").count() == 10


def test_acknowledged(spark):
    issues = spark.createDataFrame([("a", "x", "loss", 1), ("a", "y", "conversion", 1), ("b", "z", "blocking", 1)], "format string, code string, severity string, rows bigint")
    got = {r["format"]: (r["possible"], r["unacknowledged"]) for r in preflight.acknowledged(issues, ["x"]).collect()}
    assert got == {"a": (True, ["y"]), "b": (False, [])}


def test_staged_tables_are_removed(spark):
    import os

    from framelore.tables import shared_dir, stage, unstage

    df = stage(spark.range(5), "small")
    path = df._framelore_path.removeprefix("file://")
    assert os.path.isdir(path) and path.startswith(shared_dir(spark).removeprefix("file://")) and df.count() == 5
    unstage(df)
    assert not os.path.exists(path)
