"""Store, media, streaming, documents and codecs on small fixtures."""

import io
import random
import struct
import time
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelore import exports
from framelore.functions import geometry as G
from framelore.functions import text as T
from framelore.operators import boxes, catalogs, documents, drawing, masks, nested, polygons, revisions, routing, timeline, tracks
from framelore.sources import media
from framelore.store import Conflict, Warehouse, broken_assets, mask_assets
from framelore.streaming.imports import LINES, watch_lines
from framelore.streaming.intervals import stream_intervals


def test_publish_is_guarded(spark, tmp_path):
    store = Warehouse(spark, f"file://{tmp_path}/w")
    one = spark.createDataFrame([(1,)], "a int")
    first = store.publish("d", {"images": one}, None, token="t1")
    assert store.publish("d", {"images": one}, None, token="t1") == first
    with pytest.raises(Conflict):
        store.publish("d", {"images": one}, None)
    second = store.publish("d", {"images": one.union(one)}, first)
    assert store.table("d", "images").count() == 2 and store.table("d", "images", first).count() == 1
    assert [p["revision"] for p in store.history("d")] == [second, first]
    with pytest.raises(ValueError):
        store.table("d", "images", "../x")


def test_exports_start_from_a_frozen_preview(spark, tmp_path):
    store = Warehouse(spark, f"file://{tmp_path}/w")
    plans = exports.Exports(store)
    images = spark.createDataFrame([("a.png", 10, 8, "val", "ab"), ("b.jpg", 5, 5, "unspecified", None)], "path string, width int, height int, split string, sha256 string")
    objects = spark.createDataFrame([("a.png", "bbox", "x", [1.0, 1.0, 4.0, 4.0], 0.5)], "path string, kind string, label string, bbox array<double>, confidence double")
    plan = plans.preview("d", images, objects, ["yolo_detection", "native", "yolo_detection"])
    assert (plan["images"], plan["objects"]) == (2, 1) and [i["code"] for i in plan["formats"]["yolo_detection"]] == ["confidence_sidecar", "unspecified_to_train"]
    with pytest.raises(ValueError, match="confidence_sidecar"):
        plans.start("d", plan["preview"], {"yolo_detection": ["unspecified_to_train"]})
    job = plans.start("d", plan["preview"], {"yolo_detection": ["unspecified_to_train", "confidence_sidecar"]})
    assert plans.start("d", plan["preview"], {}) == job and job["formats"] == ["native", "yolo_detection"]
    assert plans.frozen("d", plan["preview"])["images"].count() == 2
    folder = f"{tmp_path}/w/d/previews/{plan['preview']}/revisions/{plan['revision']}/objects"
    objects.limit(0).write.mode("overwrite").parquet(f"file://{folder}")
    spark.catalog.refreshByPath(f"file://{folder}")
    with pytest.raises(Conflict):
        plans.frozen("d", plan["preview"])
    actual = images.withColumn("sha256", F.lit("other"))
    blocked = plans.preview("d", images, objects, ["native", "nothing"], actual)
    assert [i["code"] for i in blocked["formats"]["nothing"]] == ["unsupported_format", "source_image_unavailable"]
    with pytest.raises(ValueError, match="blocked"):
        plans.start("d", blocked["preview"], {})


def test_drafts_follow_the_digest(spark):
    docs = [(1, 1, "annotations", 4, '{"b": 1, "a": [1, 2.50]}', None), (2, 1, "ai_drafts", 9, "{}", '{"a":[1,2.5],"b":1}'), (3, 2, "annotations", 4, '{"a": 1}', None), (4, 2, "ai_drafts", 5, "{}", '{"a": 2}'), (5, 3, "annotations", 4, "no JSON", None), (6, 3, "ai_drafts", 5, "{}", None)]
    df = spark.createDataFrame(docs, "doc_key bigint, image_key bigint, layer string, revision int, body string, made_on string").withColumn("saved_at", F.lit(None).cast("timestamp"))
    df = df.withColumn("digest", T.document_digest("body")).withColumn("base_digest", T.document_digest("made_on"))
    images = spark.createDataFrame([(i, "unreviewed") for i in (1, 2, 3, 4)], "image_key bigint, status string")
    got = {r["image_key"]: (r["layer"], r["doc_key"]) for r in revisions.effective_revisions(images, df).collect()}
    assert got == {1: ("ai_drafts", 2), 2: ("annotations", 3), 3: ("annotations", 5), 4: ("import", None)}
    assert revisions.effective_revisions(images, df.drop("digest", "base_digest")).where("layer = 'ai_drafts'").count() == 2
    assert df.select(T.document_digest(F.lit('{"x": NaN}')).alias("d")).first()["d"] is None


def test_time_text(spark):
    rows = spark.createDataFrame([(0.0,), (61.2345,), (6000.0,), (-3.0,), (None,), (59.9999,)], "s double")
    assert [r[0] for r in rows.select(T.time_text(F.col("s"))).collect()] == ["00:00.000", "01:01.234", "100:00.000", "00:00.000", "00:00.000", "01:00.000"]


def test_stage_folders_are_the_sessions_own(spark, tmp_path):
    import os
    import tempfile

    from framelore import tables

    staged = tables.stage(spark.range(3), "mine")
    home = os.path.join(tables.shared_dir(spark).removeprefix("file://").removeprefix("file:"), "framelore")
    with tempfile.TemporaryDirectory(prefix="another-session-", dir=home) as other:
        tables.clear_stage(spark)
        assert os.path.isdir(other) and not os.path.exists(staged._framelore_path.removeprefix("file://").removeprefix("file:"))


def test_every_part_of_an_object_has_a_table(spark):
    body = '{"objects": [{"id": "o", "attributes": {"colour": "red", "n": 3}, "provenance": {"video": {"id": "v"}, "line": 7, "imports": [{"source": "s"}]}, "polygons": [[1, 1, 2, 2, 3, 1]]}, {"id": "p", "attributes": "{\\"k\\": null}", "provenance": null}]}'
    tables = nested.flat_tables(spark.createDataFrame([(1, body), (2, None), (3, "[]")], "doc_key bigint, body string"))
    assert sorted((r["object_id"], r["name"], r["value"]) for r in tables["attributes"].fillna("null").collect()) == [("o", "colour", "red"), ("o", "n", "3"), ("p", "k", "null")]
    assert sorted((r["object_id"], r["name"], r["value"]) for r in tables["lineage"].collect()) == [("o", "line", "7"), ("o", "video", '{"id":"v"}')]
    assert [tables[t].count() for t in ("objects", "rings", "origins")] == [2, 1, 1]


def test_mask_assets(spark):
    df = spark.sql("select 'e' as encoding, 128 as tile_size, array(named_struct('x', x, 'y', 0)) as tiles from values (0), (0), (128) t(x)")
    got = mask_assets(df)
    assert sorted(r["uses"] for r in got.collect()) == [1, 2] and broken_assets(got).count() == 0
    assert broken_assets(got.withColumn("body", F.lit("x"))).count() == 2


def _png(w, h):
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


HEADERS = [
    (_png(640, 480), (640, 480)),
    (b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x01\xe0\x02\x80\x03" + b"\0" * 12, (640, 480)),
    (b"BM" + b"\0" * 16 + struct.pack("<ii", 640, -480), (640, 480)),
    (b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (639).to_bytes(3, "little") + (479).to_bytes(3, "little"), (640, 480)),
    (b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHIHH", 256, 3, 1, 640, 0) + struct.pack("<HHII", 257, 4, 1, 480), (640, 480)),
]


@pytest.mark.parametrize("data,size", HEADERS)
def test_image_headers(data, size):
    assert media.image_size(data) == size


def test_listing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.PNG").write_bytes(_png(3, 4))
    (tmp_path / "a" / "._one.png").write_bytes(_png(3, 4))
    (tmp_path / "bad.jpg").write_bytes(b"nothing")
    files = media.list_files(spark, str(tmp_path), media.IMAGE_TYPES)
    good, issues = media.picture_table(files)
    assert [(r["path"], r["width"], r["height"]) for r in good.collect()] == [("a/one.PNG", 3, 4)]
    assert [r["location"] for r in issues.collect()] == ["bad.jpg"]


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, c in members:
            z.writestr(n, c)
    return out.getvalue()


def test_archives():
    assert set(media.open_archive(_zip([("categories.json", "[]"), ("a/b.txt", "x")]))) == {"categories.json", "a/b.txt"}
    for bad in ([("../x", "")], [("/x", "")], [("a", ""), ("A", "")], [("x", "")], [("categories.json", "[]"), ("bomb", "0" * 5_000_000)], [("C:/x", "")]):
        with pytest.raises(ValueError):
            media.open_archive(_zip(bad))
    with pytest.raises(ValueError):
        media.open_archive(b"no archive")


def test_stream_keeps_the_map(spark, tmp_path):
    schema = "entity string, start_at bigint, end_at bigint"
    source = tmp_path / "in"
    batches = [[("a", 10, 12), ("a", 20, 22)], [("a", 13, 18), ("b", 1, 1)], [("a", 19, 19), ("a", 1, 2), (None, 1, 2), ("a", 5, 3)]]
    last: dict = {}

    def each(df, _):
        for r in df.collect():
            last.setdefault((r["entity"], _), set()).add((r["kind"], r["start_at"], r["end_at"]))

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        q = stream_intervals(spark.readStream.schema(schema).parquet(str(source)), 1).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    newest = max(n for e, n in last if e == "a")
    assert last[("a", newest)] == {("period", 1, 2), ("gap", 3, 9), ("period", 10, 22)}


def test_lines_are_judged_as_they_arrive(spark, tmp_path):
    catalog = spark.createDataFrame([(1, "x")], "category_id int, category_name string")
    for key, line in ((1, "1 .5 .5 .1 .1"), (2, "1 .5")):
        spark.createDataFrame([(key, "i", "f", 1, "yolo", line)], LINES).write.mode("append").parquet(str(tmp_path / "in"))
        watch_lines(spark, str(tmp_path / "in"), catalog, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["line_key"]: r["code"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: None, 2: "column_count"}


def test_routes(spark):
    rows = [(1, 1024, 768), (2, 25000, 15000), (3, 25000, 15000), (4, 3000, 2000), (5, None, 5)]
    images = spark.createDataFrame(rows, "image_key int, width int, height int")
    got = {r["image_key"]: r["strategy"] for r in routing.route_images(images, spark.createDataFrame([(2,)], "image_key int")).collect()}
    assert got == {1: "direct", 2: "annotation_crops", 3: "overlap_tiles", 4: "resize_whole", 5: None}


def test_tiles_cover_the_picture(spark):
    rows = routing.tile_grid(spark.createDataFrame([(1, 26753, 15052)], "image_key int, width int, height int")).collect()
    assert min(r["x"] for r in rows) == 0 and all(r["x"] % 16 == 0 and r["y"] % 16 == 0 for r in rows)
    assert max(r["x"] + r["tile_width"] for r in rows) == 26753 and max(r["y"] + r["tile_height"] for r in rows) == 15052
    assert sorted(r["tile_index"] for r in rows) == list(range(len(rows)))


def test_suppression(spark):
    rows = [(1, 1, "person", 0.9, 0.0, 0.0, 100.0, 100.0), (2, 1, "person", 0.7, 5.0, 5.0, 105.0, 105.0), (3, 1, "car", 0.8, 5.0, 5.0, 105.0, 105.0), (4, None, "car", 0.8, 5.0, 5.0, 105.0, 105.0), (5, 1, "car", None, 5.0, 5.0, 105.0, 105.0)]
    df = spark.createDataFrame(rows, "key int, image_key int, label string, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r["key"] for r in boxes.suppress(df).collect()) == [1, 3]
    pairs = {(r["key_a"], r["key_b"]) for r in boxes.overlapping_pairs(df).collect()}
    assert pairs == {(1, 2), (3, 5)}


RINGS = {
    "crossing": ([[(0, 0), (4, 4), (4, 0), (0, 4)]], "no_area"), "crossing2": ([[(0, 0), (4, 4), (6, 1), (0, 4)]], "edges_meet"), "back": ([[(0, 0), (4, 0), (2, 0), (2, 3)]], "doubles_back"), "flat": ([[(0, 0), (1, 0), (2, 0)]], "no_area"),
    "twice": ([[(0, 0), (4, 0), (4, 4), (0, 0)]], "repeated_vertex"), "nested": ([[(0, 0), (9, 0), (9, 9), (0, 9)], [(2, 2), (4, 2), (4, 4)]], "ring_in_ring"), "few": ([[(0, 0), (1, 1)]], "too_few_points"),
    "infinite": ([[(0, 0), (float("inf"), 1), (2, 0)]], "not_finite"), "good": ([[(10, 20), (50, 20), (50, 60), (10, 60)], [(80, 20), (90, 20), (90, 30), (80, 30)]], None),
}


def test_polygon_faults_and_metrics(spark):
    rows = [(k, i, [(float(x), float(y)) for x, y in ring]) for k, (rings, _) in RINGS.items() for i, ring in enumerate(rings)]
    df = spark.createDataFrame(rows, f"id string, ring_no int, ring {polygons.RING}")
    assert {r["id"]: r["fault"] for r in polygons.faults(df, ["id"]).collect()} == {k: f for k, (_, f) in RINGS.items()}
    good = polygons.metrics(df.where("id = 'good'"), ["id"]).first()
    assert (good["x1"], good["y1"], good["x2"], good["y2"], good["area"]) == (10, 20, 90, 60, 1700)


def test_mask_metrics_of_a_run_over_the_row_end(spark):
    df = spark.createDataFrame([("a", 0, 0, [127, 3, 16254])], "id string, x int, y int, counts array<int>")
    r = masks.metrics(df, ["id"]).first()
    assert (r["x1"], r["y1"], r["x2"], r["y2"], r["area"]) == (0, 0, 128, 2, 3)


@pytest.mark.parametrize("counts", [[0, 10], [1, 2, 3, 4, 1000000, 7], [2**31, 1, 5, 3], [5], [0, 1, 16, 17, 15, 2**32 - 1], [31, 32, 33, 512, 0, 16383]])
def test_coco_runs_round_trip(spark, counts):
    df = spark.createDataFrame([(counts,)], "c array<bigint>")
    text = df.select(G.encode_coco_counts(F.col("c")).alias("t"))
    assert text.select(G.decode_coco_counts(F.col("t")).alias("c")).first()["c"] == counts


@pytest.mark.parametrize("text", ["zzzzz", "", "\x10", "1 2"])
def test_bad_runs_are_null(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(G.decode_coco_counts(F.col("t")).alias("c")).first()["c"] is None


def test_column_major_keeps_every_pixel():
    rng = np.random.default_rng(1)
    picture = np.zeros((260, 300), dtype=bool)
    picture[20:150, 30:160] = True
    picture[50:120, 60:130] = False
    picture[215:225, 260:275] = True
    picture |= rng.random(picture.shape) < 0.01
    flat = picture.T.ravel()
    turns = np.flatnonzero(np.diff(flat)) + 1
    counts = np.diff(np.concatenate(([0], turns, [flat.size]))).tolist()
    counts = [0, *counts] if flat[0] else counts
    tiles = masks.tiles_from_counts(counts, 300, 260)
    assert masks.counts_from_tiles(tiles, 300, 260) == counts
    back = np.zeros((384, 384), dtype=bool)
    for x, y, c in tiles:
        back[y : y + 128, x : x + 128] = masks.pixels_of(c)
    assert (back[:260, :300] == picture).all()
    assert len(masks.tiles_from_counts([1500020000, 1, 999979999], 50000, 50000)) == 1
    with pytest.raises(ValueError):
        masks.tiles_from_counts([10**10], 100000, 100000)


def test_pixel_edits():
    ring = masks.rasterize([[(10, 10), (50, 10), (50, 50), (10, 50)]], 64, 64)
    assert ring.sum() == 1600
    ring[25:35, 25:35] = False
    assert masks.holes(ring) == 1 and masks.components(ring)[1] == 1
    assert masks.erode(ring, 2).sum() < ring.sum() < masks.dilate(ring, 2).sum()
    with pytest.raises(ValueError):
        masks.edit(ring, "expand", 8)
    parts = masks.split_by_line(ring, (0, 30), (64, 30))
    assert len(parts) == 2 and (parts[0] | parts[1]).sum() == ring.sum() and not (parts[0] & parts[1]).any()
    two = np.zeros((8, 8), dtype=bool)
    two[1, 1] = two[6, 6] = True
    assert masks.components(two)[1] == 2
    assert masks.stroke(two, (0, 4), (8, 4), 1).sum() > 2 and not masks.stroke(ring, (0, 30), (64, 30), 100, erase=True).any()
    assert (masks.smooth(ring, 1) == ring)[20:22].all()


def test_track_references(spark):
    events = spark.createDataFrame([("a", "interval", 0.0, 0.4, ["p1"]), ("b", "interval", 0.4, 0.8, ["p1"]), ("c", "interval", 0.0, 0.8, ["p1"]), ("d", "point", 0.4, None, ["p1"]), ("e", "point", 0.1, None, ["x"])], "event_id string, kind string, start double, end double, track_ids array<string>")
    cuts = spark.createDataFrame([("p1", "p2", 0.4)], "old string, new string, boundary double")
    got = {r["event_id"]: r["track_ids"] for r in tracks.split_references(events, cuts).collect()}
    assert got == {"a": ["p1"], "b": ["p2"], "c": ["p1", "p2"], "d": ["p2"], "e": ["x"]}


def test_coverage_cases(spark):
    t = spark.createDataFrame([("gap", 0, 3, 0, 3), ("full", 0, 3, 0, 3), ("none", 0, 3, 0, 3), ("away", 0, 3, 9, 12), ("tail", 0, 3, 0, 3)], "track_id string, start_frame int, end_frame int, ask_start int, ask_end int")
    s = spark.createDataFrame([("gap", 0, 0, True), ("gap", 3, 3, True), ("gap", 1, 2, False), ("full", 0, 1, True), ("full", 2, 5, True), ("tail", 0, 2, True)], "track_id string, start_frame int, end_frame int, reviewed boolean")
    got = {r["track_id"]: (r["covered"], r["first_gap"]) for r in tracks.coverage(t, s).collect()}
    assert got == {"gap": (False, 1), "full": (True, None), "none": (False, 0), "away": (True, None), "tail": (False, 3)}


def test_sampling(spark):
    f = spark.createDataFrame([("v", i, ts) for i, ts in enumerate([0.0, 0.1, 0.4, 0.8])], "video_id string, frame_index bigint, ts double")
    lim = lambda a, b: spark.createDataFrame([("v", a, b)], "video_id string, lower double, upper double")
    take = lambda df: sorted(r["frame_index"] for r in df.collect())
    assert take(timeline.sample_interval(f, lim(0.0, 1.0), 0.2)) == [0, 1, 2, 3]
    assert take(timeline.sample_count(f, lim(0.11, 0.39), 3)) == []
    assert take(timeline.sample_count(f, lim(0.11, 0.41), 3)) == [2]
    near = timeline.nearest_frame(spark.createDataFrame([("v", 1, 0.25), ("v", 2, 9.0)], "video_id string, point_id bigint, at double"), f)
    assert {r["point_id"]: r["frame_index"] for r in near.collect()} == {1: 1, 2: 3}


def test_too_many_samples_are_refused(spark):
    f = spark.createDataFrame([("v", i, float(i)) for i in range(0, 1001, 100)], "video_id string, frame_index bigint, ts double")
    lim = lambda b: spark.createDataFrame([("v", 0.0, b)], "video_id string, lower double, upper double")
    assert {r["fault"] for r in timeline.sample_interval(f, lim(999.5), 1.0).collect()} == {None}
    assert [tuple(r) for r in timeline.sample_interval(f, lim(1000.0), 1.0).collect()] == [("v", None, None, "too_many_samples")]


def _mask_rows(pixels, key):
    return [(key, pixels.shape[1], pixels.shape[0], x, y, c) for x, y, c in masks.window_tiles(pixels, 0, 0)]


MASKS = "object_id string, width int, height int, x int, y int, counts array<int>"


def _pictures(rows, height=300, width=400):
    out: dict = {}
    for r in rows:
        if r["fault"] is None:
            block = out.setdefault((r["object_id"], r["part"]), np.zeros((512, 512), dtype=bool))
            block[r["y"] : r["y"] + 128, r["x"] : r["x"] + 128] |= masks.pixels_of(r["counts"])
    return {k: v[:height, :width] for k, v in out.items()}


def test_masks_are_edited_as_tables(spark):
    """Edits of windows give what the edit of the whole picture gives."""
    rng = np.random.default_rng(3)
    blob = np.zeros((300, 400), dtype=bool)
    blob[100:200, 90:260] = True
    blob |= masks.dilate(rng.random(blob.shape) < 0.0004, 4) & (np.indices(blob.shape)[1] > 60)
    ring = np.zeros((300, 400), dtype=bool)
    ring[10:60, 10:60] = True
    ring[30:34, 30:34] = False
    dot = np.zeros((300, 400), dtype=bool)
    dot[299, 399] = True
    tiles = spark.createDataFrame(_mask_rows(blob, "blob") + _mask_rows(ring, "ring") + _mask_rows(dot, "dot") + [("broken", 400, 300, 0, 0, [5]), ("nosize", None, 300, 0, 0, [16384]), ("none", 400, 300, 0, 0, None)], MASKS)
    for operation, change in (("expand", masks.dilate), ("shrink", masks.erode), ("smooth", masks.smooth)):
        rows = masks.edit_masks(tiles, operation, 3).collect()
        faults = {r["object_id"]: r["fault"] for r in rows if r["fault"]}
        assert faults["broken"] == "invalid_tile" and faults["nosize"] == "outside_picture" and faults["none"] == "invalid_tile"
        got = _pictures(rows)
        if masks.holes(change(blob, 3)) >= masks.holes(blob):
            assert (got["blob", 0] == change(blob, 3)).all()
        assert "ring" in faults if operation == "expand" else True
    assert (_pictures(masks.paint_masks(tiles, (20, 20), (300, 250), 7.5).collect())["blob", 0] >= blob).all()
    counts = {r["object_id"]: (r["pixels"], r["parts"], r["holes"]) for r in masks.shape_counts(tiles).collect() if r["fault"] is None}
    assert counts["ring"] == (2484, 1, 1) and counts["dot"] == (1, 1, 0) and counts["blob"] == (int(blob.sum()), masks.components(blob)[1], masks.holes(blob))


def test_masks_are_split_as_tables(spark):
    picture = np.zeros((300, 400), dtype=bool)
    picture[10:90, 10:90] = picture[100:200, 200:320] = True
    picture[95:97, 95:97] = picture[250:252, 390:392] = True
    tiles = spark.createDataFrame(_mask_rows(picture, "m"), MASKS)
    for parts in (_pictures(masks.split_masks(tiles).collect()), _pictures(masks.split_masks(tiles, (150.0, 0.0, 150.0, 300.0)).collect())):
        assert len(parts) == 2 and (parts["m", 0] | parts["m", 1]).sum() == picture.sum() and not (parts["m", 0] & parts["m", 1]).any()
    near = _pictures(masks.split_masks(tiles).collect())
    assert near["m", 0][96, 96] and near["m", 1][251, 391]


def test_rings_are_drawn_as_tables(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [("square", 400, 300, [ring((10, 10), (200, 10), (200, 140), (10, 140))]), ("out", 400, 300, [ring((-50, -50), (20, -50), (20, 30), (-50, 30))]), ("bow", 400, 300, [ring((0, 0), (100, 100), (100, 0), (0, 100))]), ("away", 400, 300, [ring((500, 0), (600, 0), (600, 9))]), ("none", 400, 300, None), ("nan", 400, 300, [ring((0, 0), (float("nan"), 1), (2, 2))]), ("huge", 10**5, 10**5, [ring((0, 0), (90000, 0), (90000, 90000))])]
    got = masks.rasterize_rings(spark.createDataFrame(rows, "object_id string, width int, height int, rings array<array<struct<x: double, y: double>>>")).collect()
    area: dict = {}
    for r in got:
        if r["fault"] is None:
            area[r["object_id"]] = area.get(r["object_id"], 0) + int(masks.pixels_of(r["counts"]).sum())
    assert area["square"] == 190 * 130 and area["out"] == 20 * 30 and 4900 <= area["bow"] <= 5100
    assert {r["object_id"]: r["fault"] for r in got if r["fault"]} == {"away": "outside_picture", "none": "no_ring", "nan": "not_finite", "huge": "window_too_large"}


RING_LISTS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def _drawn(shapes):
    """Tiles and faults that ``drawing.draw`` gives for (width, height, rings of points)."""
    sizes = [pa.array([s[i] for s in shapes], pa.int32()) for i in (0, 1)]
    rings = pa.array([[[{"x": float(x), "y": float(y)} for x, y in r] for r in s[2]] for s in shapes], RING_LISTS)
    tiles, faults = [], {}
    for owner, *found in drawing.draw(*sizes, rings, masks.WINDOW_PIXELS):
        if len(found) == 1:
            faults |= dict(zip(owner.tolist(), found[0].tolist()))
        else:
            x, y, counts, pixels = found
            assert [sum(c[1::2]) for c in counts.to_pylist()] == pixels.tolist()
            tiles += zip(owner.tolist(), x.tolist(), y.tolist(), counts.to_pylist())
    return sorted(tiles, key=lambda t: (t[0], t[2], t[1])), faults


@pytest.mark.parametrize("at_once", [1, 500, drawing.AT_ONCE])
def test_rings_are_drawn_like_pixel_blocks(monkeypatch, at_once):
    """Boxes, crossing, touching and overlapping rings, inside and outside of the picture, whatever is drawn together."""
    monkeypatch.setattr(drawing, "AT_ONCE", at_once)
    rnd = random.Random(8)
    shapes = []
    for _ in range(150):
        grid, far = rnd.choice([0.01, 0.5, 1, 128]), rnd.choice([3, 90, 500])
        at = lambda: (round(rnd.uniform(-far / 4, far) / grid) * grid, round(rnd.uniform(-far / 4, far) / grid) * grid)  # noqa: E731, B023
        rings = [[at() for _ in range(rnd.choice([2, 3, 4, 9]))] for _ in range(rnd.choice([1, 1, 2, 5]))]
        (a, b), (c, d) = at(), at()
        shapes.append((rnd.choice([1, 128, 300, 400]), rnd.choice([1, 128, 257]), rnd.choice([rings, [[(a, b), (c, b), (c, d), (a, d)]]])))
    tiles, faults = _drawn(shapes)
    expected = []
    for n, (width, height, rings) in enumerate(shapes):
        block = masks.rasterize([r for r in rings if len(r) > 2], width, height)
        expected += [(n, x, y, c) for x, y, c in masks.window_tiles(block, 0, 0)]
        assert block.any() == (n not in faults)
    assert tiles == expected and len(faults) > 5


def test_rings_at_the_limits():
    far = 1e200
    shapes = [(300, 300, [[(-far, -far), (2 * far, -far), (-far, 2 * far)]]), (9, 9, []), (9, 9, [[(1, 1), (1, 1), (1, 1)]]), (0, 9, [[(0, 0), (5, 0), (5, 5)]]), (9, 9, [[(0, 0), (float("inf"), 0), (5, 5)]]), (2**22, 1, [[(0, 0), (2**22, 0), (2**22, 1), (0, 1)]])]
    tiles, faults = _drawn(shapes)
    assert sum(sum(c[1::2]) for n, _, _, c in tiles if n == 0) == 300 * 300
    assert sum(sum(c[1::2]) for n, _, _, c in tiles if n == 5) == 2**22 and sum(n == 5 for n, *_ in tiles) == 2**15
    assert faults == {1: "no_ring", 2: "outside_picture", 3: "no_size", 4: "not_finite"}
    assert _drawn([]) == ([], {})


def test_drawing_is_cheaper_than_pixel_blocks():
    """Three times at least; it is about fourteen times for boxes of this size."""
    rnd = random.Random(5)
    boxes_ = [(a, b, a + 220, b + 190) for a, b in ((rnd.uniform(0, 700), rnd.uniform(0, 700)) for _ in range(400))]
    shapes = [(1000, 1000, [[(a, b), (c, b), (c, d), (a, d)]]) for a, b, c, d in boxes_]
    size, rings = pa.array([1000] * len(shapes)), pa.array([[[{"x": x, "y": y} for x, y in s[2][0]]] for s in shapes], RING_LISTS)
    began = time.process_time()
    drawn = sum(len(found[0]) for found in drawing.draw(size, size, rings, masks.WINDOW_PIXELS))
    half = time.process_time()
    blocks = sum(len(masks.window_tiles(masks.rasterize(rings, 1000, 1000)[int(b) : int(d) + 1, int(a) : int(c) + 1], int(a), int(b))) for (a, b, c, d), (_, _, rings) in zip(boxes_, shapes))
    assert drawn == blocks and 3 * (half - began) < time.process_time() - half


def test_a_ring_with_a_missing_point_is_one_row(spark):
    shapes = spark.sql("select id as object_id, 64 as width, 64 as height, array(array(named_struct('x', 0d, 'y', 0d), if(id = 1, null, named_struct('x', 9d, 'y', 0d)), named_struct('x', 9d, 'y', 9d), named_struct('x', 0d, 'y', 9d))) as rings from range(2)")
    got = {r["object_id"]: (r["x"], r["y"], r["pixels"], r["fault"]) for r in masks.rasterize_rings(shapes).collect()}
    assert got == {0: (0, 0, 81, None), 1: (None, None, None, "not_finite")}


def test_column_major_rejects_single_masks(spark):
    rows = [("good", 300, 260, [10, 5, 77985]), ("large", 100000, 100000, [10**10]), ("short", 300, 260, [1, 2]), ("null", 300, 260, None)]
    got = masks.from_column_major(spark.createDataFrame(rows, "object_id string, width int, height int, counts array<bigint>")).collect()
    assert {r["object_id"]: r["fault"] for r in got} == {"good": None, "large": "picture_too_large", "short": "runs_do_not_cover_picture", "null": "runs_do_not_cover_picture"}
    tiles = spark.createDataFrame([("good", 512, 256, 0, 0, [0, 16384]), ("large", 100000, 100000, 0, 0, [0, 16384]), ("bad", 512, 256, 0, 0, [3])] + [("many", 2**15, 2**15, 128 * (i % 256), 128 * (i // 256), [0, 16384]) for i in range(4097)], MASKS)
    assert {r["object_id"]: r["fault"] for r in masks.to_column_major(tiles).collect()} == {"good": None, "large": "picture_too_large", "bad": "invalid_tile", "many": "too_many_tiles"}


def test_large_rings_by_bands_and_beyond_the_limit(spark):
    """Pairs of edges of large instances against brute force; a ring of a million points is only counted."""
    import math
    import random

    rnd = random.Random(4)
    star = [(100 * math.cos(2.4 * i) + rnd.random(), 100 * math.sin(2.4 * i)) for i in range(90)]
    plain = [(100 * math.cos(0.06 * i), 100 * math.sin(0.06 * i)) for i in range(100)]
    flat = [(float(i), 0.0) for i in range(70)]
    rings = spark.createDataFrame([("star", 0, star), ("plain", 0, plain), ("flat", 0, flat)], "k string, ring_no int, ring array<struct<x: double, y: double>>")

    def meet(a, b, c, d):
        cross = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        apart = any(max(a[i], b[i]) < min(c[i], d[i]) or max(c[i], d[i]) < min(a[i], b[i]) for i in (0, 1))
        return not apart and cross(a, b, c) * cross(a, b, d) <= 0 and cross(c, d, a) * cross(c, d, b) <= 0

    want = set()
    for key, ring in (("star", star), ("plain", plain), ("flat", flat)):
        n = len(ring)
        for i in range(n):
            for j in range(i + 1, n):
                if j - i != 1 and not (i == 0 and j == n - 1) and meet(ring[i], ring[(i + 1) % n], ring[j], ring[(j + 1) % n]):
                    want.add((key, i, j))
    assert {(r["k"], r["edge_a"], r["edge_b"]) for r in polygons.edge_conflicts(rings, ["k"]).collect()} == want
    assert {r["k"]: r["fault"] for r in polygons.faults(rings, ["k"]).collect()} == {"star": "edges_meet", "plain": None, "flat": "no_area"}
    long = spark.range(1).select(F.lit("long").alias("k"), F.lit(0).alias("ring_no"), F.transform(F.sequence(F.lit(0), F.lit(10**6)), lambda i: F.struct(i.cast("double").alias("x"), F.sqrt(i.cast("double")).alias("y"))).alias("ring"))
    assert [r["fault"] for r in polygons.faults(long.unionByName(rings.limit(0)), ["k"]).collect()] == ["too_large"]


def test_document_faults(spark):
    videos = spark.createDataFrame([("v", 10, 64, 32)], "video_id string, frame_count int, width int, height int")
    t = spark.createDataFrame([("v", "ok", 1, 0, 3, True), ("v", "late", 1, 0, 12, False), ("v", "bare", 1, 0, 3, True), ("v", "label", 9, 0, 3, False)], "video_id string, track_id string, label_id int, start_frame int, end_frame int, reviewed boolean")
    k = spark.createDataFrame([("ok", 0, "visible", True, 0.0, 0.0, 9.0, 9.0), ("late", 2, "visible", True, 0.0, 0.0, 99.0, 9.0), ("bare", 7, "outside", True, None, None, None, None)], "track_id string, frame_index int, visibility string, reviewed boolean, x1 double, y1 double, x2 double, y2 double")
    r = spark.createDataFrame([("ok", 1, 3, True), ("late", 2, 4, True)], "track_id string, start_frame int, end_frame int, reviewed boolean")
    got = {(x["track_id"], x["fault"]) for x in documents.document_faults(videos, t, k, r, spark.createDataFrame([(1,)], "label_id int")).collect()}
    assert got == {("late", "past_video_end"), ("late", "shape_outside_video"), ("late", "overlapping_spans"), ("bare", "keyframe_outside_lifetime"), ("bare", "reviewed_without_coverage"), ("label", "unknown_label")}


def test_bundles(spark):
    videos = spark.createDataFrame([("v", "AB"), ("w", None)], "video_id string, sha256 string")
    labels = spark.createDataFrame([("l",)], "label_id string")
    good = spark.createDataFrame([("ab", "e1", "l", True), ("AB", "e2", None, True)], "sha256 string, event_id string, label_id string, reviewed boolean")
    events, rejects = documents.import_bundle(good, videos, labels)
    assert {(r["event_id"], r["video_id"], r["reviewed"]) for r in events.collect()} == {("e1", "v", False), ("e2", "v", False)} and rejects.count() == 0
    events, rejects = documents.import_bundle(good.union(spark.createDataFrame([("cd", "e3", "x", True)], good.schema)), videos, labels)
    assert events.count() == 0 and [r["event_id"] for r in rejects.collect()] == ["e3"]


def test_edits_and_extraction(spark):
    schema = "track_id string, frame_index int, geometry string, origin string, reviewed boolean"
    before = spark.createDataFrame([("t", 1, "g", "ai", True), ("t", 2, "g", "ai", True)], schema)
    after = spark.createDataFrame([("t", 1, "h", "ai", True), ("t", 2, "g", "ai", True), ("t", 3, "n", "human", True)], schema)
    got = {r["frame_index"]: (r["origin"], r["reviewed"]) for r in documents.edited_keyframes(before, after).collect()}
    assert got == {1: ("human", False), 2: ("ai", True), 3: ("human", True)}
    frames = spark.createDataFrame([("v", i, i / 10) for i in range(5)], "video_id string, frame_index int, ts double")
    added, skipped = documents.extracted_pictures(frames, spark.createDataFrame([("v", 1), ("v", 3), ("v", 1)], "video_id string, frame_index int"), spark.createDataFrame([("v", 3)], "video_id string, frame_index int"))
    assert [r["path"] for r in added.collect()] == ["v-frame-00000001.jpg"] and skipped.count() == 1


TEXTS = [
    (T.slug, " My  Set! ", "my-set"), (T.slug, "???", "project"), (T.label_file, "a/images/b/images/c.jpg", "a/images/b/labels/c.txt"), (T.label_file, "images.jpg", "images.txt"), (T.redact_text, "see /home/me/x, C:\\a or http://x/y", "see [local-path] [local-path] or http://x/y"),
    (T.redact_text, "测/home/x", "测/home/x"), (T.base_url, " https://h:1/v1// ", "https://h:1/v1"), (T.base_url, "https://u@h/v1", None), (T.base_url, "ftp://h", None), (T.model_object, 'x ```json\n{"a": 1}\n``` y', '{"a": 1}'), (T.model_object, 'say {"a": {"b": 2}} ok', '{"a": {"b": 2}}'),
    (T.model_object, "[1]", None), (T.local_file_reference, "/data/local-files/?d=images/a%20b.jpg", "images/a b.jpg"), (T.local_file_reference, "http://x/a.jpg", None), (T.quote_path, "a b/ü~.jpg", "a%20b/%C3%BC~.jpg"), (T.normalize_label, "  a \t b ", "a b"),
]


@pytest.mark.parametrize("function,value,want", TEXTS)
def test_text_functions(spark, function, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(function(F.col("v")).alias("o")).first()["o"] == want


@pytest.mark.parametrize("path", ["../outside.jpg", "/absolute.jpg", "dir/../../out.jpg", "C:\\img.jpg", "", ".", "a\nb", " a", None])
def test_paths_that_are_not_portable(spark, path):
    assert not spark.createDataFrame([(path,)], "v string").select(F.coalesce(T.portable_path(F.col("v")), F.lit(False)).alias("o")).first()["o"]


def test_catalog_numbers(spark):
    rows = [(0, "a", 5), (1, "b", -1), (2, "c", 5), (3, "d", None), (4, "e", 2)]
    got = {r["name"]: r["coco_id"] for r in catalogs.coco_ids(spark.createDataFrame(rows, "ord int, name string, source_id int")).collect()}
    assert got == {"a": 5, "b": 1, "c": 2, "d": 3, "e": 4}
