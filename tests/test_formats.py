"""Readers on written cases with faults; writers through the files they make."""

import json

import pytest
from pyspark.sql import functions as F

from framelore.sources import dataset, formats

FILES = "file string, content string"


def _files(spark, rows):
    return spark.createDataFrame(rows, FILES)


def _boxes(ds):
    return sorted((r["path"], r["label"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in ds.objects.collect())


def test_coco_with_bad_rows(spark):
    """One document with every fault a row can have."""
    sound = {"image_id": 501, "category_id": 31, "bbox": [4, 8, 16, 32]}
    body = {
        "images": [{"id": 501, "file_name": "halle 2/kran-ü.tif", "width": 64, "height": 48}, {"id": 502, "file_name": "leer.webp", "width": 64, "height": 48}, {"id": 502, "file_name": "zwilling.webp", "width": 8, "height": 8}, {"id": 503, "file_name": "/etc/x.png", "width": 8, "height": 8}, {"id": 504, "file_name": "flat.png", "width": 0, "height": 8}],
        "categories": [{"id": 31, "name": "Kran"}, {"id": 44, "name": "Riss"}, {"id": 45, "name": "Riss"}],
        "annotations": [
            sound | {"id": 1, "iscrowd": 1}, sound | {"id": 2, "category_id": 45, "bbox": [-5, -5, 9, 9]}, sound | {"id": 3, "category_id": 77}, sound | {"id": 4, "bbox": [3, 3, 0, 9]}, sound | {"id": 1}, sound | {"id": 5, "image_id": 999},
            sound | {"id": 6.5}, sound | {"id": 7, "bbox": [1, 2, 3]}, sound | {"id": 8, "iscrowd": 2}, sound | {"id": 9, "bbox": [70, 50, 5, 5]},
        ],
    }
    ds = formats.read_coco(_files(spark, [("halle.json", json.dumps(body))]))
    assert _boxes(ds) == [("halle 2/kran-ü.tif", "Kran", 4, 8, 20, 40), ("halle 2/kran-ü.tif", "Riss", 0, 0, 4, 4)]
    assert sorted(r["path"] for r in ds.images.collect()) == ["halle 2/kran-ü.tif", "leer.webp"]
    codes = sorted(r["code"] for r in ds.issues.collect())
    assert codes == ["clipped_bbox", *["invalid_annotation"] * 8, *["invalid_image"] * 3]
    assert sorted(r["name"] for r in ds.categories.collect()) == ["Kran", "Riss"]


def test_yolo_with_bad_rows(spark):
    images = spark.createDataFrame([("images/a.jpg", 100, 80, "train"), ("images/b.jpg", 100, 80, "val"), ("images/a.png", 100, 80, "val")], "path string, width int, height int, split string")
    names = spark.createDataFrame([(0, "x")], "category_id int, name string")
    text = "0 .5 .5 0 .4\n0 nan .5 .2 .4\r\n7 .5 .5 .2 .4\n0 1 2 3 4 5 6\n\n0 1.5 .5 .2 .4\n0 .5 .5 .2 .4\n"
    ds = formats.read_yolo(_files(spark, [("labels/a.txt", text)]), images, names)
    assert [(p, label, *(round(v, 6) for v in b)) for p, label, *b in _boxes(ds)] == [("images/a.jpg", "x", 40, 24, 60, 56)]
    assert sorted(r["code"] for r in ds.issues.collect()) == ["ambiguous_label_file", *["invalid_annotation"] * 5, "missing_label_file"]


def test_yolo_names_do_not_collide(spark):
    images = spark.createDataFrame([("same.jpg", "val"), ("same.png", "val"), ("images/train/x/images/y.jpg", "unspecified")], "path string, split string")
    rows = {r["path"]: (r["image_file"], r["label_file"]) for r in formats.yolo_paths(images).collect()}
    assert rows["same.jpg"] == ("images/val/same.jpg", "labels/val/same.txt") and rows["same.png"][1] != "labels/val/same.txt" and rows["same.png"][0].endswith(".png")
    assert rows["images/train/x/images/y.jpg"] == ("images/train/x/_images/y.jpg", "labels/train/x/_images/y.txt")


def test_voc_refuses_entities(spark):
    good = "<annotation><filename>a.jpg</filename><size><width>9</width><height>9</height></size><object><name>x&amp;y</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object><object><name>x</name></object></annotation>"
    rows = [("Annotations/a.xml", good), ("Annotations/b.xml", "<!DOCTYPE a [<!ENTITY e 'x'>]>" + good), ("Annotations/c.xml", "<annotation>"), ("ImageSets/Main/val.txt", "a\n")]
    ds = formats.read_voc(_files(spark, rows))
    assert _boxes(ds) == [("JPEGImages/a.jpg", "x&y", 0, 1, 3, 4)] and ds.images.first()["split"] == "val"
    assert sorted(r["code"] for r in ds.issues.collect()) == ["invalid_annotation", "invalid_xml", "invalid_xml"]


def test_cvat_refuses_tracks_and_turned_boxes(spark):
    box = '<box label="x" occluded="{}" rotation="{}" xtl="1" ytl="2" xbr="3" ybr="4" z_order="0"><attribute name="a">b</attribute></box>'
    doc = '<annotations><version>1.1</version><image id="0" name="a.jpg" width="9" height="9">' + box.format(0, 0) + box.format(0, 5) + box.format(2, 0) + "</image></annotations>"
    ds = formats.read_cvat(_files(spark, [("a.xml", doc), ("b.xml", "<annotations><version>1.1</version><track>x</track></annotations>"), ("c.xml", "<annotations><version>2</version></annotations>")]))
    assert _boxes(ds) == [("a.jpg", "x", 1, 2, 3, 4)] and ds.objects.first()["attributes"]["a"] == "b"
    assert sorted(r["code"] for r in ds.issues.collect()) == ["invalid_annotation"] * 2 + ["unsupported_document"] * 2


def test_label_studio_versions(spark):
    result = lambda **x: {"type": "rectanglelabels", "original_width": 200, "original_height": 100, "value": {"x": 10, "y": 10, "width": 20, "height": 20, "rotation": 0, "rectanglelabels": ["x"]} | x}
    tasks = [
        {"id": 1, "data": {"image": "/data/local-files/?d=images/a%20b.jpg"}, "annotations": [{"was_cancelled": True, "result": []}, {"result": [result(), result(rotation=3)]}], "predictions": [{"result": []}]},
        {"id": 2, "data": {"image": "b.jpg"}, "annotations": [{"result": [result()]}, {"result": [result()]}]}, {"id": 3, "data": {"image": "http://x/c.jpg"}, "predictions": [{"result": [result()]}]},
    ]
    ds = formats.read_label_studio(_files(spark, [("annotations.json", json.dumps(tasks))]))
    assert _boxes(ds) == [("images/a b.jpg", "x", 20, 10, 60, 30)]
    assert sorted(r["code"] for r in ds.issues.collect()) == ["invalid_annotation", "invalid_label_studio_task", "invalid_label_studio_task"]


def test_labelme_corners_in_any_order(spark):
    doc = {"imagePath": "a.jpg", "imageWidth": 9, "imageHeight": 9, "shapes": [{"label": "x", "points": [[5, 6], [1, 2]], "shape_type": "rectangle"}, {"label": "x", "points": [[5, 6]], "shape_type": "polygon"}]}
    ds = formats.read_labelme(_files(spark, [("d/a.json", json.dumps(doc)), ("d/b.json", "{}")]))
    assert _boxes(ds) == [("d/a.jpg", "x", 1, 2, 5, 6)] and sorted(r["code"] for r in ds.issues.collect()) == ["invalid_annotation", "invalid_labelme"]


def test_native_trust(spark):
    line = json.dumps({"path": "a.jpg", "width": 9, "height": 9, "split": "val", "status": "human_reviewed", "objects": []})
    files = _files(spark, [("pictures-00000.jsonl", line), ("categories.json", "[]")])
    assert formats.read_native(files).images.first()["status"] == "imported_coarse"
    assert formats.read_native(files, trust_reviewed=True).images.first()["status"] == "human_reviewed"
    changed = formats.read_native(files, actual=spark.createDataFrame([("a.jpg", 9, 8)], "path string, width int, height int"))
    assert changed.images.count() == 0 and changed.issues.count() == 1


def test_shapes_round_trip(spark):
    images = spark.createDataFrame([("a.jpg", 300, 260, "val")], "path string, width int, height int, split string")
    ring = [(1.0, 2.0), (5.0, 2.0), (5.0, 9.0)]
    shapes = spark.createDataFrame([("a.jpg", 0, "x", [ring], None), ("a.jpg", 1, "x", None, [10, 5, 77985])], "path string, ord bigint, label string, rings array<array<struct<x: double, y: double>>>, counts array<bigint>")
    files = formats.write_coco_shapes(images, shapes, spark.createDataFrame([(0, "x")], "category_id int, name string"))
    got, issues = formats.read_coco_shapes(files)
    rows = got.collect()
    assert {str(r["counts"]) for r in rows} == {"None", "[10, 5, 77985]"} and issues.count() == 0
    assert [tuple(p) for p in next(r["rings"] for r in rows if r["rings"])[0]] == ring


def _one_shape(segmentation):
    return {"images": [{"id": 8, "file_name": "s.png", "width": 40, "height": 30}], "categories": [{"id": 2, "name": "kerbe"}], "annotations": [{"id": 3, "image_id": 8, "category_id": 2, "segmentation": segmentation}]}


# Runs of a picture of 40 x 30 pixels: too short, too long, negative, an empty run inside, no foreground, not a code; then polygons of too few or odd values, and nothing.
@pytest.mark.parametrize("segmentation", [{"counts": [600, 599]}, {"counts": [600, 601]}, {"counts": [1300, -200, 100]}, {"counts": [5, 0, 1195]}, {"counts": [1200]}, {"counts": "~~"}, [[4.0, 4.0, 8.0, 8.0]], [[1, 1, 9, 1, 9]], [], None])
def test_bad_shapes(spark, segmentation):
    shapes, issues = formats.read_coco_shapes(_files(spark, [("one.json", json.dumps(_one_shape(segmentation)))]))
    assert shapes.count() == 0 and [r["code"] for r in issues.collect()] == ["invalid_annotation"]


@pytest.mark.parametrize(
    "rings,pixels",
    [
        ([[2, 2, 12, 12, 12, 2, 2, 12]], 50),  # crosses itself: two triangles
        ([[30, 20, 60, 20, 60, 50, 30, 50]], 100),  # leaves the picture: the part inside
        ([[0, 0, 10, 0, 10, 10, 0, 10], [2, 2, 6, 2, 6, 6, 2, 6]], 100),  # a ring in a ring: both are filled
    ],
)
def test_faulty_polygons_become_masks(spark, rings, pixels):
    shapes, issues = formats.read_coco_shapes(_files(spark, [("one.json", json.dumps(_one_shape(rings)))]))
    row = shapes.first()
    assert row["rings"] is None and sum(row["counts"]) == 1200 and abs(sum(row["counts"][1::2]) - pixels) <= 10
    assert [(r["code"], r["severity"]) for r in issues.collect()] == [("polygon_rasterized", "warning")]


def test_polygons_without_a_pixel_are_left_out(spark):
    shapes, issues = formats.read_coco_shapes(_files(spark, [("one.json", json.dumps(_one_shape([[50, 40, 60, 40, 60, 45]])))]))
    assert shapes.count() == 0 and [(r["code"], r["message"]) for r in issues.collect()] == [("invalid_annotation", "outside_picture")]


@pytest.mark.parametrize("name", ["coco_detection", "cvat_detection", "native"])
def test_files_on_disk(spark, tmp_path, name):
    images = spark.createDataFrame([("werk 7/ölfleck №3.jpg", 220, 90, "val", "human_reviewed"), ("werk 7/nichts.png", 12, 14, "train", "unreviewed")], "path string, width int, height int, split string, status string")
    objects = spark.createDataFrame([("werk 7/ölfleck №3.jpg", "o", 0, "fleck \"<&>\"", 17.5, 3.25, 99.75, 71.5, None, {"iscrowd": "0"})], "path string, object_id string, ord bigint, label string, x1 double, y1 double, x2 double, y2 double, confidence double, attributes map<string,string>")
    ds = dataset.Dataset(images, objects, spark.createDataFrame([(0, "fleck \"<&>\""), (1, "rest")], "category_id int, name string"))
    read, write = formats.REGISTRY[name]
    written = dataset.save_files(write(ds), str(tmp_path))
    back = read(dataset.read_files(spark, str(tmp_path)))
    assert dataset.same_datasets(ds.objects, back.objects).count() == 0 and back.images.count() == 2
    assert sorted(r["name"] for r in back.categories.collect()) == ["fleck \"<&>\"", "rest"]
    found = dataset.read_files(spark, str(tmp_path))
    assert dataset.changed_since_saved(written, found).collect() == []
    other = found.withColumn("content", F.when(F.col("file") == written.first()["file"], F.lit("x")).otherwise(F.col("content"))).unionByName(spark.createDataFrame([("new.txt", "x")], FILES))
    assert sorted(r["fault"] for r in dataset.changed_since_saved(written, other).collect()) == ["changed", "unexpected"]
