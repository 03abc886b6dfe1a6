"""Readers and writers of dataset formats, as transformations between tables and (file, content) rows.

Nothing here opens a file: ``read_files`` and ``save_files`` do.  Formats that
keep a whole dataset in one document (COCO, CVAT, Label Studio) are written as
several complete documents of at most ``per_file`` pictures, so no task has to
hold the dataset; each document can be read by itself.  Class numbers are
joined from the catalog, which is small.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from framelore.functions.geometry import decode_coco_counts, encode_coco_counts
from framelore.functions.text import label_file, local_file_reference, path_key, portable_path, quote_path
from framelore.operators import boxes as B
from framelore.operators import masks as M
from framelore.operators import polygons as P
from framelore.operators.catalogs import merge_categories
from framelore.sources.dataset import Dataset, take_objects
from framelore.tables import blocks_for, stage

PER_FILE = 5000
HUMAN = ["human_reviewed", "final_reviewed"]
_BOX = ["x1", "y1", "x2", "y2"]
_ATTRIBUTES = "map<string,string>"


def _box() -> list[Column]:
    return [F.col(c) for c in _BOX]


def _sharded(ds: Dataset, per_file: int) -> DataFrame:
    """Pictures with the document they go to and their number in it."""
    shards = blocks_for(ds.images.count(), per_file)
    w = Window.partitionBy("shard").orderBy("path")
    return ds.images.withColumn("shard", F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int")).withColumn("number", F.row_number().over(w))


def _grouped(ds: Dataset, item: Column, name: str) -> DataFrame:
    """path with the ordered list of ``item`` of its objects."""
    return ds.objects.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "object_id", item.alias("v")))).alias(name))


def _values(name: str) -> Column:
    return F.transform(F.coalesce(F.col(name), F.array()), lambda s: s["v"])


def _issue(rows: DataFrame, code: str, location: Column, message: Column | str, severity: str = "error") -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select("file", F.lit(code).alias("code"), location.cast("string").alias("location"), text.alias("message"), F.lit(severity).alias("severity"))


def _join_class(objects: DataFrame, categories: DataFrame) -> DataFrame:
    return objects.join(categories.select("category_id", F.col("name").alias("label")), "label")


# --- COCO ---------------------------------------------------------------------

_COCO = (
    "images array<struct<id: bigint, file_name: string, width: int, height: int, split: string>>, "
    "annotations array<struct<id: bigint, image_id: bigint, category_id: bigint, bbox: array<double>, iscrowd: int, score: double, area: double>>, "
    "categories array<struct<id: bigint, name: string>>"
)


def write_coco(ds: Dataset, per_file: int = PER_FILE) -> DataFrame:
    """instances_<split>-<n>.json: ids regenerated, unique over all documents, boxes as corner and size, area of the box."""
    coco = ds.categories.select(F.col("category_id").alias("id"), "name").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("categories"))
    images = _sharded(ds, per_file).withColumn("image_id", F.col("shard").cast("bigint") * (1 << 24) + F.col("number"))
    x, y, w, h = B.to_coco(_box())
    numbered = _join_class(ds.objects, ds.categories).join(images.select("path", "shard", "split", "image_id"), "path")
    order = Window.partitionBy("shard", "split").orderBy("image_id", "ord", "object_id")
    rows = numbered.withColumn("n", F.row_number().over(order)).select(
        "shard", "split", "n",
        F.struct((F.col("shard").cast("bigint") * (1 << 32) + F.col("n")).alias("id"), "image_id", "category_id", F.array(x, y, w, h).alias("bbox"), (w * h).alias("area"),
                 F.coalesce(F.element_at("attributes", "iscrowd").try_cast("int"), F.lit(0)).alias("iscrowd")).alias("a"),
    )
    annotations = rows.groupBy("shard", "split").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "a"))), lambda s: s["a"]).alias("annotations"))
    pictures = images.groupBy("shard", "split").agg(F.array_sort(F.collect_list(F.struct(F.col("image_id").alias("id"), F.col("path").alias("file_name"), "width", "height", "split"))).alias("images"))
    body = pictures.join(annotations, ["shard", "split"], "left").join(F.broadcast(coco))  # one row
    empty = F.coalesce("annotations", F.array())
    return body.select(F.format_string("annotations/instances_%s-%05d.json", "split", "shard").alias("file"), F.to_json(F.struct("images", empty.alias("annotations"), "categories")).alias("content"))


def read_coco(files: DataFrame, split: str = "unspecified") -> Dataset:
    """COCO documents to a dataset, with a report of what was left out.

    Whole-number ids only; of rows with one id the first is taken; a path must
    be portable and come once; annotations need their picture and class, a
    sound box and iscrowd 0 or 1.
    """
    parsed = files.withColumn("d", F.from_json("content", _COCO)).where("d is not null and (d.images is not null or d.annotations is not null)")
    classes = parsed.select("file", F.posexplode("d.categories").alias("pos", "c")).select("file", F.concat_ws("/", "file", F.lpad(F.col("pos").cast("string"), 8, "0")).alias("ord"), F.col("c.id").alias("source_id"), F.trim("c.name").alias("name"))
    pictures = parsed.select("file", F.posexplode("d.images").alias("pos", "i")).select("file", "pos", "i.*")
    first_id = F.row_number().over(Window.partitionBy("file", "id").orderBy("pos"))
    first_path = F.row_number().over(Window.partitionBy("file_name").orderBy("file", "pos"))
    judged = pictures.withColumn("_id", first_id).withColumn("_path", first_path)
    fault = F.when(F.col("id").isNull() | (F.col("_id") > 1), "missing or duplicate id").when(~F.coalesce(portable_path(F.col("file_name")), F.lit(False)), "path is not portable").when(F.col("_path") > 1, "duplicate file_name").when(~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)), "no size")
    judged = judged.withColumn("fault", fault)
    good = judged.where("fault is null")
    images = good.select(F.col("file_name").alias("path"), "width", "height", F.coalesce("split", F.lit(split)).alias("split"), F.lit("imported_coarse").alias("status"))
    rows = parsed.select("file", F.posexplode("d.annotations").alias("pos", "a")).select("file", "pos", "a.*")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("file", "id").orderBy("pos")))
    rows = rows.join(good.select("file", F.col("id").alias("image_id"), F.col("file_name").alias("path")), ["file", "image_id"], "left")
    rows = rows.join(classes.select("file", F.col("source_id").alias("category_id"), F.col("name").alias("label")).dropDuplicates(["file", "category_id"]), ["file", "category_id"], "left")
    wrong = (
        F.when(F.col("id").isNull() | (F.col("_n") > 1), "missing or duplicate id").when(F.col("path").isNull(), "missing_image").when(F.col("label").isNull(), "unknown category")
        .when(F.size("bbox") != 4, "not_four_values").when(~F.coalesce("iscrowd", F.lit(0)).isin(0, 1), "iscrowd must be 0 or 1")
    )
    rows = rows.select("*", F.format_string("annotations[%d]", "pos").alias("location"), F.concat(F.lit("import-"), F.col("id").cast("string")).alias("object_id"), F.col("pos").cast("bigint").alias("ord"), F.col("score").alias("confidence"), F.create_map(F.lit("iscrowd"), F.coalesce("iscrowd", F.lit(0)).cast("string")).alias("attributes"))
    objects, issues = take_objects(rows, images, B.from_coco(B.box_columns(F.col("bbox"))), wrong)
    merged = merge_categories(classes.groupBy("name").agg(F.min("ord").alias("ord"), F.min_by("source_id", "ord").alias("source_id")))
    bad = _issue(judged.where("fault is not null"), "invalid_image", F.col("id"), F.col("fault"))
    return Dataset(images, objects, merged.select("category_id", "name"), issues.unionByName(bad))


# --- COCO with shapes ------------------------------------------------------------

_SEGMENTED = (
    "images array<struct<id: bigint, file_name: string, width: int, height: int, split: string>>, "
    "annotations array<struct<id: bigint, image_id: bigint, category_id: bigint, segmentation: string, iscrowd: int, score: double>>, "
    "categories array<struct<id: bigint, name: string>>"
)


def write_coco_shapes(images: DataFrame, shapes: DataFrame, categories: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """COCO instance segmentation: polygons flat, masks as compressed column-major runs.

    ``shapes`` (path, ord, label, rings array<ring>, counts array<bigint>) has
    rings for polygons or column-major counts for masks.
    """
    coco = categories.select(F.col("category_id").alias("id"), "name").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "name")))).alias("categories"))
    placed = _sharded(Dataset(images, shapes, categories), per_file).withColumn("image_id", F.col("shard").cast("bigint") * (1 << 24) + F.col("number"))
    flat = F.transform("rings", lambda r: F.flatten(F.transform(r, lambda p: F.array(p["x"], p["y"]))))
    sized = _join_class(shapes, categories).join(placed.select("path", "shard", "split", "image_id", "width", "height"), "path")
    runs = F.to_json(F.struct(F.array("height", "width").alias("size"), encode_coco_counts(F.col("counts")).alias("counts")))
    numbered = sized.withColumn("n", F.row_number().over(Window.partitionBy("shard", "split").orderBy("image_id", "ord")))
    body = F.concat(
        F.lit('{"id":'), (F.col("shard").cast("bigint") * (1 << 32) + F.col("n")).cast("string"), F.lit(',"image_id":'), F.col("image_id").cast("string"), F.lit(',"category_id":'), F.col("category_id").cast("string"),
        F.lit(',"iscrowd":0,"segmentation":'), F.when(F.col("counts").isNotNull(), runs).otherwise(F.to_json(flat)), F.lit("}"),
    )
    annotations = numbered.select("shard", "split", "n", body.alias("a")).groupBy("shard", "split").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "a"))), lambda s: s["a"]), ",").alias("annotations"))
    pictures = placed.groupBy("shard", "split").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("image_id").alias("id"), F.col("path").alias("file_name"), "width", "height", "split")))).alias("images"))
    whole = pictures.join(annotations, ["shard", "split"], "left").join(F.broadcast(coco))  # one row
    text = F.concat(F.lit('{"images":'), "images", F.lit(',"annotations":['), F.coalesce("annotations", F.lit("")), F.lit('],"categories":'), "categories", F.lit("}"))
    return whole.select(F.format_string("annotations/instances_%s-%05d.json", "split", "shard").alias("file"), text.alias("content"))


def read_coco_shapes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shapes, issues) of COCO documents with segmentation.

    shapes (path, object_id, label, width, height, rings, counts): polygons as
    rings without a repeated closing vertex, masks as column-major counts from
    compressed text or number lists.  Runs must be positive except the first,
    cover the picture and hold foreground.  Polygons that cross themselves or
    reach out of the picture become one mask of the pixels inside it, with a
    warning; those that cover no pixel are left out.
    """
    parsed = files.withColumn("d", F.from_json("content", _SEGMENTED)).where("d.images is not null")
    images = parsed.select("file", F.explode("d.images").alias("i")).select("file", F.col("i.id").alias("image_id"), F.col("i.file_name").alias("path"), F.col("i.width").alias("width"), F.col("i.height").alias("height")).dropDuplicates(["file", "image_id"])
    classes = parsed.select("file", F.explode("d.categories").alias("c")).select("file", F.col("c.id").alias("category_id"), F.trim("c.name").alias("label")).dropDuplicates(["file", "category_id"])
    rows = parsed.select("file", F.posexplode("d.annotations").alias("pos", "a")).select("file", "pos", "a.*").join(images, ["file", "image_id"], "left").join(classes, ["file", "category_id"], "left")
    s = F.col("segmentation")
    is_runs = s.startswith("{")
    as_text = F.from_json(s, "counts string")["counts"]
    as_list = F.from_json(s, "counts array<bigint>")["counts"]
    counts = F.when(is_runs, F.when(as_text.startswith("["), as_list).otherwise(decode_coco_counts(as_text)))
    flat = F.when(~is_runs, F.from_json(s, "array<array<double>>"))
    points = lambda r: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size(r) / 2).cast("int") - 1)), lambda i: F.struct(F.get(r, i * 2).alias("x"), F.get(r, i * 2 + 1).alias("y")))
    opened = lambda r: F.when((F.size(r) > 3) & (F.get(r, F.lit(0)) == F.element_at(r, -1)), F.slice(r, 1, F.size(r) - 1)).otherwise(r)
    rows = rows.withColumn("counts", counts).withColumn("rings", F.transform(flat, lambda r: opened(points(r))))
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda t, n: t + n)
    inner = F.slice("counts", 2, F.greatest(F.size("counts") - 1, F.lit(0)))
    good_runs = (F.get("counts", F.lit(0)) >= 0) & F.forall(inner, lambda n: n > 0) & (F.size("counts") >= 2) & (total == F.col("width").cast("bigint") * F.col("height"))
    good_rings = (F.size("rings") > 0) & F.forall(flat, lambda r: (F.size(r) >= 6) & (F.size(r) % 2 == 0))
    fault = (
        F.when(F.col("path").isNull(), "missing_image").when(F.col("label").isNull(), "unknown category").when(s.isNull(), "no segmentation")
        .when(is_runs & ~F.coalesce(good_runs, F.lit(False)), "invalid runs").when(~is_runs & ~F.coalesce(good_rings, F.lit(False)), "invalid polygon")
    )
    judged = stage(rows.withColumn("fault", fault).withColumn("_row", F.concat_ws("\x1f", "file", F.col("pos").cast("string"))), "coco-shapes")
    polygons = judged.where("fault is null and rings is not null")
    outside = F.exists("rings", lambda r: F.exists(r, lambda p: (p.x < 0) | (p.y < 0) | (p.x > F.col("width")) | (p.y > F.col("height"))))
    faulty = P.faults(polygons.select("_row", F.posexplode("rings").alias("ring_no", "ring")), ["_row"]).where("fault is not null").select("_row")
    redrawn = stage(polygons.where(outside).select("_row").unionByName(faulty).distinct(), "coco-redrawn")
    sized = polygons.join(redrawn, "_row").select(F.col("_row").alias("object_id"), "width", "height", "rings")
    drawn = M.rasterize_rings(sized)
    tiles = drawn.where("fault is null").join(sized.drop("rings"), "object_id").select("object_id", "width", "height", "x", "y", "counts")
    runs = M.to_column_major(tiles).unionByName(drawn.where("fault is not null").select("object_id", F.lit(None).cast("array<bigint>").alias("counts"), "fault"))
    runs = stage(runs.select(F.col("object_id").alias("_row"), F.col("counts").alias("_counts"), F.col("fault").alias("_drawn_fault"), F.lit(True).alias("_drawn")), "coco-drawn")
    done = judged.join(runs, "_row", "left")
    good = done.where("fault is null and _drawn_fault is null")
    is_drawn = F.col("_drawn").isNotNull()
    shapes = good.select("path", F.concat(F.lit("import-"), F.col("id").cast("string")).alias("object_id"), "label", "width", "height", F.when(~is_drawn, F.col("rings")).alias("rings"), F.when(is_drawn, F.col("_counts")).otherwise(F.col("counts")).alias("counts"))
    at = F.format_string("annotations[%d]", "pos")
    bad = _issue(done.where("fault is not null or _drawn_fault is not null"), "invalid_annotation", at, F.coalesce("fault", "_drawn_fault"))
    return shapes, bad.unionByName(_issue(good.where(is_drawn), "polygon_rasterized", at, "polygon crosses itself or leaves the picture; kept as a mask", "warning"))


# --- YOLO ---------------------------------------------------------------------


@F.pandas_udf(StringType())
def _twelve_digits(v: pd.Series) -> pd.Series:
    """Shortest text of up to twelve significant digits."""
    return v.map(lambda x: None if pd.isna(x) else f"{x:.12g}")


def yolo_paths(images: DataFrame) -> DataFrame:
    """Pictures with their place and label file in a YOLO tree; colliding label files get a digest in their name."""
    split = F.when(F.col("split").isin("train", "val", "test"), F.col("split")).otherwise("train")
    bare = F.regexp_replace(F.regexp_replace("path", "^images/(?=.)", ""), "/images/(?=.*)", "/_images/")
    bare = F.when(F.col("path").rlike("^images/(train|val|test)/."), F.regexp_replace(bare, "^(train|val|test)/", "")).otherwise(bare)
    bare = F.regexp_replace(bare, "^images/", "_images/")
    stem = F.regexp_replace(bare, r"(?<=[^/])[.][^./]+$", "")
    placed = images.withColumn("yolo_split", split).withColumn("_bare", bare).withColumn("_stem", stem)
    n = F.row_number().over(Window.partitionBy("yolo_split", "_stem").orderBy("path"))
    end = F.regexp_extract("_bare", r"(?<=[^/])([.][^./]+)$", 1)
    renamed = F.when(n > 1, F.concat("_stem", F.lit("__"), path_key(F.col("path"), 12), end)).otherwise(F.col("_bare"))
    out = placed.withColumn("image_file", F.concat_ws("/", F.lit("images"), "yolo_split", renamed))
    return out.withColumn("label_file", label_file(F.col("image_file"))).drop("_bare", "_stem")


def write_yolo(ds: Dataset) -> DataFrame:
    """One label file per picture (empty ones too), lists per split and data.yaml; classes numbered from 0.

    The lists are cut into parts per block of pictures and named in data.yaml.
    """
    dense = ds.categories.select("name", (F.row_number().over(Window.orderBy("category_id")) - 1).alias("class"))
    placed = yolo_paths(ds.images)
    objects = ds.objects.join(dense.withColumnRenamed("name", "label"), "label").join(placed.select("path", "width", "height"), "path")
    numbers = [_twelve_digits(c) for c in B.to_yolo(_box(), F.col("width"), F.col("height"))]
    lines = objects.select("path", "ord", "object_id", F.concat_ws(" ", F.col("class").cast("string"), *numbers).alias("line")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "object_id", "line"))).alias("l"))
    body = F.coalesce(F.concat(F.array_join(F.transform("l", lambda s: s["line"]), "\n"), F.lit("\n")), F.lit(""))
    labels = placed.join(lines, "path", "left").select(F.col("label_file").alias("file"), body.alias("content"))
    blocks = blocks_for(ds.images.count(), 100_000)
    parts = placed.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(blocks))).groupBy("yolo_split", "part").agg(F.array_sort(F.collect_list(F.concat(F.lit("./"), "image_file"))).alias("f"))
    lists = parts.select(F.format_string("%s-%05d.txt", "yolo_split", "part").alias("file"), F.concat(F.array_join("f", "\n"), F.lit("\n")).alias("content"), "yolo_split")
    named = lists.groupBy("yolo_split").agg(F.array_sort(F.collect_list("file")).alias("files")).select(F.concat("yolo_split", F.lit(": "), F.to_json("files")).alias("line")).agg(F.array_sort(F.collect_list("line")).alias("lists"))
    names = dense.agg(F.array_sort(F.collect_list(F.struct("class", "name"))).alias("c"))
    quoted = F.array_join(F.transform("c", lambda s: F.concat(F.lit("  "), s["class"].cast("string"), F.lit(": "), F.to_json(F.struct(s["name"].alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(s["name"].alias("v")))) - 6))), "\n")
    config = names.join(F.broadcast(named)).select(F.lit("data.yaml").alias("file"), F.concat(F.lit("path: .\nnames:\n"), quoted, F.lit("\n"), F.array_join("lists", "\n"), F.lit("\n")).alias("content"))  # one row each
    return labels.unionByName(lists.select("file", "content")).unionByName(config)


def read_yolo(files: DataFrame, images: DataFrame, names: DataFrame) -> Dataset:
    """Label files to a dataset.

    ``images`` (path, width, height, split) are the pictures of the tree,
    ``names`` (category_id, name) the classes of data.yaml.  A picture without
    a label file is a negative one and is reported; a file that two pictures
    share belongs to the first.
    """
    first = F.row_number().over(Window.partitionBy("file").orderBy("path"))
    wanted = images.withColumn("file", label_file(F.col("path"))).withColumn("_n", first)
    owned = wanted.where("_n = 1")
    found = owned.join(files, "file", "left")
    lines = found.where("content is not null").select("file", "path", F.posexplode(F.split("content", "\r\n|\r|\n", -1)).alias("pos", "line")).where(F.col("line").rlike(r"(?U)\S"))
    f = F.split(F.regexp_replace("line", r"(?U)^\s+|\s+$", ""), r"(?U)\s+", -1)
    rows = lines.withColumn("f", f).withColumn("category_id", F.get("f", F.lit(0)).try_cast("int"))
    rows = rows.join(names.select("category_id", F.col("name").alias("label")), "category_id", "left").join(images.select("path", F.col("width").alias("_w"), F.col("height").alias("_h")), "path")
    v = [F.get("f", F.lit(i)).try_cast("double") for i in range(1, 5)]
    in_unit = [F.coalesce(c.between(0, 1) & ~F.isnan(c), F.lit(False)) for c in v]
    wrong = (
        F.when(F.size("f") != 5, "five fields expected").when(~F.get("f", F.lit(0)).rlike("^[+-]?[0-9]+$") | F.col("label").isNull(), "unknown class")
        .when(~(in_unit[0] & in_unit[1] & in_unit[2] & in_unit[3] & (v[2] > 0) & (v[3] > 0)), "values outside [0, 1]")
    )
    rows = rows.select("*", F.concat_ws(":", "file", (F.col("pos") + 1).cast("string")).alias("location"), F.format_string("import-%d", F.col("pos") + 1).alias("object_id"), F.col("pos").cast("bigint").alias("ord"), F.lit(None).cast("double").alias("confidence"), F.create_map().cast(_ATTRIBUTES).alias("attributes"))
    objects, issues = take_objects(rows, images, B.from_yolo(v, F.col("_w"), F.col("_h")), wrong)
    missing = _issue(found.where("content is null"), "missing_label_file", F.col("path"), "imported as a picture without objects", "warning")
    shared = _issue(wanted.where("_n > 1"), "ambiguous_label_file", F.col("path"), "another picture has the same label file")
    status = images.select("path", "width", "height", "split", F.lit("imported_coarse").alias("status"))
    return Dataset(status, objects, names, issues.unionByName(missing).unionByName(shared))


# --- XML: VOC and CVAT -----------------------------------------------------------


def xml_text(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def _tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))


def _no_entities(content: Column) -> Column:
    """Documents that declare types or entities are refused before they are parsed."""
    return ~content.rlike(r"(?i)<!\s*(DOCTYPE|ENTITY)")


_VOC = "filename string, size struct<width: int, height: int>, object array<struct<name: string, pose: string, difficult: string, truncated: string, occluded: string, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"


def write_voc(ds: Dataset) -> DataFrame:
    """One XML per picture under a digest of its path, whole one-based pixels, ImageSets per split and train with val."""
    flag = lambda k: _tag(k, F.coalesce(F.element_at("attributes", k), F.lit("0")))
    corners = F.concat(*[_tag(n, c) for n, c in zip(("xmin", "ymin", "xmax", "ymax"), B.to_voc(_box()))])
    item = F.concat(F.lit("<object>"), _tag("name", xml_text(F.col("label"))), _tag("pose", xml_text(F.coalesce(F.element_at("attributes", "pose"), F.lit("Unspecified")))), flag("difficult"), flag("truncated"), flag("occluded"), F.lit("<bndbox>"), corners, F.lit("</bndbox></object>"))
    images = ds.images.withColumn("voc_id", F.concat(F.lit("vr-"), path_key(F.col("path"))))
    size = F.concat(F.lit("<size>"), _tag("width", F.col("width")), _tag("height", F.col("height")), F.lit("<depth>3</depth></size>"))
    body = F.concat(F.lit("<annotation><folder>JPEGImages</folder>"), _tag("filename", F.concat("voc_id", F.lit(".jpg"))), size, F.lit("<segmented>0</segmented>"), F.array_join(_values("o"), ""), F.lit("</annotation>"))
    docs = images.join(_grouped(ds, item, "o"), "path", "left").select(F.concat(F.lit("Annotations/"), "voc_id", F.lit(".xml")).alias("file"), body.alias("content"))
    blocks = blocks_for(ds.images.count(), 100_000)
    sets = images.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(blocks))).withColumn("set", F.explode(F.when(F.col("split").isin("train", "val"), F.array("split", F.lit("trainval"))).otherwise(F.array("split"))))
    suffix = F.when(F.lit(blocks) > 1, F.format_string("-%05d", "part")).otherwise("")
    lists = sets.groupBy("set", "part").agg(F.array_sort(F.collect_list("voc_id")).alias("ids")).select(F.concat(F.lit("ImageSets/Main/"), "set", suffix, F.lit(".txt")).alias("file"), F.concat(F.array_join("ids", "\n"), F.lit("\n")).alias("content"))
    classes = ds.categories.agg(F.array_sort(F.collect_list(F.struct("category_id", "name"))).alias("c")).select(F.lit("classes.txt").alias("file"), F.concat(F.array_join(F.transform("c", lambda s: s["name"]), "\n"), F.lit("\n")).alias("content"))
    return docs.unionByName(lists).unionByName(classes)


def read_voc(files: DataFrame) -> Dataset:
    """VOC trees: Annotations/*.xml, ImageSets/Main and classes.txt.  Paths come back as JPEGImages/<filename>."""
    docs = files.where(F.col("file").rlike("^Annotations/.*[.]xml$"))
    refused = _issue(docs.where(~_no_entities(F.col("content"))), "invalid_xml", F.col("file"), "document type or entity")
    parsed = docs.where(_no_entities(F.col("content"))).withColumn("d", F.from_xml("content", _VOC, {"rowTag": "annotation"}))
    broken = F.col("d.filename").isNull() | F.col("d.size.width").isNull() | F.col("d.size.height").isNull()
    invalid = _issue(parsed.where(broken), "invalid_xml", F.col("file"), "no file name or size")
    lists = files.where(F.col("file").rlike("^ImageSets/Main/(train|val|test|unspecified)(-[0-9]+)?[.]txt$"))
    entries = lists.select(F.regexp_extract("file", "([a-z]+)(-[0-9]+)?[.]txt$", 1).alias("split"), F.explode(F.split("content", r"\s*\n\s*", -1)).alias("id")).where("id <> ''")
    split = entries.groupBy("id").agg(F.min("split").alias("split"))
    found = parsed.where(~broken).withColumn("id", F.regexp_extract("file", "^Annotations/(.*)[.]xml$", 1)).withColumn("path", F.concat(F.lit("JPEGImages/"), F.col("d.filename")))
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("file")))
    twice = _issue(found.where("_n > 1"), "invalid_xml", F.col("file"), "several documents for one picture")
    taken = found.where("_n = 1").join(split, "id", "left")
    images = taken.select("path", F.col("d.size.width").alias("width"), F.col("d.size.height").alias("height"), F.coalesce("split", F.lit("unspecified")).alias("split"), F.lit("imported_coarse").alias("status"))
    rows = taken.select("file", "path", F.posexplode("d.object").alias("pos", "o"))
    flags = ["difficult", "truncated", "occluded"]
    value = {k: F.coalesce(F.col(f"o.{k}"), F.lit("0")) for k in flags}
    attributes = F.create_map(*[c for k in flags for c in (F.lit(k), value[k])], F.lit("pose"), F.coalesce("o.pose", F.lit("Unspecified")))
    rows = rows.select("file", "path", "o", F.trim("o.name").alias("label"), F.col("pos").cast("bigint").alias("ord"), F.format_string("voc-%d", "pos").alias("object_id"), F.concat_ws(":", "file", F.col("pos").cast("string")).alias("location"), F.lit(None).cast("double").alias("confidence"), attributes.alias("attributes"))
    bad_flag = ~(value["difficult"].isin("0", "1") & value["truncated"].isin("0", "1") & value["occluded"].isin("0", "1"))
    wrong = F.when(F.coalesce(F.length("label"), F.lit(0)) == 0, "empty class name").when(F.col("o.bndbox").isNull(), "no box").when(bad_flag, "flags must be 0 or 1")
    box = [F.col(f"o.bndbox.{k}") for k in ("xmin", "ymin", "xmax", "ymax")]
    objects, issues = take_objects(rows, images, B.from_voc(box), wrong)
    lines = files.where("file = 'classes.txt'").select(F.posexplode(F.split("content", "\r?\n", -1)).alias("pos", "name")).select(F.trim("name").alias("name"), F.format_string("0/%09d", "pos").alias("ord"))
    seen = rows.where("label <> ''").select(F.col("label").alias("name"), F.concat(F.lit("1/"), "location").alias("ord"))
    classes = merge_categories(lines.unionByName(seen).where("name <> ''").groupBy("name").agg(F.min("ord").alias("ord")).withColumn("source_id", F.lit(0)))
    return Dataset(images, objects, classes.select("category_id", "name"), issues.unionByName(invalid).unionByName(refused).unionByName(twice))


_CVAT = (
    "version string, meta struct<task: struct<mode: string, labels: struct<label: array<struct<name: string>>>>>, track array<string>, "
    "image array<struct<_id: string, _name: string, _width: int, _height: int, box: array<struct<_label: string, _occluded: string, _rotation: double, _xtl: double, _ytl: double, _xbr: double, _ybr: double, _z_order: string, "
    "attribute: array<struct<_name: string, _VALUE: string>>>>, polygon: array<string>, points: array<string>>>"
)


def write_cvat(ds: Dataset, per_file: int = PER_FILE) -> DataFrame:
    """annotations-<n>.xml (CVAT 1.1): classes with their attribute names, pictures with their boxes."""
    keys = ds.objects.select("label", F.explode(F.map_keys("attributes")).alias("k")).where("k not in ('occluded', 'z_order')").groupBy("label").agg(F.array_sort(F.collect_set("k")).alias("keys"))
    attribute = lambda k: F.concat(F.lit("<attribute>"), _tag("name", xml_text(k)), F.lit("<mutable>False</mutable><input_type>text</input_type><default_value></default_value><values></values></attribute>"))
    listed = ds.categories.join(keys.withColumnRenamed("label", "name"), "name", "left").select("category_id", F.concat(F.lit("<label>"), _tag("name", xml_text(F.col("name"))), F.lit("<attributes>"), F.array_join(F.transform(F.coalesce("keys", F.array().cast("array<string>")), attribute), ""), F.lit("</attributes></label>")).alias("x"))
    labels = listed.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category_id", "x"))), lambda s: s["x"]), "").alias("labels"))
    own = F.map_filter(F.coalesce("attributes", F.create_map().cast(_ATTRIBUTES)), lambda k, v: ~k.isin("occluded", "z_order"))
    inner = F.array_join(F.transform(F.map_entries(own), lambda e: F.concat(F.lit('<attribute name="'), xml_text(e["key"]), F.lit('">'), xml_text(e["value"]), F.lit("</attribute>"))), "")
    get = lambda k: F.coalesce(F.element_at("attributes", k), F.lit("0"))
    with_status = Dataset(ds.images, ds.objects.join(ds.images.select("path", "status"), "path"), ds.categories)
    source = F.when(F.col("status").isin(HUMAN), "manual").otherwise("auto")
    corner = F.concat(*[F.concat(F.lit(f'" {n}="'), F.col(c).cast("string")) for n, c in zip(("xtl", "ytl", "xbr", "ybr"), _BOX)])
    box = F.concat(F.lit('<box label="'), xml_text(F.col("label")), F.lit('" occluded="'), get("occluded"), F.lit('" source="'), source, corner, F.lit('" z_order="'), get("z_order"), F.lit('">'), inner, F.lit("</box>"))
    images = _sharded(ds, per_file).join(_grouped(with_status, box, "o"), "path", "left")
    element = F.concat(F.lit('<image id="'), (F.col("number") - 1).cast("string"), F.lit('" name="'), xml_text(F.col("path")), F.lit('" width="'), F.col("width").cast("string"), F.lit('" height="'), F.col("height").cast("string"), F.lit('">'), F.array_join(_values("o"), ""), F.lit("</image>"))
    body = images.select("shard", "number", element.alias("x")).groupBy("shard").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "x"))), lambda s: s["x"]), "").alias("images"))
    whole = F.concat(F.lit("<annotations><version>1.1</version><meta><task><id>0</id><name>export</name><mode>annotation</mode><labels>"), "labels", F.lit("</labels></task></meta>"), "images", F.lit("</annotations>"))
    return body.join(F.broadcast(labels)).select(F.format_string("annotations-%05d.xml", "shard").alias("file"), whole.alias("content"))  # one row


def read_cvat(files: DataFrame, split: str = "unspecified") -> Dataset:
    """CVAT image documents; tracks, turned boxes and other shapes are reported, not read."""
    docs = files.where(F.col("file").endswith(".xml"))
    parsed = docs.where(_no_entities(F.col("content"))).withColumn("d", F.from_xml("content", _CVAT, {"rowTag": "annotations", "attributePrefix": "_", "valueTag": "_VALUE"}))
    usable = F.col("d.version").isin("1.0", "1.1") & F.col("d.track").isNull() & (F.coalesce("d.meta.task.mode", F.lit("annotation")) == "annotation")
    usable = F.coalesce(usable, F.lit(False))
    refused = _issue(docs.where(~_no_entities(F.col("content"))), "invalid_xml", F.col("file"), "document type or entity").unionByName(_issue(parsed.where(~usable), "unsupported_document", F.col("file"), "version or video tracks"))
    good = parsed.where(usable)
    pictures = good.select("file", F.posexplode("d.image").alias("pos", "i"))
    pictures = pictures.withColumn("path", F.col("i._name")).withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("file", "pos")))
    fault = F.when(~F.coalesce(portable_path(F.col("path")), F.lit(False)), "path is not portable").when(F.col("_n") > 1, "picture comes twice").when(~F.coalesce((F.col("i._width") > 0) & (F.col("i._height") > 0), F.lit(False)), "no size")
    pictures = pictures.withColumn("fault", fault)
    images = pictures.where("fault is null").select("path", F.col("i._width").alias("width"), F.col("i._height").alias("height"), F.lit(split).alias("split"), F.lit("imported_coarse").alias("status"))
    other = _issue(pictures.where("fault is null and (i.polygon is not null or i.points is not null)"), "invalid_annotation", F.col("path"), "only axis-aligned boxes are read")
    rows = pictures.where("fault is null").select("file", "path", F.posexplode("i.box").alias("pos", "b"))
    pairs = F.transform(F.coalesce("b.attribute", F.array().cast("array<struct<_name: string, _VALUE: string>>")), lambda a: F.struct(a["_name"].alias("key"), F.coalesce(a["_VALUE"], F.lit("")).alias("value")))
    flags = F.create_map(F.lit("occluded"), F.coalesce("b._occluded", F.lit("0")), F.lit("z_order"), F.coalesce("b._z_order", F.lit("0")))
    rows = rows.select("file", "path", "b", F.col("b._label").alias("label"), F.col("pos").cast("bigint").alias("ord"), F.format_string("import-%d", "pos").alias("object_id"), F.format_string("%s:%d", "path", "pos").alias("location"), F.lit(None).cast("double").alias("confidence"), F.map_concat(flags, F.map_from_entries(pairs)).alias("attributes"))
    wrong = F.when(F.coalesce("b._rotation", F.lit(0.0)) != 0, "only axis-aligned boxes are read").when(F.coalesce(F.length(F.trim("label")), F.lit(0)) == 0, "empty class name").when(~F.element_at("attributes", "occluded").isin("0", "1"), "occluded must be 0 or 1")
    objects, issues = take_objects(rows, images, [F.col(f"b.{k}") for k in ("_xtl", "_ytl", "_xbr", "_ybr")], wrong)
    listed = good.select(F.posexplode("d.meta.task.labels.label").alias("pos", "l")).select(F.trim("l.name").alias("name"), F.format_string("0/%09d", "pos").alias("ord"))
    seen = rows.where("label is not null").select(F.trim("label").alias("name"), F.concat(F.lit("1/"), "location").alias("ord"))
    classes = merge_categories(listed.unionByName(seen).where("name <> ''").groupBy("name").agg(F.min("ord").alias("ord")).withColumn("source_id", F.lit(0)))
    return Dataset(images, objects, classes.select("category_id", "name"), issues.unionByName(refused).unionByName(other).unionByName(_issue(pictures.where("fault is not null"), "invalid_image", F.col("path"), F.col("fault"))))


# --- Labelme and Label Studio ------------------------------------------------------

_LABELME = "imagePath string, imageWidth int, imageHeight int, shapes array<struct<label: string, points: array<array<double>>, shape_type: string, flags: string, group_id: string, description: string>>"


def write_labelme(ds: Dataset) -> DataFrame:
    """One JSON per picture under a digest of its path, rectangles of two corners, and classes.json."""
    attribute = lambda k: F.element_at("attributes", k)
    item = F.struct(
        "label", F.array(F.array("x1", "y1"), F.array("x2", "y2")).alias("points"), F.lit("rectangle").alias("shape_type"),
        F.coalesce(F.from_json(attribute("flags"), "map<string,boolean>"), F.create_map().cast("map<string,boolean>")).alias("flags"), attribute("group_id").try_cast("int").alias("group_id"), F.coalesce(attribute("description"), F.lit("")).alias("description"),
    )
    stem, end = path_key(F.col("path")), F.lower(F.regexp_extract("path", r"([.][^./]+)$", 1))
    images = ds.images.join(_grouped(ds, F.to_json(item), "o"), "path", "left")  # as text: maps have no order to sort by
    shapes = F.concat(F.lit("["), F.array_join(_values("o"), ","), F.lit("]"))
    body = F.concat(F.lit('{"version":"5.5.0","flags":{},"imageData":null,"imagePath":'), F.to_json(F.array(F.concat(stem, end))).substr(F.lit(2), F.length(F.concat(stem, end)) + 2), F.lit(',"imageWidth":'), F.col("width").cast("string"), F.lit(',"imageHeight":'), F.col("height").cast("string"), F.lit(',"shapes":'), shapes, F.lit("}"))
    docs = images.select(F.concat(F.lit("images/"), stem, F.lit(".json")).alias("file"), body.alias("content"))
    classes = ds.categories.agg(F.array_sort(F.collect_list(F.struct("category_id", "name"))).alias("c")).select(F.lit("classes.json").alias("file"), F.to_json(F.transform("c", lambda s: s["name"])).alias("content"))
    return docs.unionByName(classes)


def _seeded(files: DataFrame, seen: DataFrame) -> DataFrame:
    listed = files.where("file = 'classes.json'").select(F.posexplode(F.from_json("content", "array<string>")).alias("pos", "name")).select(F.trim("name").alias("name"), F.format_string("0/%09d", "pos").alias("ord"))
    both = listed.unionByName(seen.select(F.trim("label").alias("name"), F.concat(F.lit("1/"), "location").alias("ord"))).where("name <> ''")
    return merge_categories(both.groupBy("name").agg(F.min("ord").alias("ord")).withColumn("source_id", F.lit(0))).select("category_id", "name")


def read_labelme(files: DataFrame, split: str = "unspecified") -> Dataset:
    """Labelme documents; the picture is named beside its document.  Only rectangles of two points, in any order."""
    docs = files.where(F.col("file").endswith(".json") & ~F.col("file").rlike("(^|/)(classes|export-report|dataset)[.]json$")).withColumn("d", F.from_json("content", _LABELME))
    name = F.col("d.imagePath")
    local = F.coalesce(portable_path(name) & F.col("d.shapes").isNotNull() & (F.col("d.imageWidth") > 0) & (F.col("d.imageHeight") > 0), F.lit(False))
    found = docs.withColumn("path", F.concat(F.regexp_extract("file", "^(.*/)?[^/]*$", 1), name)).withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("file")))
    good = found.where(local & (F.col("_n") == 1))
    images = good.select("path", F.col("d.imageWidth").alias("width"), F.col("d.imageHeight").alias("height"), F.lit(split).alias("split"), F.lit("imported_coarse").alias("status"))
    rows = good.select("file", "path", F.posexplode("d.shapes").alias("pos", "s"))
    rows = rows.select("file", "path", "s", F.col("s.label").alias("label"), F.col("pos").cast("bigint").alias("ord"), F.format_string("import-%d", "pos").alias("object_id"), F.format_string("%s:%d", "path", "pos").alias("location"), F.lit(None).cast("double").alias("confidence"),
                       F.map_filter(F.create_map(F.lit("flags"), F.col("s.flags"), F.lit("group_id"), F.col("s.group_id"), F.lit("description"), F.col("s.description")), lambda k, v: v.isNotNull()).alias("attributes"))
    p = lambda i, j: F.get(F.get("s.points", F.lit(i)), F.lit(j))
    missing = p(0, 0).isNull() | p(0, 1).isNull() | p(1, 0).isNull() | p(1, 1).isNull()
    wrong = F.when((F.col("s.shape_type") != "rectangle") | (F.size("s.points") != 2) | missing, "only rectangles of two points are read").when(F.coalesce(F.length(F.trim("label")), F.lit(0)) == 0, "empty class name")
    box = [F.least(p(0, 0), p(1, 0)), F.least(p(0, 1), p(1, 1)), F.greatest(p(0, 0), p(1, 0)), F.greatest(p(0, 1), p(1, 1))]
    objects, issues = take_objects(rows, images, box, wrong)
    return Dataset(images, objects, _seeded(files, rows), issues.unionByName(_issue(found.where(~local | (F.col("_n") > 1)), "invalid_labelme", F.col("file"), "no shapes, no size, no local picture or a second document")))


_RESULT = "array<struct<id: string, type: string, image_rotation: double, original_width: int, original_height: int, value: struct<x: double, y: double, width: double, height: double, rotation: double, rectanglelabels: array<string>>>>"
_STUDIO = f"array<struct<id: bigint, data: struct<image: string>, annotations: array<struct<was_cancelled: boolean, result: {_RESULT}>>, predictions: array<struct<result: {_RESULT}>>>>"


def write_label_studio(ds: Dataset, per_file: int = PER_FILE) -> DataFrame:
    """annotations-<n>.json of tasks: reviewed pictures as annotations, others as predictions; boxes in percent; classes.json and the label view."""
    sized = Dataset(ds.images, ds.objects.join(ds.images.select("path", "width", "height"), "path"), ds.categories)
    x, y, w, h = B.to_percent(_box(), F.col("width"), F.col("height"))
    item = F.struct(
        F.concat(F.lit("box-"), F.col("ord").cast("string")).alias("id"), F.lit("label").alias("from_name"), F.lit("image").alias("to_name"), F.lit("rectanglelabels").alias("type"), F.col("width").alias("original_width"), F.col("height").alias("original_height"), F.lit(0).alias("image_rotation"),
        F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"), F.lit(0).alias("rotation"), F.array("label").alias("rectanglelabels")).alias("value"),
    )
    images = _sharded(ds, per_file).join(_grouped(sized, item, "o"), "path", "left")
    number = F.col("shard").cast("bigint") * (1 << 24) + F.col("number")
    result = F.when(F.col("o").isNull(), F.lit("[]")).otherwise(F.to_json(F.transform("o", lambda s: s["v"])))
    version = F.when(F.col("status").isin(HUMAN), F.concat(F.lit('"annotations":[{"id":'), number.cast("string"), F.lit(',"was_cancelled":false,"ground_truth":false,"result":'), result, F.lit("}]"))).otherwise(F.concat(F.lit('"predictions":[{"model_version":"imported","result":'), result, F.lit("}]")))
    reference = F.concat(F.lit("/data/local-files/?d="), quote_path(F.concat(F.lit("images/"), "path")))
    task = F.concat(F.lit('{"id":'), number.cast("string"), F.lit(',"data":'), F.to_json(F.struct(reference.alias("image"))), F.lit(","), version, F.lit("}"))
    bodies = images.select("shard", "number", task.alias("t")).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("number", "t"))).alias("t"))
    docs = bodies.select(F.format_string("annotations-%05d.json", "shard").alias("file"), F.concat(F.lit("["), F.array_join(F.transform("t", lambda s: s["t"]), ","), F.lit("]")).alias("content"))
    c = ds.categories.agg(F.transform(F.array_sort(F.collect_list(F.struct("category_id", "name"))), lambda s: s["name"]).alias("c"))
    classes = c.select(F.lit("classes.json").alias("file"), F.to_json("c").alias("content"))
    view = F.concat(F.lit('<View><Image name="image" value="$image" /><RectangleLabels name="label" toName="image">'), F.array_join(F.transform("c", lambda n: F.concat(F.lit('<Label value="'), xml_text(n), F.lit('" />'))), ""), F.lit("</RectangleLabels></View>"))
    return docs.unionByName(classes).unionByName(c.select(F.lit("label_config.xml").alias("file"), view.alias("content")))


def read_label_studio(files: DataFrame, split: str = "unspecified", sizes: DataFrame | None = None) -> Dataset:
    """Task arrays: exactly one version that was not cancelled, else one prediction; upright rectangles of one class.

    The size of a picture comes from ``sizes`` (path, width, height), else from
    its results; a picture without either is reported.
    """
    docs = files.where(F.col("file").endswith(".json") & ~F.col("file").rlike("(^|/)(classes|export-report|dataset)[.]json$"))
    tasks = docs.select("file", F.posexplode(F.from_json("content", _STUDIO)).alias("pos", "t"))
    none = F.array().cast(f"array<struct<result: {_RESULT}>>")
    human = F.coalesce(F.transform(F.filter("t.annotations", lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False))), lambda a: F.struct(a["result"].alias("result"))), none)
    model = F.coalesce(F.col("t.predictions"), none)
    tasks = tasks.withColumn("path", local_file_reference(F.col("t.data.image"))).withColumn("versions", F.when(F.size(human) > 0, human).otherwise(model)).withColumn("origin", F.when(F.size(human) > 0, "annotation").when(F.size(model) > 0, "prediction").otherwise("unlabeled"))
    tasks = tasks.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("file", "pos")))
    stated = F.element_at(F.filter(F.get("versions", F.lit(0))["result"], lambda r: r["original_width"].isNotNull() & r["original_height"].isNotNull()), 1)
    tasks = tasks.withColumn("_s", F.when(F.size(F.get("versions", F.lit(0))["result"]) > 0, stated))
    if sizes is not None:
        tasks = tasks.join(sizes.select("path", F.col("width").alias("_w"), F.col("height").alias("_h")), "path", "left")
    else:
        tasks = tasks.withColumn("_w", F.lit(None).cast("int")).withColumn("_h", F.lit(None).cast("int"))
    tasks = tasks.withColumn("width", F.coalesce("_w", "_s.original_width")).withColumn("height", F.coalesce("_h", "_s.original_height"))
    fault = F.when(~F.coalesce(portable_path(F.col("path")), F.lit(False)), "no local picture").when(F.size("versions") > 1, "several versions").when(F.col("_n") > 1, "picture comes twice").when(F.col("width").isNull() | F.col("height").isNull(), "no size")
    tasks = tasks.withColumn("fault", fault)
    good = tasks.where("fault is null")
    images = good.select("path", "width", "height", F.lit(split).alias("split"), F.when(F.col("origin") == "unlabeled", "unreviewed").otherwise("imported_coarse").alias("status"))
    rows = good.select("file", "path", "width", "height", "origin", F.posexplode(F.get("versions", F.lit(0))["result"]).alias("pos", "r"))
    v = F.col("r.value")
    rows = rows.select("file", "path", "r", F.col("width").alias("_iw"), F.col("height").alias("_ih"), F.get(v["rectanglelabels"], F.lit(0)).alias("label"), F.col("pos").cast("bigint").alias("ord"), F.format_string("import-%d", "pos").alias("object_id"), F.format_string("%s:%d", "path", "pos").alias("location"), F.lit(None).cast("double").alias("confidence"), F.create_map(F.lit("label_studio_origin"), F.col("origin")).alias("attributes"))
    turned = (F.coalesce(v["rotation"], F.lit(0.0)) != 0) | (F.coalesce(F.col("r.image_rotation"), F.lit(0.0)) != 0)
    wrong = F.when((F.col("r.type") != "rectanglelabels") | turned, "only upright rectangles are read").when(F.size(v["rectanglelabels"]) != 1, "a box has exactly one class")
    objects, issues = take_objects(rows, images, B.from_percent([v["x"], v["y"], v["width"], v["height"]], F.col("_iw"), F.col("_ih")), wrong)
    return Dataset(images, objects, _seeded(files, rows), issues.unionByName(_issue(tasks.where("fault is not null"), "invalid_label_studio_task", F.col("t.id"), F.col("fault"))))


# --- native snapshot -------------------------------------------------------------

_NATIVE = "path string, width int, height int, split string, status string, objects array<struct<object_id: string, ord: bigint, label: string, bbox: array<double>, confidence: double, attributes: map<string,string>>>"


def write_native(ds: Dataset, per_file: int = PER_FILE) -> DataFrame:
    """pictures-<n>.jsonl with one picture and its objects per line, and categories.json."""
    item = F.struct("object_id", "ord", "label", F.array(*_BOX).alias("bbox"), "confidence", "attributes")
    images = _sharded(ds, per_file).join(_grouped(ds, F.to_json(item), "o"), "path", "left")  # as text: maps have no order to sort by
    head = F.to_json(F.struct("path", "width", "height", "split", "status"))
    line = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"objects":['), F.array_join(_values("o"), ","), F.lit("]}"))
    docs = images.select("shard", "number", line.alias("l")).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("number", "l"))).alias("l"))
    docs = docs.select(F.format_string("pictures-%05d.jsonl", "shard").alias("file"), F.array_join(F.transform("l", lambda s: s["l"]), "\n").alias("content"))
    classes = ds.categories.agg(F.to_json(F.array_sort(F.collect_list(F.struct("category_id", "name")))).alias("content")).select(F.lit("categories.json").alias("file"), "content")
    return docs.unionByName(classes)


def read_native(files: DataFrame, trust_reviewed: bool = False, actual: DataFrame | None = None) -> Dataset:
    """A native snapshot; unless it is trusted, every reviewed state falls to imported_coarse.

    ``actual`` (path, width, height) is the listing of the pictures at hand;
    with it, pictures that are missing or changed their size are reported and
    left out.
    """
    lines = files.where(F.col("file").endswith(".jsonl")).select("file", F.explode(F.split("content", "\n", -1)).alias("l")).where("l <> ''").withColumn("d", F.from_json("l", _NATIVE))
    rows = lines.select("file", "d.*").withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("file")))
    fault = F.when(~F.coalesce(portable_path(F.col("path")), F.lit(False)), "path is not portable").when(F.col("_n") > 1, "picture comes twice")
    if actual is not None:
        rows = rows.join(actual.select("path", F.col("width").alias("_w"), F.col("height").alias("_h")), "path", "left")
        fault = fault.when(~F.coalesce((F.col("_w") == F.col("width")) & (F.col("_h") == F.col("height")), F.lit(False)), "picture missing or changed")
    rows = rows.withColumn("fault", fault)
    good = rows.where("fault is null")
    status = F.col("status") if trust_reviewed else F.when(F.col("status") == "unreviewed", "unreviewed").otherwise("imported_coarse")
    images = good.select("path", "width", "height", "split", status.alias("status"))
    objects = good.select("path", F.explode("objects").alias("o")).select("path", "o.object_id", "o.ord", "o.label", *[F.col("o.bbox")[i].alias(c) for i, c in enumerate(_BOX)], "o.confidence", "o.attributes")
    categories = files.where("file = 'categories.json'").select(F.explode(F.from_json("content", "array<struct<category_id: int, name: string>>")).alias("c")).select("c.*")
    return Dataset(images, objects, categories, _issue(rows.where("fault is not null"), "invalid_image", F.col("path"), F.col("fault")))


# Format names, with their reader and writer.
REGISTRY = {
    "coco_detection": (read_coco, write_coco),
    "yolo_detection": (read_yolo, write_yolo),
    "voc_detection": (read_voc, write_voc),
    "cvat_detection": (read_cvat, write_cvat),
    "labelme_detection": (read_labelme, write_labelme),
    "label_studio_detection": (read_label_studio, write_label_studio),
    "native": (read_native, write_native),
}
