"""Every format written and read again over all pictures and all boxes, with what cannot be written.

Pictures that share a path are one picture, the first; the boxes of all of
them are its boxes.  A result has a row per box read back, a row per picture
read back (also without boxes) with its split, and a row with a code per box
that was not written.  Polygons and masks have formats of their own
(``read_coco_shapes``), which are in no query here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelore.functions.text import path_key, portable_path
from framelore.sources import formats
from framelore.sources.dataset import Dataset
from framelore.tables import stage, table

_CORNERS = ("x1", "y1", "x2", "y2")


def _dataset(spark: SparkSession, d: str) -> tuple[Dataset, DataFrame]:
    """Pictures with a portable path and a size, their sound boxes with a catalog label, and all other boxes with the reason."""
    images = table(spark, d, "images").select("image_key", "path", "width", "height", "split", "status")
    usable = images.where(portable_path(F.col("path")) & (F.col("width") > 0) & (F.col("height") > 0))
    first = usable.groupBy("path").agg(F.min(F.struct("image_key", "width", "height", "split", "status")).alias("i")).select("path", "i.*")
    names = table(spark, d, "label_catalog").select("category_id", F.col("category_name").alias("name"))
    b = [F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(_CORNERS)]
    boxes = table(spark, d, "annotations").select("ann_key", "image_key", "label", "confidence", F.size("bbox").alias("values"), *b)
    placed = boxes.join(images.select("image_key", "path"), "image_key", "left").join(first.select("path", "width", "height"), "path", "left")
    labelled = placed.join(names.select(F.col("name").alias("label"), F.lit(True).alias("known")), "label", "left")
    code = (
        F.when(F.col("path").isNull(), "no_picture").when(F.col("width").isNull(), "picture_left_out").when(F.coalesce("values", F.lit(-1)) != 4, "not_four_values")
        .when(~F.coalesce((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False)), "reversed_or_empty")
        .when((F.col("x1") < 0) | (F.col("y1") < 0) | (F.col("x2") > F.col("width")) | (F.col("y2") > F.col("height")), "outside_image").when(F.col("known").isNull(), "unknown_label")
    )
    judged = stage(labelled.withColumn("code", code), "exchange-boxes")
    objects = judged.where("code is null").select("path", F.col("ann_key").cast("string").alias("object_id"), F.col("ann_key").alias("ord"), "label", *_CORNERS, "confidence", F.create_map(F.lit("iscrowd"), F.lit("0")).alias("attributes"))
    split = F.when(F.col("split").isin("train", "val", "test"), F.col("split")).otherwise("unspecified")
    pictures = stage(first.select("path", "width", "height", split.alias("split"), F.coalesce("status", F.lit("unreviewed")).alias("status")), "exchange-pictures")
    return Dataset(pictures, objects, names), judged.where("code is not null").select("path", "label", "code")


def _out(found: Dataset, rejects: DataFrame, back: DataFrame | None = None) -> DataFrame:
    """path, kind (box, picture, reject), label, corners, split, code; ``back`` (path, original) undoes a format's own file names."""
    old = (lambda df: df) if back is None else (lambda df: df.join(back, "path").drop("path").withColumnRenamed("original", "path"))
    null = lambda kind: F.lit(None).cast(kind)
    names = ["path", "kind", "label", *_CORNERS, "split", "code"]
    boxes = old(found.objects.select("path", "label", *_CORNERS)).select("path", F.lit("box").alias("kind"), "label", *[F.round(c, 5).alias(c) for c in _CORNERS], null("string").alias("split"), null("string").alias("code"))
    pictures = old(found.images.select("path", "split")).select("path", F.lit("picture").alias("kind"), null("string").alias("label"), *[null("double").alias(c) for c in _CORNERS], "split", null("string").alias("code"))
    left = rejects.select("path", F.lit("reject").alias("kind"), "label", *[null("double").alias(c) for c in _CORNERS], null("string").alias("split"), "code")
    return boxes.select(names).unionByName(pictures.select(names)).unionByName(left.select(names))


def format_coco(spark, d):
    ds, rejects = _dataset(spark, d)
    return _out(formats.read_coco(formats.write_coco(ds)), rejects)


def format_yolo(spark, d):
    ds, rejects = _dataset(spark, d)
    files, placed = formats.write_yolo(ds), formats.yolo_paths(ds.images)
    images = placed.select(F.col("image_file").alias("path"), "width", "height", F.col("yolo_split").alias("split"))
    return _out(formats.read_yolo(files, images, ds.categories), rejects, placed.select(F.col("image_file").alias("path"), F.col("path").alias("original")))


def format_voc(spark, d):
    ds, rejects = _dataset(spark, d)
    back = ds.images.select(F.concat(F.lit("JPEGImages/vr-"), path_key(F.col("path")), F.lit(".jpg")).alias("_p"), F.col("path").alias("original"))
    return _out(formats.read_voc(formats.write_voc(ds)), rejects, back.withColumnRenamed("_p", "path"))


def format_cvat(spark, d):
    ds, rejects = _dataset(spark, d)
    return _out(formats.read_cvat(formats.write_cvat(ds)), rejects)


def format_labelme(spark, d):
    ds, rejects = _dataset(spark, d)
    back = ds.images.select(F.concat(F.lit("images/"), path_key(F.col("path")), F.lower(F.regexp_extract("path", r"([.][^./]+)$", 1))).alias("_p"), F.col("path").alias("original"))
    return _out(formats.read_labelme(formats.write_labelme(ds)), rejects, back.withColumnRenamed("_p", "path"))


def format_label_studio(spark, d):
    ds, rejects = _dataset(spark, d)
    back = ds.images.select(F.concat(F.lit("images/"), "path").alias("_p"), F.col("path").alias("original"))
    sizes = ds.images.select(F.concat(F.lit("images/"), "path").alias("path"), "width", "height")  # tasks without a box state no size
    return _out(formats.read_label_studio(formats.write_label_studio(ds), sizes=sizes), rejects, back.withColumnRenamed("_p", "path"))


def format_native(spark, d):
    ds, rejects = _dataset(spark, d)
    return _out(formats.read_native(formats.write_native(ds)), rejects)


_SQL = r"""with u as (select * from images where width > 0 and height > 0 and path = trim(path) and not regexp_matches(path, '[\\:\x00-\x1f]|^\s|\s$|^\x{A0}|\x{A0}$') and not starts_with(path, '/') and not list_contains(string_split(path, '/'), '..')),
p as (select path, arg_min(image_key, image_key) as image_key, arg_min(width, image_key) as width, arg_min(height, image_key) as height, min_by(coalesce(split, 'unspecified'), image_key) as split from u group by 1),
j as (select a.label, a.bbox as b, i.path, p.width as w, p.height as h from annotations a left join images i on a.image_key = i.image_key left join p on i.path = p.path),
c as (select *, case when path is null then 'no_picture' when w is null then 'picture_left_out' when coalesce(len(b), -1) <> 4 then 'not_four_values' when not coalesce(b[3] > b[1] and b[4] > b[2], false) then 'reversed_or_empty'
  when b[1] < 0 or b[2] < 0 or b[3] > w or b[4] > h then 'outside_image' when label is null or label not in (select category_name from label_catalog) then 'unknown_label' end as code from j)
select path, 'box' as kind, label, BOX, null::varchar as split, null::varchar as code from c where code is null
union all select path, 'picture', null, null, null, null, null, SPLIT, null from p
union all select path, 'reject', label, null, null, null, null, null, code from c where code is not null"""


def _twin(box: list[str], split: str) -> str:
    corners = ", ".join(f"{v} as {c}" for v, c in zip(box, _CORNERS))
    return _SQL.replace("BOX", corners).replace("SPLIT", split)


_SAME = [f"round(b[{i + 1}], 5)" for i in range(4)]
_WIDENED = ["floor(b[1])", "floor(b[2])", "ceil(b[3])", "ceil(b[4])"]
_KEPT = "case when split in ('train', 'val', 'test') then split else 'unspecified' end"
_TRAIN = "case when split in ('train', 'val', 'test') then split else 'train' end"
# What a format keeps of the split.
_SPLITS = {"coco": _KEPT, "yolo": _TRAIN, "voc": _KEPT, "cvat": "'unspecified'", "labelme": "'unspecified'", "label_studio": "'unspecified'", "native": _KEPT}
ORACLES = {f"format_{n}": _twin(_WIDENED if n == "voc" else _SAME, split) for n, split in _SPLITS.items()}
QUERIES = {n: globals()[n] for n in ORACLES}
