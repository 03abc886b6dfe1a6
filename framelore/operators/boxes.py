"""Boxes: cleaning, conversions between formats, overlap and suppression."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelore.functions.geometry import box_iou


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def box_columns(bbox: Column) -> list[Column]:
    return [F.get(bbox, F.lit(i)) for i in range(4)]


def clean_box(box: list[Column], count: Column, width: Column, height: Column) -> dict[str, Column]:
    """Import rule: four finite values, a positive area before clipping to the picture and after.

    ``code`` is null for a good box, clipped_bbox where it was cut, else the
    reason to leave it out.  Nulls are tested before any clip, since least and
    greatest pass over them.
    """
    x1, y1, x2, y2 = box
    cut = [F.greatest(F.lit(0.0), F.least(v, m.cast("double"))) for v, m in zip(box, (width, height, width, height))]
    bad = F.when(F.coalesce(count, F.lit(0)) != 4, "not_four_values").when(~(finite(x1) & finite(y1) & finite(x2) & finite(y2)), "not_finite").when((x2 <= x1) | (y2 <= y1), "reversed_or_empty").when(width.isNull() | height.isNull(), "no_size")
    bad = bad.when((cut[2] <= cut[0]) | (cut[3] <= cut[1]), "outside_image")
    changed = (cut[0] != x1) | (cut[1] != y1) | (cut[2] != x2) | (cut[3] != y2)
    out = {f: F.when(bad.isNull(), c) for f, c in zip(("x1", "y1", "x2", "y2"), cut)}
    return out | {"code": F.coalesce(bad, F.when(changed, "clipped_bbox"))}


def saved_box(box: list[Column], width: Column, height: Column) -> list[Column]:
    """Human-save rule: clamp into the picture, then put the corners in order; null where nothing is left."""
    known = width.isNotNull() & height.isNotNull() & finite(box[0]) & finite(box[1]) & finite(box[2]) & finite(box[3])
    x = [F.greatest(F.lit(0.0), F.least(box[i], width.cast("double"))) for i in (0, 2)]
    y = [F.greatest(F.lit(0.0), F.least(box[i], height.cast("double"))) for i in (1, 3)]
    out = [F.least(*x), F.least(*y), F.greatest(*x), F.greatest(*y)]
    good = known & (out[2] > out[0]) & (out[3] > out[1])
    return [F.when(good, c) for c in out]


# Conversions of a pixel-edge box to what each format stores, and back.


def to_coco(b: list[Column]) -> list[Column]:
    return [b[0], b[1], b[2] - b[0], b[3] - b[1]]


def from_coco(b: list[Column]) -> list[Column]:
    return [b[0], b[1], b[0] + b[2], b[1] + b[3]]


def to_yolo(b: list[Column], w: Column, h: Column) -> list[Column]:
    return [(b[0] + b[2]) / 2 / w, (b[1] + b[3]) / 2 / h, (b[2] - b[0]) / w, (b[3] - b[1]) / h]


def from_yolo(b: list[Column], w: Column, h: Column) -> list[Column]:
    return [(b[0] - b[2] / 2) * w, (b[1] - b[3] / 2) * h, (b[0] + b[2] / 2) * w, (b[1] + b[3] / 2) * h]


def to_voc(b: list[Column]) -> list[Column]:
    """One-based inclusive whole pixels, widened outwards."""
    return [(F.floor(b[0]) + 1).cast("int"), (F.floor(b[1]) + 1).cast("int"), F.ceil(b[2]).cast("int"), F.ceil(b[3]).cast("int")]


def from_voc(b: list[Column]) -> list[Column]:
    return [b[0] - 1.0, b[1] - 1.0, b[2] + 0.0, b[3] + 0.0]


def to_percent(b: list[Column], w: Column, h: Column) -> list[Column]:
    return [b[0] / w * 100, b[1] / h * 100, (b[2] - b[0]) / w * 100, (b[3] - b[1]) / h * 100]


def from_percent(b: list[Column], w: Column, h: Column) -> list[Column]:
    return [b[0] / 100 * w, b[1] / 100 * h, (b[0] + b[2]) / 100 * w, (b[1] + b[3]) / 100 * h]


def overlapping_pairs(boxes: DataFrame, threshold: float = 0.5, cell: float = 256.0) -> DataFrame:
    """Pairs of boxes (key, image_key, label, x1, y1, x2, y2) of one picture and label with IoU >= ``threshold``.

    Two boxes overlap only if they share a grid cell and their sides are alike
    within the threshold, so candidates meet by equality on picture, label and
    cell; a pair is kept in the cell of its own overlap's corner only.  Cells
    of large boxes widen with the box: each box is laid on the grid whose
    cells are about its larger side, and meets boxes of its own and the next
    grid, since IoU >= t bounds the ratio of sides by t.
    """
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    grids = [0] if threshold <= 0 else range(int(-(-1 // threshold)).bit_length())
    level = F.greatest(F.lit(0), F.ceil(F.log2(side / cell))).cast("int")
    base = boxes.where("x2 > x1 and y2 > y1 and image_key is not null and label is not null").withColumn("level", level)
    at = lambda c, lv: F.floor(F.col(c) / (F.lit(cell) * F.pow(F.lit(2.0), lv))).cast("int")

    def laid(df: DataFrame, lv: Column) -> DataFrame:
        df = df.withColumn("grid", lv)
        df = df.withColumn("gx", F.explode(F.sequence(at("x1", F.col("grid")), at("x2", F.col("grid")))))
        return df.withColumn("gy", F.explode(F.sequence(at("y1", F.col("grid")), at("y2", F.col("grid")))))

    cols = ["key", "x1", "y1", "x2", "y2", "level"]
    left = laid(base, F.col("level"))
    # The smaller box also lies on the coarser grids its partner may have.
    right = laid(base.withColumn("up", F.explode(F.array(*[F.lit(g) for g in grids]))), F.col("level") + F.col("up"))
    a = left.select("image_key", "label", "grid", "gx", "gy", *[F.col(c).alias(f"{c}_a") for c in cols])
    b = right.select("image_key", "label", "grid", "gx", "gy", *[F.col(c).alias(f"{c}_b") for c in cols])
    pairs = a.join(b, ["image_key", "label", "grid", "gx", "gy"]).where(
        ((F.col("level_a") > F.col("level_b")) | (F.col("level_a") == F.col("level_b")) & (F.col("key_a") < F.col("key_b")))
        & (F.col("gx") == at_overlap("x1_a", "x1_b", cell)) & (F.col("gy") == at_overlap("y1_a", "y1_b", cell))
    )
    box = lambda s: [F.col(f"{c}_{s}") for c in ("x1", "y1", "x2", "y2")]
    return (
        pairs.withColumn("iou", box_iou(box("a"), box("b")))
        .where(F.col("iou") >= threshold)
        .select("image_key", "label", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), "iou")
    )


def at_overlap(a: str, b: str, cell: float) -> Column:
    """The grid line position of the overlap's first corner."""
    return F.floor(F.greatest(a, b) / (F.lit(cell) * F.pow(F.lit(2.0), F.col("grid")))).cast("int")


GRID = 512.0  # pixels of a cell of kept boxes
NMS_ORDER = ["image_key", "label", "_conf", "x1", "y1", "x2", "y2", "key"]


def suppress(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy suppression per picture and label: a box is kept unless a kept one overlaps it by ``threshold`` or more.

    Order: confidence falling (missing counts as 0), then the box's corners,
    then the key.  Rows with a null picture or label, or a corner that is null or not
    finite, are left out.
    Returns the kept rows with ``rank`` by that order within the picture and
    label.  The rows of a picture and label stream through one task in order;
    kept boxes lie in a grid, so a row meets only those near it however
    crowded the picture is.
    """

    def overlaps(x1, y1, x2, y2, area, k) -> bool:
        w, h = min(x2, k[2]) - max(x1, k[0]), min(y2, k[3]) - max(y1, k[1])
        return w > 0 and h > 0 and w * h / (area + k[4] - w * h) >= threshold

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, count, grid = None, 0, {}
        for batch in batches:
            out = []
            cols = [batch[c].tolist() for c in ("image_key", "label", "key", "x1", "y1", "x2", "y2")]
            for image, label, key, x1, y1, x2, y2 in zip(*cols):
                if (image, label) != group:
                    group, count, grid = (image, label), 0, {}
                area = max(0.0, x2 - x1) * max(0.0, y2 - y1)
                cells = [(i, j) for i in range(int(x1 // GRID), int(x2 // GRID) + 1) for j in range(int(y1 // GRID), int(y2 // GRID) + 1)]
                if not any(overlaps(x1, y1, x2, y2, area, k) for c in cells for k in grid.get(c, ())):
                    for c in cells:
                        grid.setdefault(c, []).append((x1, y1, x2, y2, area))
                    out.append((image, label, key, count))
                    count += 1
            yield pd.DataFrame(out, columns=["image_key", "label", "key", "rank"])

    rows = boxes.where(F.col("image_key").isNotNull() & F.col("label").isNotNull() & finite(F.col("x1")) & finite(F.col("y1")) & finite(F.col("x2")) & finite(F.col("y2")))
    ordered = rows.withColumn("_conf", -F.coalesce("confidence", F.lit(0.0))).select(*NMS_ORDER).repartition("image_key", "label").sortWithinPartitions(*NMS_ORDER)
    kinds = dict(rows.dtypes)
    return ordered.mapInPandas(run, f"image_key {kinds['image_key']}, label string, key {kinds['key']}, rank int")


def rejected_rows(annotations: DataFrame, images: DataFrame, names: DataFrame) -> DataFrame:
    """Import rejects in row order: unknown picture, repeated object id after the first, unknown category, bad box.

    ``annotations`` (ann_key, image_key, object_id, label, bbox); each row with
    ``code`` (null: taken).  Row order is the key.
    """
    first = annotations.groupBy(F.col("image_key").alias("_i"), F.col("object_id").alias("_o")).agg(F.min("ann_key").alias("_first"))
    sized = images.groupBy("image_key").agg(F.max("width").alias("width"), F.max("height").alias("height")).withColumn("_image", F.lit(True))
    known = names.select(F.col("category_name").alias("label")).distinct().withColumn("_known", F.lit(True))
    rows = annotations.join(first, F.col("image_key").eqNullSafe(F.col("_i")) & F.col("object_id").eqNullSafe(F.col("_o"))).join(sized, "image_key", "left").join(known, "label", "left")
    box = clean_box(box_columns(F.col("bbox")), F.size("bbox"), F.col("width"), F.col("height"))
    code = (
        F.when(F.col("_image").isNull(), "missing_image")
        .when(F.col("ann_key") != F.col("_first"), "duplicate_id")
        .when(F.col("_known").isNull(), "unknown_category")
        .otherwise(box["code"])
    )
    return rows.select("ann_key", code.alias("code"))
