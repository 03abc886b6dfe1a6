"""What a target format would lose or refuse, before anything is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelore.functions.text import xml_safe
from framelore.operators.boxes import box_columns

# What each format can hold.
FORMATS = [
    # format, geometries, keeps confidence, keeps splits, whole-pixel boxes, XML text, splits needed, JPEG only
    ("coco_detection", ["bbox"], False, False, False, False, False, False),
    ("coco_segmentation", ["polygon", "mask"], False, False, False, False, False, False),
    ("yolo_detection", ["bbox"], False, True, False, False, True, False),
    ("voc_detection", ["bbox"], False, True, True, True, False, True),
    ("cvat_detection", ["bbox"], False, False, False, True, False, False),
    ("labelme_detection", ["bbox"], False, False, False, False, False, False),
    ("label_studio_detection", ["bbox"], True, False, False, True, False, False),
    ("native", ["bbox", "polygon", "mask"], True, True, False, False, False, False),
]
SCHEMA = "format string, geometries array<string>, confidence boolean, splits boolean, whole_pixels boolean, xml boolean, needs_split boolean, jpeg boolean"


def format_table(spark) -> DataFrame:
    """The capabilities of all formats, one row each."""
    return spark.createDataFrame(FORMATS, SCHEMA)


def preflight(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Issues per format with counts: format, code, severity, rows; only those that occur.

    The tables are reduced to counts once (by kind, and overall); the formats
    then meet the counts, so no format scans the data again.
    """
    spark = annotations.sparkSession
    x1, y1, x2, y2 = box_columns(F.col("bbox"))
    fractional = (F.floor(x1) != x1) | (F.floor(y1) != y1) | (F.floor(x2) != x2) | (F.floor(y2) != y2)
    by_kind = annotations.groupBy("kind").agg(
        F.count("*").alias("n"), F.count("confidence").alias("confident"), F.count_if(fractional).alias("fractional"), F.count_if(~xml_safe(F.col("label"))).alias("bad_text")
    )
    pictures = images.agg(
        F.count_if(F.col("split") != "unspecified").alias("with_split"), F.count_if(F.col("split") == "unspecified").alias("without_split"), F.count_if(~F.lower("path").rlike(r"[.]jpe?g\z")).alias("not_jpeg")
    )
    formats = F.broadcast(format_table(spark))  # eight rows
    kinds = by_kind.join(formats)
    fits = F.array_contains("geometries", F.col("kind"))
    per = kinds.groupBy("format", "confidence", "splits", "whole_pixels", "xml", "needs_split", "jpeg").agg(
        F.sum(F.when(~fits, F.col("n")).otherwise(0)).alias("unsupported"), F.sum("confident").alias("confident"), F.sum("fractional").alias("fractional"), F.sum("bad_text").alias("bad_text")
    )
    rows = per.join(F.broadcast(pictures))  # one row
    issue = lambda code, severity, when, n: F.when(when & (n > 0), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), n.cast("bigint").alias("rows")))
    yes = F.lit(True)
    issues = F.array(
        issue("unsupported_geometry", "blocking", yes, F.col("unsupported")),
        issue("confidence_sidecar", "loss", ~F.col("confidence"), F.col("confident")),
        issue("splits_sidecar", "loss", ~F.col("splits"), F.col("with_split")),
        issue("unspecified_to_train", "conversion", F.col("needs_split"), F.col("without_split")),
        issue("integer_boxes", "conversion", F.col("whole_pixels"), F.col("fractional")),
        issue("jpeg_conversion", "conversion", F.col("jpeg"), F.col("not_jpeg")),
        issue("invalid_xml_text", "blocking", F.col("xml"), F.col("bad_text")),
    )
    return rows.select("format", F.explode(F.array_compact(issues)).alias("i")).select("format", "i.code", "i.severity", "i.rows")


def acknowledged(issues: DataFrame, codes: list[str]) -> DataFrame:
    """Per format whether an export may start: nothing blocking, and every loss or conversion acknowledged."""
    open_ = F.col("severity").isin("loss", "conversion") & ~F.col("code").isin(codes)
    return issues.groupBy("format").agg((F.count_if(F.col("severity") == "blocking") == 0).alias("possible"), F.array_sort(F.collect_set(F.when(open_, F.col("code")))).alias("unacknowledged"))
