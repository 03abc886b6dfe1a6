"""A dataset as tables, and files as tables."""

from __future__ import annotations

import hashlib
import os
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelore.functions.text import portable_path
from framelore.operators.boxes import clean_box
from framelore.tables import stage

ISSUE = "file string, code string, location string, message string, severity string"


@dataclass
class Dataset:
    """images (path, width, height, split, status), objects (path, object_id, ord, label, x1, y1, x2, y2, confidence, attributes), categories (category_id, name), issues."""

    images: DataFrame
    objects: DataFrame
    categories: DataFrame
    issues: DataFrame | None = None


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(file, content) of the text files under a folder; ``file`` is relative to it."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    base = "/" + root.split("://")[-1].strip("/") + "/"
    name = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return rows.select(F.substring_index(name, base, -1).alias("file"), F.regexp_replace("value", "^﻿", "").alias("content"))


def save_files(files: DataFrame, root: str) -> DataFrame:
    """Writes (file, content) under a folder that all executors share, and returns (file, bytes, digest) of what was written.

    ``root`` is a path or a URI of any file system that Arrow knows (file, hdfs,
    s3, gs).  Each file goes to a name of its own and is then moved, so readers
    never see half of one, and a task that runs again writes the same file.
    Names that are not portable are left out.
    """
    uri = root if "://" in root else f"file://{os.path.abspath(root)}"

    def run(batches):
        from pyarrow import fs

        place, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            out = []
            for name, content in zip(batch["file"], batch["content"]):
                target = f"{base.rstrip('/')}/{name}"
                place.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part, body = f"{target}.{uuid.uuid4().hex}.part", content.encode()
                with place.open_output_stream(part) as stream:
                    stream.write(body)
                place.move(part, target)
                out.append((name, len(body), hashlib.sha256(body).hexdigest()))
            yield pd.DataFrame(out, columns=["file", "bytes", "digest"])

    good = files.where(portable_path(F.col("file")))
    return stage(good.select("file", "content").mapInPandas(run, "file string, bytes bigint, digest string"), "saved-files")


def changed_since_saved(written: DataFrame, found: DataFrame) -> DataFrame:
    """Files of a package that are missing, new or of other content than when they were written: file, fault.

    ``written`` as ``save_files`` returns it, ``found`` (file, content) as
    ``read_files`` does.
    """
    now = found.select("file", F.sha2("content", 256).alias("now"))
    fault = F.when(F.col("now").isNull(), "missing").when(F.col("digest").isNull(), "unexpected").when(F.col("now") != F.col("digest"), "changed")
    return written.select("file", "digest").join(now, "file", "full_outer").select("file", fault.alias("fault")).where("fault is not null")


def take_objects(rows: DataFrame, images: DataFrame, box: list[Column], fault: Column) -> tuple[DataFrame, DataFrame]:
    """Splits parsed rows (path, object_id, ord, label, location, file, ...) into clean objects and issues.

    ``fault`` is the format's own reason to leave a row out; then the picture
    must be there and the box must be clean.
    """
    sized = rows.join(images.select("path", "width", "height").withColumn("_there", F.lit(True)), "path", "left")
    named = {f"_b{i}": c for i, c in enumerate(box)}
    sized = sized.withColumns(named)
    cleaned = clean_box([F.col(f"_b{i}") for i in range(4)], F.lit(4), F.col("width"), F.col("height"))
    reason = F.coalesce(fault, F.when(F.col("_there").isNull(), "missing_image"), F.when(cleaned["code"] != "clipped_bbox", cleaned["code"]))
    judged = sized.withColumns({"_reason": reason, "_clip": cleaned["code"] == "clipped_bbox", **{k: cleaned[k] for k in ("x1", "y1", "x2", "y2")}})
    objects = judged.where("_reason is null").select("path", "object_id", "ord", "label", "x1", "y1", "x2", "y2", "confidence", "attributes")
    bad = judged.where("_reason is not null").select("file", F.lit("invalid_annotation").alias("code"), "location", F.col("_reason").alias("message"), F.lit("error").alias("severity"))
    clip = judged.where("_reason is null and _clip").select("file", F.lit("clipped_bbox").alias("code"), "location", F.lit("box clipped to the picture").alias("message"), F.lit("warning").alias("severity"))
    return objects, bad.unionByName(clip)


def same_datasets(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Objects that differ between two datasets by more than ``tolerance``: empty if they are equivalent.

    Objects are paired by picture, label and their order in both, so ids may differ.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("path", "label").orderBy("x1", "y1", "x2", "y2")
    left, right = (d.select("path", "label", *[F.col(c).alias(f"{c}_{s}") for c in ("x1", "y1", "x2", "y2")], F.row_number().over(w).alias("n")) for d, s in ((a, "a"), (b, "b")))
    joined = left.join(right, ["path", "label", "n"], "full_outer")
    far = [F.coalesce(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) > tolerance, F.lit(True)) for c in ("x1", "y1", "x2", "y2")]
    return joined.where(far[0] | far[1] | far[2] | far[3])
