"""Class catalogs: merging, mapping and numbering.

Numbering by order runs in ranges, since freely entered classes may be many.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelore.tables import stage


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``number``: their place from 0 in ``order``, which must tell all rows apart.

    Rows are numbered in ranges: each range numbers its own rows, and the sizes
    of the ranges before it are added, so no task sees all of them.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), label)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    here = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_here", here).join(F.broadcast(sizes), "_part").withColumn("number", (F.col("_here") + F.col("_before")).cast("int")).drop("_part", "_here", "_before")  # one row per range


def first_seen(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Distinct values with the smallest ``order`` they occur at, numbered from 0 by it; freely typed values may be many."""
    seen = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(order).alias("position"))
    return numbered(seen, ["position", name], "first-seen").select(name, "position", "number")


def merge_categories(rows: DataFrame) -> DataFrame:
    """Categories (source_id, name, ord) by trimmed name: id in order of first sight, first source id, all source ids in order.

    Names that came twice are the ``duplicate_category_name`` issues.
    """
    named = rows.withColumn("name", F.trim("name")).where("name <> ''")
    merged = named.groupBy("name").agg(F.min("ord").alias("position"), F.array_sort(F.collect_list(F.struct("ord", "source_id"))).alias("all"))
    merged = numbered(merged, ["position", "name"], "categories").withColumnRenamed("number", "category_id")
    return merged.select("category_id", "name", F.get("all", F.lit(0))["source_id"].alias("source_id"), F.array_join(F.transform("all", lambda s: s["source_id"].cast("string")), ",").alias("source_ids"), (F.size("all") > 1).alias("duplicate"))


def append_categories(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The catalog after an import: ``current`` (category_id, name) and the targets of ``incoming`` (name, target, ord).

    A class goes to its mapped target, else keeps its name; new targets get
    ids after the largest, in order of first sight.
    """
    wanted = incoming.select(F.coalesce("target", "name").alias("name"), "ord").where("name is not null")
    fresh = wanted.join(current, "name", "left_anti").groupBy("name").agg(F.min("ord").alias("position"))
    top = current.agg(F.coalesce(F.max("category_id"), F.lit(-1)).alias("top"))
    new = numbered(fresh, ["position", "name"], "new-categories").crossJoin(F.broadcast(top))  # one row
    return current.select("category_id", "name", F.lit(False).alias("added")).unionByName(new.select((F.col("top") + F.col("number") + 1).cast("int").alias("category_id"), "name", F.lit(True).alias("added")))


def coco_ids(categories: DataFrame) -> DataFrame:
    """COCO ids in order of ``ord``: the source id if it is not negative and still free, else the smallest free positive number.

    Sequential by definition, so one task takes the catalog in order; it does
    one step per class.  Source ids that are negative or taken fall to the
    smallest number not used so far.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: set[int] = set()
        least = 1
        for b in batches:
            ids = []
            for own in b["source_id"].tolist():
                if own is None or own != own or own < 0 or int(own) in used:
                    while least in used:
                        least += 1
                    own = least
                used.add(int(own))
                ids.append(int(own))
            yield pd.DataFrame({"name": b["name"], "coco_id": ids})

    ordered = categories.select("ord", "name", F.col("source_id").cast("bigint").alias("source_id")).repartition(1).sortWithinPartitions("ord", "name", "source_id")
    return ordered.mapInPandas(run, "name string, coco_id bigint")


def merge_label_catalogs(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """How incoming labels (label_id, name) meet the current ones: label_id, target_id, outcome.

    By id first: same name matches, another name is a conflict; else by name;
    else the label is new.
    """
    by_id = current.select("label_id", F.col("name").alias("_name"))
    by_name = current.groupBy("name").agg(F.min("label_id").alias("_other"))
    j = incoming.join(by_id, "label_id", "left").join(by_name, "name", "left")
    outcome = F.when(F.col("_name") == F.col("name"), "same").when(F.col("_name").isNotNull(), "conflict").when(F.col("_other").isNotNull(), "by_name").otherwise("new")
    target = F.when(outcome == "by_name", F.col("_other")).when(outcome != "conflict", F.col("label_id"))
    return j.select("label_id", "name", target.alias("target_id"), outcome.alias("outcome"))
