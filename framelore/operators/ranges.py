"""Joining positions to the ranges that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512


def within(points: DataFrame, ranges: DataFrame, key: str, at: str, first: str, last: str, block: int = BLOCK) -> DataFrame:
    """Points joined to the ranges of the same ``key`` with first <= at <= last.

    Positions are cut into blocks, of the size a range has: ``block`` times the
    power of two that is at least its length, so a range lies on one or two
    blocks however long it is, a damaged bound included.  A point asks once for
    each size that occurs (55 at most).  Rows meet by equality on key, size
    and block: a key with a third of all rows is spread over its blocks instead
    of pairing all its points with all its ranges.  A point lies in one block
    of a size, so no pair comes twice.  Nulls and ranges that end before they
    start match nothing.
    """
    start, stop = F.col(first).cast("double"), F.col(last).cast("double")
    level = F.greatest(F.lit(0), F.ceil(F.log2((stop - start + 1) / block))).cast("int")
    at_level = lambda position: F.floor(position / (F.lit(float(block)) * F.pow(F.lit(2.0), F.col("_level")))).cast("bigint")
    sized = ranges.where((F.col(last) >= F.col(first)) & F.col(key).isNotNull()).withColumn("_level", level)
    laid = sized.withColumn("_block", F.explode(F.sequence(at_level(start), at_level(stop))))
    levels = F.broadcast(sized.select("_level").distinct())  # at most 55 rows
    placed = points.where(F.col(key).isNotNull()).crossJoin(levels).withColumn("_block", at_level(F.col(at).cast("double")))
    return placed.join(laid, [key, "_level", "_block"]).where((F.col(at) >= F.col(first)) & (F.col(at) <= F.col(last))).drop("_block", "_level")
