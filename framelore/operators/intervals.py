"""Merging overlapping intervals per entity and listing the gaps.

Method: an ordered map of disjoint intervals per entity is kept as keyed
state; an insertion finds its overlaps by binary search, merges them and
updates the gaps (``IntervalMap``).  The streaming form keeps the map in the
state store (``framelore.streaming.intervals``).  The batch form feeds the
same map from rows that are range-partitioned by (entity, start), so that an
entity with a third of all rows is spread over many partitions; the pieces are
then stitched at the partition borders from one summary row per entity and
partition.  No step gathers all rows of an entity.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelore.tables import stage


class IntervalMap:
    """Disjoint closed intervals in order.  ``touch`` is the distance that still counts as continuous: 1 for frames, 0 for a time axis."""

    __slots__ = ("ends", "starts", "touch")

    def __init__(self, touch: int, starts: list[int] | None = None, ends: list[int] | None = None):
        self.touch, self.starts, self.ends = touch, list(starts or ()), list(ends or ())

    def insert(self, start: int, end: int) -> tuple[int, int]:
        """Adds an interval, returns the period it now belongs to."""
        starts, ends = self.starts, self.ends
        lo = bisect_left(ends, start - self.touch)
        hi = bisect_right(starts, end + self.touch)
        if lo < hi:
            start, end = min(start, starts[lo]), max(end, ends[hi - 1])
        starts[lo:hi], ends[lo:hi] = [start], [end]
        return start, end

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends))

    def gaps(self) -> list[tuple[int, int]]:
        """The holes: first and last missing frame, or from one end to the next start on a time axis."""
        t = self.touch
        return [(e + t, s - t) for e, s in zip(self.ends, self.starts[1:])]


LOCAL_SCHEMA = "entity string, part int, start_at bigint, end_at bigint"


def _merge_sorted(touch: int):
    """Feeds the rows of one range partition, sorted by entity and start, to one map after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        entity, state = None, IntervalMap(touch)
        out: list[tuple] = []
        for batch in batches:
            for who, start, end in zip(batch["entity"].tolist(), batch["start_at"].tolist(), batch["end_at"].tolist()):
                if who != entity:
                    out += [(entity, part, s, e) for s, e in state.periods()]
                    entity, state = who, IntervalMap(touch)
                elif len(state.starts) > 4096:  # sorted input: only the last period can still grow
                    out += [(entity, part, s, e) for s, e in state.periods()[:-1]]
                    state = IntervalMap(touch, state.starts[-1:], state.ends[-1:])
                state.insert(start, end)
            if len(out) > 20000:
                yield pd.DataFrame(out, columns=["entity", "part", "start_at", "end_at"])
                out = []
        out += [(entity, part, s, e) for s, e in state.periods()]
        if out:
            yield pd.DataFrame(out, columns=["entity", "part", "start_at", "end_at"])

    return run


def merge_intervals(rows: DataFrame, touch: int, label: str = "intervals") -> DataFrame:
    """Continuous periods and the gaps between them: entity, kind (period, gap), start_at, end_at.

    ``rows`` has entity string, start_at and end_at bigint (inclusive frames
    with ``touch`` 1, points of an axis with ``touch`` 0).  Rows with a null or
    a negative bound, a null entity or an end before the start are left out;
    repeated and nested rows change nothing; no rows give no rows.
    """
    rows = rows.select("entity", F.col("start_at").cast("bigint").alias("start_at"), F.col("end_at").cast("bigint").alias("end_at")).where(
        "entity is not null and start_at >= 0 and end_at >= start_at"
    )
    # Exact repeats and intervals of equal start carry no more than their longest end.
    rows = rows.groupBy("entity", "start_at").agg(F.max("end_at").alias("end_at"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = stage(
        rows.repartitionByRange(parts, "entity", "start_at").sortWithinPartitions("entity", "start_at").mapInPandas(_merge_sorted(touch), LOCAL_SCHEMA),
        label,
    )
    # One summary row per entity and partition carries the ends over the borders.
    by_part = Window.partitionBy("entity").orderBy("part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    ends = local.groupBy("entity", "part").agg(F.max("end_at").alias("top")).withColumn("carry", F.max("top").over(before)).select("entity", "part", "carry")
    marked = local.join(ends, ["entity", "part"]).withColumn("head", F.col("carry").isNull() | (F.col("start_at") > F.col("carry") + touch))
    pieces = (
        marked.groupBy("entity", "part")
        .agg(
            F.max(F.when(~F.col("head"), F.col("end_at"))).alias("tail_end"),
            F.max(F.when(F.col("head"), F.col("start_at"))).alias("last_head"),
            F.min(F.when(F.col("head"), F.col("start_at"))).alias("first_head"),
        )
        .withColumn("run", F.sum(F.when(F.col("last_head").isNotNull(), 1).otherwise(0)).over(before.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("run", F.coalesce("run", F.lit(0)))
    )
    # Tails of the partitions up to and including the next one with a head extend the last head before them.
    longer = pieces.where("tail_end is not null").groupBy("entity", "run").agg(F.max("tail_end").alias("tail_end"))
    after = by_part.rowsBetween(1, Window.unboundedFollowing)
    heads = (
        pieces.withColumn("next_head", F.min("first_head").over(after))
        .where("last_head is not null")
        .select("entity", "part", "last_head", "next_head", (F.col("run") + 1).alias("run"))
        .join(longer, ["entity", "run"], "left")
        .drop("run")
    )
    inside = Window.partitionBy("entity", "part").orderBy("start_at")
    periods = (
        marked.where("head")
        .withColumn("following", F.lead("start_at").over(inside))
        .join(heads, ["entity", "part"])
        .withColumn("end_at", F.when(F.col("start_at") == F.col("last_head"), F.greatest("end_at", F.coalesce("tail_end", F.col("end_at")))).otherwise(F.col("end_at")))
        .withColumn("following", F.coalesce("following", "next_head"))
    )
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("start_at").alias("a"), F.col("end_at").alias("b")),
        F.when(F.col("following").isNotNull(), F.struct(F.lit("gap").alias("kind"), (F.col("end_at") + touch).alias("a"), (F.col("following") - touch).alias("b"))),
    )
    return periods.select("entity", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select(
        "entity", F.col("x.kind").alias("kind"), F.col("x.a").alias("start_at"), F.col("x.b").alias("end_at")
    )


def track_intervals(ranges: DataFrame) -> DataFrame:
    """Frames of visibility_ranges, any visibility; the entity is the track."""
    return ranges.select(F.col("track_id").alias("entity"), F.col("start_frame").cast("bigint").alias("start_at"), F.col("end_frame").cast("bigint").alias("end_at"))


def event_intervals(events: DataFrame) -> DataFrame:
    """Milliseconds of the interval events of video_events; those without length are left out."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    usable = (F.lower(F.trim("kind")) == "interval") & ~F.isnan(F.col("start_s")) & ~F.isnan(F.col("end_s"))
    return events.where(usable).select(F.col("video_id").alias("entity"), ms("start_s").alias("start_at"), ms("end_s").alias("end_at")).where("end_at > start_at")
