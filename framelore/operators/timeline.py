"""Frames on an exact timeline: validity, lookup by time, sampling.

``frames`` has video_id, frame_index and ts (seconds).  Lookups are as-of joins
written as one union ordered per stretch of a video, so their cost is a sort
and not a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SAMPLES = 1000
TOLERANCE = 1e-6
STRETCH = 3600.0  # seconds of a recording that are ordered together


def frame_order(frames: DataFrame) -> DataFrame:
    """Frames with ``duration`` (to the next frame, the last one's like the one before) and ``increasing`` (ts grows)."""
    w = Window.partitionBy("video_id").orderBy("frame_index")
    gap, before = F.lead("ts").over(w) - F.col("ts"), F.lag("ts").over(w)
    out = frames.withColumn("_gap", gap).withColumn("increasing", before.isNull() | (F.col("ts") > before))
    return out.withColumn("duration", F.coalesce("_gap", F.lag("_gap").over(w), F.lit(0.0))).drop("_gap")


def _neighbours(points: DataFrame, frames: DataFrame) -> DataFrame:
    """``points`` (video_id, point_id, at) with the last frame at or before and the first at or after each.

    A recording is cut into stretches of ``STRETCH`` seconds.  Within one,
    frames and points are put in order; what lies before and after it comes
    from the last and first frames of the other stretches, one row each.  So
    no task holds more than a stretch of a recording, however many points ask
    for it.
    """
    kind = dict(points.dtypes)["point_id"]
    frame = F.struct(F.col("frame_index").cast("bigint").alias("frame_index"), F.col("ts").cast("double").alias("ts"))
    f = frames.where("ts is not null").select("video_id", F.col("ts").cast("double").alias("at"), F.lit(None).cast(kind).alias("point_id"), frame.alias("f"))
    p = points.where("at is not null").select("video_id", F.col("at").cast("double").alias("at"), "point_id", F.lit(None).cast("struct<frame_index: bigint, ts: double>").alias("f"))
    both = f.unionByName(p).withColumn("stretch", F.floor(F.col("at") / STRETCH).cast("bigint"))
    place = F.struct("at", F.col("f.frame_index").alias("n"))
    ends = both.groupBy("video_id", "stretch").agg(F.max_by("f", F.when(F.col("f").isNotNull(), place)).alias("_last"), F.min_by("f", F.when(F.col("f").isNotNull(), place)).alias("_first"))
    order = Window.partitionBy("video_id").orderBy("stretch")  # one row per stretch
    ends = ends.select(
        "video_id", "stretch",
        F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    # At equal times the frame comes first going forward and, read backward, first as well.
    here = Window.partitionBy("video_id", "stretch")
    forward = here.orderBy("at", F.col("point_id").isNotNull(), "f.frame_index").rowsBetween(Window.unboundedPreceding, 0)
    backward = here.orderBy(F.col("at").desc(), F.col("point_id").isNotNull(), F.col("f.frame_index").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("lo", F.last("f", ignorenulls=True).over(forward)).withColumn("hi", F.last("f", ignorenulls=True).over(backward)).where("point_id is not null")
    return found.join(ends, ["video_id", "stretch"]).select("video_id", "point_id", "at", F.coalesce("lo", "_before").alias("lo"), F.coalesce("hi", "_after").alias("hi"))


def frame_at(points: DataFrame, frames: DataFrame) -> DataFrame:
    """The frame shown at each time: the last with ts <= at (within a microsecond), the first before all of them."""
    moved = points.withColumn("at", F.col("at") + TOLERANCE)
    return _neighbours(moved, frames).select("video_id", "point_id", F.coalesce("lo.frame_index", "hi.frame_index").alias("frame_index")).where("frame_index is not null")


def nearest_frame(points: DataFrame, frames: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """The frame nearest to each time; of two equally near the earlier.

    ``limits`` (video_id, lower, upper) restricts the frames of a video to a
    range of times; a video without a frame in it has no result.
    """
    if limits is not None:
        frames = frames.join(limits.select("video_id", "lower", "upper"), "video_id").where("ts >= lower and ts <= upper").select("video_id", "frame_index", "ts")
    near = _neighbours(points, frames)
    later = F.col("lo").isNull() | (F.col("hi.ts") - F.col("at") < F.col("at") - F.col("lo.ts"))
    pick = F.when(F.col("hi").isNull(), F.col("lo")).when(later, F.col("hi")).otherwise(F.col("lo"))
    return near.withColumn("pick", pick).where("pick is not null").select("video_id", "point_id", F.col("pick.frame_index").alias("frame_index"), F.col("pick.ts").alias("ts"))


def _sampled(points: DataFrame, frames: DataFrame, limits: DataFrame) -> DataFrame:
    return nearest_frame(points, frames, limits).select("video_id", "frame_index", "ts").distinct()


def sample_interval(frames: DataFrame, limits: DataFrame, step: float) -> DataFrame:
    """Frames nearest to lower, lower + step, ... up to upper: video_id, frame_index, ts, fault.

    A video that would need more than 1,000 points is refused: one row without
    a frame and the reason.  A range that ends before it starts has no row.
    """
    asked = limits.where("upper >= lower").withColumn("_n", F.floor((F.col("upper") - F.col("lower")) / step))
    points = asked.where(F.col("_n") < MAX_SAMPLES).select("video_id", "lower", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n"))).alias("point_id"))
    taken = _sampled(points.select("video_id", "point_id", (F.col("lower") + F.col("point_id") * step).alias("at")), frames, limits).withColumn("fault", F.lit(None).cast("string"))
    types = dict(taken.dtypes)
    refused = asked.where(F.col("_n") >= MAX_SAMPLES).select("video_id", *[F.lit(None).cast(types[c]).alias(c) for c in ("frame_index", "ts")], F.lit("too_many_samples").alias("fault"))
    return taken.unionByName(refused)


def sample_count(frames: DataFrame, limits: DataFrame, count: int) -> DataFrame:
    """Frames nearest to ``count`` evenly spaced times of each range."""
    at = F.col("lower") if count == 1 else F.col("lower") + (F.col("upper") - F.col("lower")) * F.col("point_id") / (count - 1)
    points = limits.where("upper >= lower").select("video_id", "lower", "upper", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))).alias("point_id"))
    return _sampled(points.select("video_id", "point_id", at.alias("at")), frames, limits)


def sample_events(frames: DataFrame, limits: DataFrame, boundaries: DataFrame) -> DataFrame:
    """The nearest frame of each boundary (video_id, point_id, at) in range, with the frame before and after it."""
    inside = boundaries.join(limits, "video_id").where("at >= lower and at <= upper").select("video_id", "point_id", "at")
    near = nearest_frame(inside, frames, limits)
    around = near.select("video_id", F.explode(F.array(*[F.col("frame_index") + i for i in (-1, 0, 1)])).alias("frame_index")).distinct()
    return around.join(frames, ["video_id", "frame_index"]).select("video_id", "frame_index", "ts")


def even_indices(first: Column, last: Column, count: int) -> Column:
    """``count`` indices from first to last, half-even rounding, each once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.rint(first + (last - first) * i / max(1, count - 1)).cast("bigint")))


def event_fault(kind: Column, start: Column, end: Column, label: Column, text: Column, duration: Column) -> Column:
    """Why a temporal event is not valid, or null: kind, start, point with an end, interval without or reversed, past the video, nothing said."""
    return (
        F.when(~F.coalesce(kind.isin("interval", "point"), F.lit(False)), "unknown_kind")
        .when(start.isNull() | F.isnan(start) | (start < 0), "bad_start")
        .when((kind == "point") & end.isNotNull(), "point_with_end")
        .when((kind == "interval") & (end.isNull() | F.isnan(end)), "missing_end")
        .when((kind == "interval") & (end <= start), "reversed")
        .when(F.coalesce(end, start) > duration + TOLERANCE, "past_video_end")
        .when((F.length(F.trim(F.coalesce(label, F.lit("")))) == 0) & (F.length(F.trim(F.coalesce(text, F.lit("")))) == 0), "nothing_said")
    )
