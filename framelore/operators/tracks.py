"""Object tracks: coverage, states, and splitting, merging and clearing.

A track has spans of inclusive frames: visibility ranges, and keyframes as
spans of one frame.  Merging spans goes through the interval operator, which
spreads a very long track over partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelore.operators.intervals import merge_intervals
from framelore.operators.ranges import within


def coverage(tracks: DataFrame, spans: DataFrame) -> DataFrame:
    """Whether reviewed spans cover every frame of each track's window: ``covered``, and ``first_gap``, the first frame that is not.

    ``tracks`` (track_id, start_frame, end_frame, ask_start, ask_end),
    ``spans`` (track_id, start_frame, end_frame, reviewed).  The window is the
    part of ask_start to ask_end within the lifetime; an empty one is covered,
    a track without spans is not.  Only spans that meet the window count.
    """
    asked = tracks.select("track_id", F.greatest("start_frame", "ask_start").alias("lo"), F.least("end_frame", "ask_end").alias("hi"))
    reviewed = spans.where("reviewed and start_frame is not null and end_frame is not null")
    inside = reviewed.join(asked, "track_id").where("start_frame <= hi and end_frame >= lo")
    clipped = inside.select(F.col("track_id").alias("entity"), F.greatest("start_frame", "lo").alias("start_at"), F.least("end_frame", "hi").alias("end_at"))
    first = merge_intervals(clipped, 1, "coverage").where("kind = 'period'").groupBy(F.col("entity").alias("track_id")).agg(F.min(F.struct("start_at", "end_at")).alias("first"))
    gap = F.when(F.col("lo") > F.col("hi"), F.lit(None)).when(F.col("first").isNull() | (F.col("first.start_at") > F.col("lo")), F.col("lo")).when(F.col("first.end_at") < F.col("hi"), F.col("first.end_at") + 1)
    return asked.join(first, "track_id", "left").select("track_id", gap.isNull().alias("covered"), gap.cast("bigint").alias("first_gap"))


def overlapping_spans(spans: DataFrame) -> DataFrame:
    """Tracks in which two spans share a frame; neighbours that only touch do not count.

    Spans overlap exactly if their lengths add up to more than their union
    has: two aggregates and the interval operator, no ordering of a track.
    """
    good = spans.where("track_id is not null and start_frame >= 0 and end_frame >= start_frame")
    length = lambda a, b: F.sum(F.col(b) - F.col(a) + 1)
    every = good.groupBy("track_id").agg(length("start_frame", "end_frame").alias("_all"))
    union = merge_intervals(good.select(F.col("track_id").alias("entity"), F.col("start_frame").alias("start_at"), F.col("end_frame").alias("end_at")), 1, "overlaps").where("kind = 'period'")
    held = union.groupBy(F.col("entity").alias("track_id")).agg(length("start_at", "end_at").alias("_union"))
    return every.join(held, "track_id").where("_all > _union").select("track_id")


def frame_states(asked: DataFrame, tracks: DataFrame, keyframes: DataFrame, ranges: DataFrame) -> DataFrame:
    """The state of a track at a frame (track_id, frame_index): inactive, its keyframe's or range's visibility, or missing.

    A keyframe goes before a range; of several ranges the smallest name wins.
    """
    key = keyframes.groupBy("track_id", "frame_index").agg(F.min("visibility").alias("_key"))
    life = tracks.select("track_id", F.col("start_frame").alias("_s"), F.col("end_frame").alias("_e"))
    base = asked.join(life, "track_id", "left").join(key, ["track_id", "frame_index"], "left")
    found = within(asked, ranges.select("track_id", "start_frame", "end_frame", "visibility"), "track_id", "frame_index", "start_frame", "end_frame")
    covering = found.groupBy("track_id", "frame_index").agg(F.min("visibility").alias("_range"))
    dead = F.col("_s").isNull() | (F.col("frame_index") < F.col("_s")) | (F.col("frame_index") > F.col("_e"))
    return base.join(covering, ["track_id", "frame_index"], "left").select("track_id", "frame_index", F.when(dead, "inactive").otherwise(F.coalesce("_key", "_range", F.lit("missing"))).alias("state"))


def clip_ranges(ranges: DataFrame, start: Column, end: Column) -> DataFrame:
    """The parts of the ranges within start to end; ranges outside are dropped."""
    kept = ranges.where((F.col("start_frame") <= end) & (F.col("end_frame") >= start))
    return kept.withColumn("_s", F.greatest(F.col("start_frame"), start)).withColumn("end_frame", F.least(F.col("end_frame"), end)).withColumn("start_frame", F.col("_s")).drop("_s")


def split_tracks(ranges: DataFrame, cuts: DataFrame) -> DataFrame:
    """Ranges after each track was split at its cut (track_id, at): the later part goes to ``<id>/2`` and is unreviewed."""
    joined = ranges.join(cuts, "track_id", "left")
    early = clip_ranges(joined, F.lit(-(2**31)), F.coalesce(F.col("at") - 1, F.lit(2**31 - 1)))
    late = clip_ranges(joined.where("at is not null"), F.col("at"), F.lit(2**31 - 1)).withColumn("track_id", F.concat("track_id", F.lit("/2")))
    return early.unionByName(late).withColumn("reviewed", F.col("reviewed") & F.col("at").isNull()).drop("at")


def split_references(events: DataFrame, cuts: DataFrame) -> DataFrame:
    """Track references of events after a split at a boundary time: events (event_id, kind, start, end, track_ids), cuts (old, new, boundary).

    The old track goes when the event starts at or after the boundary; the new
    one comes when an interval ends after it or a point lies at or after it.
    """
    hit = F.array_contains("track_ids", F.col("old"))
    refs = F.when(F.col("start") >= F.col("boundary"), F.array_remove("track_ids", F.col("old"))).otherwise(F.col("track_ids"))
    late = F.when(F.col("kind") == "interval", F.col("end") > F.col("boundary")).otherwise(F.col("start") >= F.col("boundary"))
    refs = F.array_distinct(F.when(late, F.array_append(refs, F.col("new"))).otherwise(refs))
    pairs = events.withColumn("old", F.explode_outer("track_ids")).join(cuts, "old").where(hit)
    changed = pairs.select("event_id", refs.alias("_refs"))
    return events.join(changed, "event_id", "left").withColumn("track_ids", F.coalesce("_refs", "track_ids")).drop("_refs")


def merge_tracks(ranges: DataFrame, merges: DataFrame) -> DataFrame:
    """Ranges after tracks were merged (old, into): renamed, in one lifetime, and no longer reviewed."""
    joined = ranges.join(merges.select(F.col("old").alias("track_id"), "into"), "track_id", "left").join(merges.select(F.col("into").alias("track_id")).distinct().withColumn("_target", F.lit(True)), "track_id", "left")
    touched = F.col("into").isNotNull() | F.coalesce("_target", F.lit(False))
    return joined.withColumn("reviewed", F.col("reviewed") & ~touched).withColumn("track_id", F.coalesce("into", "track_id")).drop("into", "_target")


def clear_span(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """Ranges without the frames of a span per track (track_id, from_frame, to_frame); one range may become two."""
    joined = ranges.join(spans, "track_id", "left")
    untouched = joined.where("from_frame is null").drop("from_frame", "to_frame")
    hit = joined.where("from_frame is not null")
    before = clip_ranges(hit, F.lit(0), F.col("from_frame") - 1).drop("from_frame", "to_frame")
    after = clip_ranges(hit, F.col("to_frame") + 1, F.lit(2**31 - 1)).drop("from_frame", "to_frame")
    return untouched.unionByName(before).unionByName(after)


def accepted_suggestions(keyframes: DataFrame, suggestions: DataFrame, protected: DataFrame) -> DataFrame:
    """Keyframes after suggestions were taken: a suggestion replaces the frame's keyframe unless a person made it or a protected range holds it.

    keyframes (track_id, frame_index, origin), suggestions (track_id,
    frame_index), protected (track_id, start_frame, end_frame).
    """
    held = within(suggestions, protected, "track_id", "frame_index", "start_frame", "end_frame").select("track_id", "frame_index").distinct()
    human = keyframes.where("origin = 'human'").select("track_id", "frame_index").distinct()
    free = suggestions.select("track_id", "frame_index").distinct().join(held, ["track_id", "frame_index"], "left_anti").join(human, ["track_id", "frame_index"], "left_anti")
    kept = keyframes.join(free, ["track_id", "frame_index"], "left_anti").select("track_id", "frame_index", "origin")
    return kept.unionByName(free.withColumn("origin", F.lit("ai")))
