"""One surviving record per group of duplicate records.

Method: records of a group are ranked by completeness, trust and recency with
a deterministic tie-break by window ordering; the top record survives, and
each field is taken from the best record that has a usable value for it.

Scale: a group larger than ``PER_PART`` rows is cut into as many salted parts
as its count asks for, so a group with a third of all rows is ranked in parts
of bounded size at any scale; the best rows of the parts then meet in an
aggregate with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelore.llm import keys
from framelore.tables import stage

PER_PART = 20000
# How far a status is trusted, best first.
STATUS_TRUST = ["final_reviewed", "human_reviewed", "ai_suggestion", "imported_coarse", "unreviewed"]
FIELDS = ["source_id", "source_path", "width", "height", "split", "status", "sha256", "provenance"]


def _usable(images: DataFrame) -> DataFrame:
    """Field values in uniform notation, null where they say nothing."""
    status = F.lower(F.trim("status"))
    known = keys.canonical_split(F.col("split"))
    return images.select(
        "image_key",
        "path",
        F.when(F.length(F.trim("source_id")) > 0, F.trim("source_id")).alias("source_id"),
        F.when(F.length("source_path") > 0, F.col("source_path")).alias("source_path"),
        F.when(F.col("width") > 0, F.col("width")).alias("width"),
        F.when(F.col("height") > 0, F.col("height")).alias("height"),
        F.when(known != "unspecified", known).alias("split"),
        F.when(status.isin(STATUS_TRUST), status).alias("status"),
        keys.digest(F.col("sha256")).alias("sha256"),
        F.when(F.length(F.trim("provenance")) > 2, F.col("provenance")).alias("provenance"),
        F.col("imported_at").cast("timestamp").alias("imported_at"),
        F.col("updated_at").cast("timestamp").alias("updated_at"),
    )


def group_records(images: DataFrame) -> DataFrame:
    """``image_key`` with ``group_key``: the file of the source it stands for.  Rows without a path are groups of their own."""
    return images.select("image_key", F.coalesce(keys.file_key(F.col("path")), F.concat(F.lit("\x00"), F.col("image_key").cast("string"))).alias("group_key"))


def salted(rows: DataFrame, per_part: int = PER_PART) -> DataFrame:
    """``rows`` with ``salt``: 0 in a group of up to ``per_part`` rows, else a hash of the row over as many parts as the count asks for."""
    large = rows.groupBy("group_key").agg(F.count("*").alias("_n")).where(F.col("_n") > per_part).select("group_key", F.ceil(F.col("_n") / per_part).alias("_parts"))
    row = F.xxhash64("image_key", "path", "sha256", "imported_at", "updated_at")
    return rows.join(large, "group_key", "left").withColumn("salt", F.pmod(row, F.coalesce("_parts", F.lit(1)))).drop("_parts")


def ranked_records(images: DataFrame, sources: DataFrame, per_part: int = PER_PART) -> DataFrame:
    """Usable fields of every row with its group, its order (smallest is best) and ``rank`` within its salted part.

    Order: more usable fields, higher trust (status, then whether the source's
    reviews are trusted), then recency.  A source whose policy is to keep what
    exists prefers the earlier import, all others the later change; the last
    tie goes to the smaller key.
    """
    policy = sources.where("source_id is not null").groupBy("source_id").agg(
        F.max(F.lower(F.trim("duplicate_policy")) == "keep_existing").alias("_keep"), F.max("trust_reviewed").alias("_trusted")
    )
    rows = _usable(images).withColumn("group_key", F.coalesce(keys.file_key(F.col("path")), F.concat(F.lit("\x00"), F.col("image_key").cast("string"))))
    rows = rows.withColumn("_source", F.coalesce("source_id", F.split_part(F.col("path"), F.lit("/"), F.lit(1))))
    rows = rows.join(policy.withColumnRenamed("source_id", "_source"), "_source", "left")
    complete = sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0))
    trust = F.coalesce(F.array_position(F.array(*map(F.lit, STATUS_TRUST)), F.col("status")).cast("int"), F.lit(9))
    moment = F.coalesce("updated_at", "imported_at")
    seconds = F.when(F.coalesce("_keep", F.lit(False)), F.unix_micros(F.coalesce("imported_at", "updated_at"))).otherwise(-F.unix_micros(moment))
    order = F.struct(
        (-complete).alias("missing"),
        trust.alias("trust"),
        (~F.coalesce("_trusted", F.lit(False))).cast("int").alias("untrusted"),
        F.coalesce(seconds, F.lit(2**62)).alias("age"),
        F.coalesce("image_key", F.lit(2**62)).alias("image_key"),
    )
    by_part = Window.partitionBy("group_key", "salt").orderBy("order")
    # Written once: the counts of groups and the ranking both read the keys, which cost much to make.
    rows = stage(rows.withColumn("order", order), "survivor-rows")
    return salted(rows, per_part).withColumn("rank", F.row_number().over(by_part))


def surviving_records(images: DataFrame, sources: DataFrame, per_part: int = PER_PART) -> DataFrame:
    """One row per group: the top record's key and path, each field's best value and the key it came from, and the size.

    A field is taken from the record that is most trusted among those with a
    usable value (status, trusted source, recency, key).  A group of one keeps
    its own values in uniform notation.  A row with a null key takes part and
    loses ties.  Extra columns of ``images`` are ignored.
    """
    rows = ranked_records(images, sources, per_part)
    donor = F.struct("order.trust", "order.untrusted", "order.age", "order.image_key")
    part = Window.partitionBy("group_key", "salt").orderBy(donor).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for f in FIELDS:
        rows = rows.withColumn(f"_{f}", F.first(F.when(F.col(f).isNotNull(), F.struct(donor.alias("donor"), F.col(f).alias("value"), F.col("image_key").alias("origin"))), ignorenulls=True).over(part))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(part))
    tops = rows.where("rank = 1")
    merged = tops.groupBy("group_key").agg(
        F.min(F.struct("order", "image_key", "path")).alias("top"),
        F.sum("_n").alias("records"),
        *[F.min(f"_{f}").alias(f) for f in FIELDS],
    )
    return merged.select(
        F.col("top.image_key").alias("image_key"),
        F.col("top.path").alias("path"),
        *[F.col(f"{f}.value").alias(f) for f in FIELDS],
        *[F.col(f"{f}.origin").alias(f"{f}_from") for f in FIELDS],
        "records",
    )


def group_members(images: DataFrame, sources: DataFrame, per_part: int = PER_PART) -> DataFrame:
    """(image_key, group_key, survivor, leads): every record with the one that survives its group, and whether it is that one.

    ``survivor`` is the key of the top record as text, its path where it has no
    key.  This is the membership beside ``surviving_records``: one row per
    record, however large the group.
    """
    ranked = ranked_records(images, sources, per_part)
    tops = ranked.where("rank = 1").groupBy("group_key").agg(F.min(F.struct("order", "image_key", "path")).alias("top"))
    tops = tops.select("group_key", F.coalesce(F.col("top.image_key").cast("string"), F.concat(F.lit("path:"), "top.path"), F.lit("path:")).alias("survivor"), F.col("top.order").alias("_best"))
    return ranked.select("image_key", "group_key", "order").join(tops, "group_key").select("image_key", "group_key", "survivor", (F.col("order") == F.col("_best")).alias("leads"))


def same_file_pairs(images: DataFrame, sources: DataFrame) -> DataFrame:
    """Every two rows that stand for the same file of the same source, smaller key first: two rows with one survivor.

    Rows with a null key have no pair, a repeated key none with itself.  Keys
    are made distinct before they meet, so no pair comes twice.
    """
    members = stage(group_members(images, sources).where("image_key is not null").select("image_key", "group_key", "survivor").distinct(), "survivor-members")
    a = members.withColumnRenamed("image_key", "image_key_a")
    b = members.withColumnRenamed("image_key", "image_key_b")
    return a.join(b, ["group_key", "survivor"]).where("image_key_a < image_key_b").select("image_key_a", "image_key_b")
