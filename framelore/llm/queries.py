"""Queries of the problems tagged llm, and their SQL twins."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelore.llm import canonical, mixing, overlap, packing, pii, splits, survivors
from framelore.llm.oracles import ORACLES  # noqa: F401
from framelore.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(table(spark, d, "images"))


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    return overlap.coverage(table(spark, d, "images"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "images"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_classes(table(spark, d, "images"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.same_file_pairs(table(spark, d, "images"), table(spark, d, "import_sources"))


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.surviving_records(table(spark, d, "images"), table(spark, d, "import_sources"))


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    return survivors.group_members(table(spark, d, "images"), table(spark, d, "import_sources")).select("image_key", "survivor", "leads")


def _labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "annotations"), table(spark, d, "import_sources"), table(spark, d, "label_catalog")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.found_labels(*_labels(spark, d))


def p3_labels(spark: SparkSession, d: str) -> DataFrame:
    return canonical.resolve_labels(*_labels(spark, d))


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return canonical.resolve_labels(*_labels(spark, d)).where("category_id = -1").groupBy("value").count().withColumnRenamed("count", "annotations")


def p3_targets(spark: SparkSession, d: str) -> DataFrame:
    """The targets of every category mapping with their entry."""
    targets = table(spark, d, "import_sources").select("source_id", F.explode("category_mapping").alias("class_name", "value"))
    return targets.join(canonical.resolve_values(targets.select("value"), table(spark, d, "label_catalog")), "value", "left")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.related_rows(table(spark, d, "video_manifest"))


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "video_manifest"), table(spark, d, "split_targets"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_shares(p5_splits(spark, d), table(spark, d, "split_targets"))


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows per split: as close to the targets as whole sets allow, which on these tables is exact."""
    return p5_shares(spark, d).select("split", "rows")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p8_containers(spark, d))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The largest mixture in which every source has its share."""
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"), domains=mixing.DOMAINS)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(p9_mixture(spark, d), table(spark, d, "mix_targets"))


def p9_filled(spark: SparkSession, d: str) -> DataFrame:
    """As many tokens as all texts of target sources have; what a source lacks goes to its domain, then to other domains."""
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"), total="all", domains=mixing.DOMAINS)


def p9_filled_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(p9_filled(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found_entities(table(spark, d, "documents"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted_documents(table(spark, d, "documents"))


def p10_surrogates(spark: SparkSession, d: str) -> DataFrame:
    """The key is the session's ``spark.framelore.surrogateKey``; where it is unset, one made for this run."""
    return pii.surrogate_documents(table(spark, d, "documents"), spark.conf.get("spark.framelore.surrogateKey", None) or secrets.token_hex(32))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_coverage, p1_report, p1_classes, p2_found, p2_survivors, p2_members, p3_found, p3_labels, p3_unmatched, p3_targets, p5_found, p5_splits, p5_shares, p5_totals,
        p8_containers, p8_report, p9_mixture, p9_shares, p9_filled, p9_filled_shares, p10_found, p10_redacted, p10_surrogates,
    )
}
