"""From a preview to an export: a frozen snapshot, its checks, and a start that can be repeated.

A preview writes the selected pictures and objects once; what is saved later
does not enter an export that starts from it.  Starting reads only the frozen
plan, so it costs the same at any size.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelore.operators.preflight import FORMATS, preflight
from framelore.store import Conflict, Warehouse

# Severities that must be acknowledged before an export starts.
NEEDS_CONSENT = ["loss", "conversion"]


def source_faults(images: DataFrame, actual: DataFrame) -> DataFrame:
    """Pictures whose file is not what the snapshot was made on: path, fault.

    ``images`` (path, width, height, sha256), ``actual`` (path, width, height,
    sha256) as the files are now.  A picture without a digest is compared by
    its size alone.
    """
    now = actual.select("path", F.col("width").alias("_w"), F.col("height").alias("_h"), F.lower("sha256").alias("_d"), F.lit(True).alias("_there"))
    fault = (
        F.when(F.col("_there").isNull(), "missing").when(F.col("sha256").isNotNull() & ~F.lower("sha256").eqNullSafe(F.col("_d")), "content_changed")
        .when(~F.col("width").eqNullSafe(F.col("_w")) | ~F.col("height").eqNullSafe(F.col("_h")), "size_changed")
    )
    return images.join(now, "path", "left").select("path", fault.alias("fault")).where("fault is not null")


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order: two independent sums of row hashes, and the count."""
    names = sorted(df.columns)
    text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    rows = df.select(F.xxhash64(text).alias("a"), F.crc32(text).alias("b"), F.hash(text).alias("c"))
    r = rows.agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.sum(F.col("b") * F.col("c").cast("decimal(38,0)")).alias("b")).first()
    return f"{r['n']}-{r['a'] or 0}-{r['b'] or 0}"


class Exports:
    """Previews and starts of exports in a warehouse."""

    def __init__(self, store: Warehouse):
        self.store, self.spark = store, store.spark

    def preview(self, dataset: str, images: DataFrame, objects: DataFrame, formats: list[str], actual: DataFrame | None = None) -> dict:
        """Freezes the snapshot and tells per format what would be lost or refused.

        ``images`` (path, width, height, split, sha256, ...) and ``objects``
        (path, kind, label, bbox, confidence, ...) are the selection.  A
        format nobody knows is blocked; so are all where a source picture has
        changed.
        """
        key = uuid.uuid4().hex
        revision = self.store.publish(f"{dataset}/previews/{key}", {"images": images, "objects": objects}, None)
        frozen = {n: self.store.table(f"{dataset}/previews/{key}", n, revision) for n in ("images", "objects")}
        changed = source_faults(frozen["images"], actual).count() if actual is not None else 0
        known = {f[0] for f in FORMATS}
        found = [r.asDict() for r in preflight(frozen["objects"], frozen["images"]).where(F.col("format").isin(formats)).collect()]  # formats times codes
        plan = {
            "preview": key, "revision": revision, "at": datetime.now(timezone.utc).isoformat(), "images": frozen["images"].count(), "objects": frozen["objects"].count(),
            "digests": {n: content_digest(df) for n, df in frozen.items()},
            "formats": {
                f: [{"code": i["code"], "severity": i["severity"], "rows": i["rows"]} for i in sorted(found, key=lambda i: i["code"]) if i["format"] == f]
                + ([] if f in known else [{"code": "unsupported_format", "severity": "blocking", "rows": 1}])
                + ([{"code": "source_image_unavailable", "severity": "blocking", "rows": changed}] if changed else [])
                for f in dict.fromkeys(formats)
            },
        }
        self.store._create(f"{dataset}/previews/{key}/plan.json", plan)
        return plan

    def plan(self, dataset: str, preview: str) -> dict:
        return self.store._read(f"{dataset}/previews/{preview}/plan.json")

    def start(self, dataset: str, preview: str, acknowledged: dict[str, list[str]]) -> dict:
        """The job of a preview; a second start returns the first one's job, whatever it acknowledges.

        Refused while a format is blocked or a loss or conversion of it is not
        acknowledged.
        """
        job_file = f"{dataset}/previews/{preview}/job.json"
        if self.store.exists(job_file):
            return self.store._read(job_file)
        plan = self.plan(dataset, preview)
        for name, issues in plan["formats"].items():
            if any(i["severity"] == "blocking" for i in issues):
                raise ValueError(f"{name} is blocked")
            missing = {i["code"] for i in issues if i["severity"] in NEEDS_CONSENT} - set(acknowledged.get(name, []))
            if missing:
                raise ValueError(f"{name}: not acknowledged: {', '.join(sorted(missing))}")
        job = {"job": uuid.uuid4().hex, "preview": preview, "snapshot_at": plan["at"], "formats": sorted(plan["formats"]), "acknowledged": acknowledged, "status": "queued"}
        try:
            self.store._create(job_file, job)
        except Conflict:  # another start was faster
            return self.store._read(job_file)
        return job

    def frozen(self, dataset: str, preview: str) -> dict[str, DataFrame]:
        """The tables of a preview, checked against the digests of its plan."""
        plan = self.plan(dataset, preview)
        tables = {n: self.store.table(f"{dataset}/previews/{preview}", n, plan["revision"]) for n in plan["digests"]}
        for name, df in tables.items():
            if content_digest(df) != plan["digests"][name]:
                raise Conflict(f"{dataset}: {name} of preview {preview} has changed")
        return tables
