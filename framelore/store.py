"""Published datasets: immutable revisions, a pointer that only moves forward, and the documents of a project.

A revision is a folder of Parquet tables.  Publishing writes the folder first
and claims the next pointer last; a pointer file is created, never
overwritten, so of two writers that start from one base one fails
(optimistic concurrency) and readers never see a half-written revision.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVISION = re.compile(r"import-[0-9a-f]{32}")


class Conflict(Exception):
    """The base has moved since it was read."""


class Warehouse:
    """Revisions and pointers of named datasets under a root folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _create(self, name: str, body: dict) -> None:
        """Creates a file that must not exist yet."""
        try:
            out = self._fs.create(self._path(f"{self.root}/{name}"), False)
        except Exception as e:
            raise Conflict(name) from e
        out.write(bytearray(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()))
        out.close()

    def exists(self, name: str) -> bool:
        return bool(self._fs.exists(self._path(f"{self.root}/{name}")))

    def _read(self, name: str) -> dict:
        """A small JSON file, read by the driver itself: no job."""
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode())
        finally:
            stream.close()

    def pointers(self, dataset: str) -> list[dict]:
        """All pointers of a dataset, oldest first."""
        return [self._read(f"{dataset}/pointers/{n}") for n in self._names(f"{dataset}/pointers") if n.endswith(".json")]

    def current(self, dataset: str) -> dict | None:
        names = [n for n in self._names(f"{dataset}/pointers") if n.endswith(".json")]
        return self._read(f"{dataset}/pointers/{names[-1]}") if names else None

    def publish(self, dataset: str, tables: dict[str, DataFrame], base: str | None, note: dict | None = None, token: str | None = None) -> str:
        """Writes the tables as a new revision and moves the pointer, if ``base`` is still current.

        A ``token`` that was published before returns its revision and writes
        nothing, so a repeated commit is harmless.
        """
        token_file = f"{dataset}/tokens/{hashlib.sha256(token.encode()).hexdigest()}.json" if token else None
        if token_file and self.exists(token_file):
            return self._read(token_file)["revision"]
        now = self.current(dataset)
        if (now or {}).get("revision") != base:
            raise Conflict(f"{dataset}: base {base} is not current")
        revision = f"import-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{dataset}/revisions/{revision}/{name}")
        number = len(self._names(f"{dataset}/pointers"))
        pointer = {"revision": revision, "parent": base, "number": number, "at": datetime.now(timezone.utc).isoformat(), "token": token, "note": note or {}}
        self._create(f"{dataset}/pointers/{number:08d}.json", pointer)
        if token_file:
            self._create(token_file, {"revision": revision})
        return revision

    def table(self, dataset: str, name: str, revision: str | None = None) -> DataFrame:
        """A table at a revision, the current one by default."""
        revision = revision or (self.current(dataset) or {}).get("revision")
        if not revision or not REVISION.fullmatch(revision):
            raise ValueError(f"no such revision of {dataset}: {revision}")
        return self.spark.read.parquet(f"{self.root}/{dataset}/revisions/{revision}/{name}")

    def history(self, dataset: str) -> list[dict]:
        """The chain from the current revision back to the first; a broken or circular chain ends it."""
        by = {p["revision"]: p for p in self.pointers(dataset)}
        at, out, seen = (self.current(dataset) or {}).get("revision"), [], set()
        while at in by and at not in seen:
            seen.add(at)
            out.append(by[at])
            at = by[at]["parent"]
        return out


def image_index(images: DataFrame, path: str, files: int = 8) -> None:
    """The browsing index: pictures range-partitioned and sorted by position, so a page reads one file's row groups."""
    images.repartitionByRange(files, "position").sortWithinPartitions("position").write.parquet(path)


def mask_assets(masks: DataFrame) -> DataFrame:
    """Distinct masks by the digest of their canonical text: digest, body, uses."""
    body = F.to_json(F.struct("encoding", "tile_size", "tiles"))
    return masks.withColumn("body", body).groupBy(F.sha2("body", 256).alias("digest")).agg(F.any_value("body").alias("body"), F.count("*").alias("uses"))


def broken_assets(assets: DataFrame) -> DataFrame:
    """Assets whose body no longer has the digest it is stored under."""
    return assets.where(F.sha2("body", 256) != F.col("digest")).select("digest")
