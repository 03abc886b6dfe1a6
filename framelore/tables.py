"""Reading the test tables and cutting lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    ``spark.checkpoint.dir`` as the cluster set it.  Only a local session may
    leave it unset: a temporary folder is then made and set for it.  Executors
    on other machines would not see that folder, so elsewhere this is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="framelore-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _session_dir(spark: SparkSession) -> str:
    """This session's own part of the shared folder."""
    return f"{shared_dir(spark)}/framelore/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs one re-read, and gives the
    next join the true size of its input.  ``unstage`` removes the files of a
    table that nothing reads any more.
    """
    spark = df.sparkSession
    path = f"{_session_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._framelore_path = path
    return out


def stage_counted(df: DataFrame, label: str, flag: str | None = None) -> tuple[DataFrame, int]:
    """``stage``, and the number of rows it wrote; with ``flag``, whether any row has it (1 or 0).

    Counted from the files, so a task that ran twice counts once, and nothing
    waits for events that a busy driver may drop.
    """
    out = stage(df, label)
    return out, out.count() if flag is None else out.where(flag).limit(1).count()


def _remove(spark: SparkSession, path: str) -> None:
    url = urlparse(path)
    if url.scheme in ("", "file"):
        shutil.rmtree(url.path, ignore_errors=True)
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def unstage(df: DataFrame | None) -> None:
    """Remove a staged table.  Only for tables whose readers have all finished."""
    path = getattr(df, "_framelore_path", None)
    if path:
        _remove(df.sparkSession, path)


def clear_stage(spark: SparkSession) -> None:
    """Remove all staged tables of this session, once the results that read them are written; those of other sessions stay."""
    _remove(spark, _session_dir(spark))


def blocks_for(rows: int, per_block: int, least: int = 1) -> int:
    """How many hash blocks hold ``rows`` rows at about ``per_block`` each."""
    return max(least, -(-rows // per_block))
