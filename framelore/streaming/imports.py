"""Label files judged as they arrive (an extension: the batch operators are the reference behaviour)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from framelore.operators.rejects import judge_lines

LINES = "line_key bigint, import_id string, file_path string, line_no int, line_format string, raw_line string"


def watch_lines(spark: SparkSession, folder: str, catalog: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Judges every new Parquet file of lines under ``folder`` once; appends to ``out``, one folder per micro-batch.

    A batch that is tried again after a failure replaces its own folder, so
    nothing is written twice.
    """

    def each(batch: DataFrame, number: int) -> None:
        judge_lines(batch, catalog).write.mode("overwrite").parquet(f"{out}/batch={number}")

    lines = spark.readStream.schema(LINES).parquet(folder)
    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
