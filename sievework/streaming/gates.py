"""The text gate and the counters over streams: an addition to the batch operators, with the same Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.operators.gates import text_reason
from sievework.operators.relational import split_of


def read(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def gated(rows: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows with reason and split; no state."""
    return rows.withColumns({"reason": text_reason(F.col(text)), "split": split_of(F.col(key).cast("string"))})


def once(rows: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first arrival of each key within the time that state is kept."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(rows: DataFrame, time: str, value: str, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return rows.withWatermark(time, late).groupBy(w, value).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), value, "n"
    )


def start(
    rows: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d,
    available: bool = True, mode: str = "append"
) -> StreamingQuery:
    """Write batches below path, one folder for each batch number, so that a repeated batch replaces itself. mode complete:
    each batch is the whole result, so one folder is left."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    out = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available else out).start()
