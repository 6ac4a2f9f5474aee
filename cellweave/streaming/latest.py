"""The newest version of every key of a stream of log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Files
from ..sources.shared import shared_dir


def stream_latest(stream: DataFrame, keys: list[str], columns: list[str], order: str = "sequence") -> DataFrame:
    """State is one row a key; the order is by sequence, so late rows are harmless and no watermark is needed."""
    best = F.max(F.struct(order, *columns)).alias("v")
    return stream.groupBy(*keys).agg(best).select(*keys, *(F.col(f"v.{c}").alias(c) for c in [order, *columns]))


def run_to_table(result: DataFrame, path: str | None = None) -> DataFrame:
    """Runs all available input once and returns the result table.

    Executors write each batch's whole result to a folder of its own below ``path`` (a new one in the shared folder if not
    given), beside the query's checkpoint; nothing passes through the driver. A repeated batch overwrites its folder.
    """
    root = path or shared_dir(result.sparkSession, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/result/{number:010d}")

    writer = result.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint")
    writer.foreachBatch(write).start().awaitTermination()
    names = Files(result.sparkSession, root).names("result")
    if not names:
        return result.sparkSession.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in result.schema))
    return result.sparkSession.read.schema(result.schema).parquet(f"{root}/result/{names[-1]}")


def read_log(spark: SparkSession, path: str, schema, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)
