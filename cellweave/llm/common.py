"""Small column and storage helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a helper table (rules, test windows, filter blocks) up to which it is broadcast; beyond, Spark plans a shuffle join.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Texts of ASCII only take the fast path of lower()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def tokens(text: Column, separator: str) -> Column:
    """The non-empty pieces of a text between separators; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a table for broadcast if its counted rows are within the limit."""
    return F.broadcast(df) if rows <= limit else df


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; where that is unset (tests), below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows written to the shared folder and read again, and where they are."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read again: the lineage ends there, and lost executors cost no recomputation.

    What a result still reads can't be removed here; such folders go with the job's folder in spark.checkpoint.dir.
    """
    return stored_at(df, label)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes stored rows that nothing reads any more."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
