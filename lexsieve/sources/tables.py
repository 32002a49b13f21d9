"""Tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes up to which a table is dealt to all cores.
SMALL = 64 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table; a small one, whose few row groups would keep few cores busy, dealt evenly. A larger one is
    read as it lies, without a shuffle."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(spark.sparkContext.defaultParallelism) if size <= SMALL else rows
