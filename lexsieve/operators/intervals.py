"""Interval operators on rows (key columns, start, end), by running maxima over sorted rows.

Each is one shuffle by key and one sort; none compares rows pairwise. Intervals are half open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _reach(keys: list[str], *order: Column) -> Column:
    """The furthest end of the spans that come first."""
    return F.max("_span_end").over(
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _marked(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in (*keys, "start", "end")]
    left = spans.select(*keys, "start", "end", *none, F.col("end").alias("_span_end"))
    return rows.withColumn("_span_end", F.lit(None).cast("int")).unionByName(left)


def not_contained(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that no single span of the same keys contains."""
    both = _marked(rows, spans, keys)
    reach = _reach(keys, F.asc("start"), F.desc_nulls_last("_span_end"))
    kept = both.withColumn("_reach", reach).filter("_span_end IS NULL AND NOT coalesce(_reach >= end, false)")
    return kept.drop("_reach", "_span_end")


def not_overlapping(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that no span of the same keys overlaps; touching is no overlap."""
    both = _marked(rows, spans, keys).withColumn("_at", F.when(F.col("_span_end").isNull(), F.col("end")).otherwise(F.col("start")))
    reach = _reach(keys, F.asc("_at"), F.asc_nulls_first("_span_end"))
    kept = both.withColumn("_reach", reach).filter("_span_end IS NULL AND NOT coalesce(_reach > start, false)")
    return kept.drop("_reach", "_span_end", "_at")


def collapse_contained(rows: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """The rows that reach beyond all rows before them, by start, longest first, then tie."""
    before = Window.partitionBy(*keys).orderBy("start", F.desc("end"), tie).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_reach", F.max("end").over(before)).filter("_reach IS NULL OR end > _reach").drop("_reach")


def islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping rows as one (start, end); touching ones stay apart."""
    order = Window.partitionBy(*keys).orderBy("start", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = rows.withColumn("_opens", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    numbered = opens.withColumn("_island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")
