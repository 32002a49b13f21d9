"""Screening of unbounded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.plans.screen import Screen


def screen_stream(rows: DataFrame, text: str, screen: Screen) -> DataFrame:
    """rows with matches, flagged, masked and score, by one scan. Stateless: each row as in batch, in append
    mode. masked is empty for a null text."""
    told = "_screened"
    return rows.withColumn(told, screen.verdict(text)).select("*", f"{told}.*").drop(told)


def windowed_score(screened: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Sum of scores by key and tumbling window; rows later than late are dropped, as state must end."""
    return (
        screened.withWatermark(time, late)
        .groupBy(F.window(time, width), key)
        .agg(F.sum("score").alias("score"), F.count("*").alias("n_rows"))
    )
