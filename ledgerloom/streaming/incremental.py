"""Structured Streaming extras: row rules and windowed counts over a stream of events, with late data dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.validate import column_rules
from ..plans.schema import Table


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n): events in tumbling windows; on a stream, windows close after the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), F.col(key)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def broken_rows(rows: DataFrame, table: Table) -> DataFrame:
    """Rows of a batch or stream that break a column rule, with the names of the rules."""
    found = [F.when(bad, F.lit(f"{c.name}:{rule}")) for c in table.columns for rule, bad in column_rules(rows, c).items()]
    return rows.withColumn("rules", F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")).where(F.size("rules") > 0)
