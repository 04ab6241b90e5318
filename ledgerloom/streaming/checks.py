"""Keys and foreign keys of rows that arrive as a stream, with bounded state; the same functions take batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.validate import column_rules, dangling
from ..plans.schema import Table


def first_of_keys(rows: DataFrame, key: tuple[str, ...], time: str, late: str = "10 minutes") -> DataFrame:
    """One row of each key. On a stream, keys are remembered until the watermark has passed their time by ``late``: a
    repeat that comes within that time is dropped, one that comes later counts as new. A batch has one row a key, and
    rows with a null in the key stay in both."""
    whole = F.lit(True)
    for c in key:
        whole &= F.col(c).isNotNull()
    if not rows.isStreaming:
        return rows.where(whole).dropDuplicates(list(key)).unionByName(rows.where(~whole))
    # a null key gets a name of its own, as a stream's deduplication takes nulls for equal
    named = rows.withColumn("__none", F.when(~whole, F.expr("uuid()"))).withWatermark(time, late)
    return named.dropDuplicatesWithinWatermark([*key, "__none"]).drop("__none")


def repeated_keys(rows: DataFrame, key: tuple[str, ...], time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key columns, n): keys that occur n > 1 times within a window of time; on a stream, windows close after the
    watermark, and their counts are dropped then."""
    whole = F.lit(True)
    for c in key:
        whole &= F.col(c).isNotNull()
    counted = rows.where(whole).withWatermark(time, late).groupBy(F.window(time, window).alias("__w"), *key).agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1").select(F.col("__w.start").alias("start"), *key, "n")


def dangling_rows(rows: DataFrame, parents: dict[str, DataFrame], table: Table) -> DataFrame:
    """Rows with a foreign key that no row of the (static) parent tables has, with the keys' columns in ``keys``.

    Each foreign key is an anti join of the stream with its parents; a row that breaks several comes once for each."""
    out = None
    for fk in table.foreign_keys:
        if fk.parent.lower() in parents:
            one = dangling(rows, parents[fk.parent.lower()], fk).withColumn("keys", F.lit(", ".join(fk.columns)))
            out = one if out is None else out.unionByName(one)
    return rows.withColumn("keys", F.lit("")).where("false") if out is None else out


def accepted(rows: DataFrame, parents: dict[str, DataFrame], table: Table) -> DataFrame:
    """Rows that keep every column rule and whose foreign keys all have parents."""
    good = rows
    for fk in table.foreign_keys:
        if (parent := parents.get(fk.parent.lower())) is not None:
            keys = parent.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(fk.parent_columns)]).distinct().withColumn("__found", F.lit(True))
            on, set_ = F.lit(True), F.lit(True)
            for i, c in enumerate(fk.columns):
                on &= F.col(c) == F.col(f"__p{i}")
                set_ &= F.col(c).isNotNull()
            good = good.join(keys, on, "left").where(F.col("__found") | ~set_).select(*rows.columns)
    bad = F.lit(False)
    for c in table.columns:
        for condition in column_rules(good, c).values():
            bad |= F.coalesce(condition, F.lit(False))
    return good.where(~bad)
