"""Mixing sources to target weights (native): random keys, range buckets of the key, prefix sums, exact cuts.

Each document gets a uniformly random key. Equal ranges of the key are the sort buckets, so the range sort needs no
sampling and no bucket of a hot source is larger than its share. Bucket totals give each bucket's offset within its
source; a window inside (source, bucket) gives the rest of the prefix sum. A source of target t and size s is taken
floor(t / s) times whole, then up to the cut at t - floor(t / s) * s words in key order; the document at the cut gives
its first words only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY_BITS, hash_key, n_words, stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = 20
#: log2 of the key ranges within a source.
RANGE_BITS = 8


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code-point order, null last, have the weights in turn. All targets share ``share`` times the words; a
    target stops at ``most`` times its source's size and the excess goes to the others by weight until none is above:
    with r = most * size / weight ascending, the first k sources are full, where k is the least for which the rest's
    share per weight is at most the next r. The table has a row for each source; ranks are windows over that table.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cases = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("rank", rank).withColumn("weight", cases)
    full = F.lit(most) * F.col("source_size")
    ratio = full / F.col("weight")
    by_ratio = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    level = (
        ranked.withColumn("ratio", ratio)
        .withColumn("before", F.sum(full).over(by_ratio) - full)
        .withColumn("weight_left", F.sum("weight").over(everything) - F.sum("weight").over(by_ratio) + F.col("weight"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("weight_left"))
        # the least k whose level fits the next source
        .withColumn("rate", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
    )
    target = F.when(F.col("rate").isNull(), full.cast("double")).otherwise(F.least(full.cast("double"), F.col("rate") * F.col("weight")))
    return level.select("source", "source_size", target.alias("target"))


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: int = SEED) -> DataFrame:
    """Add source_size, target and taken to a table with doc_id, source and size (long, not null); other columns stay.

    Nulls: a null source is a source of its own, last in order; a null doc_id is a document like others. A source
    without words has target 0. Ties of the key go by doc_id and size; rows equal in both may swap places, which
    leaves the same rows. An empty table gives no rows.
    """
    keyed = sizes.withColumn("_mix_key", hash_key(seed, F.col("doc_id")))
    keyed = keyed.withColumn("_mix_range", F.shiftright("_mix_key", KEY_BITS - RANGE_BITS))
    ranges = stage(keyed.groupBy("source", "_mix_range").agg(F.sum("size").alias("size")), "mix-ranges")
    earlier = Window.partitionBy("source").orderBy("_mix_range")
    targets = source_targets(ranges, weights, share, most).withColumnRenamed("source", "_mix_of")
    cuts = ranges.withColumn("_mix_before", F.sum("size").over(earlier) - F.col("size")).drop("size").join(targets, F.col("source").eqNullSafe(F.col("_mix_of")))
    # read again, so that its size is known to the planner
    cuts = stage(cuts.select(F.col("source").alias("_mix_of"), F.col("_mix_range").alias("_mix_at"), "_mix_before", "source_size", "target"), "mix-cuts")
    keyed = keyed.drop("source_size", "target", "taken")
    joined = keyed.join(cuts, F.col("source").eqNullSafe(F.col("_mix_of")) & (F.col("_mix_range") == F.col("_mix_at")), "left")
    inside = Window.partitionBy("source", "_mix_range").orderBy("_mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("_mix_before") + F.sum("size").over(inside) - F.col("size")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - epochs * F.col("source_size") - before))
    taken = F.when(F.col("size") > 0, epochs * F.col("size") + rest).otherwise(F.lit(0)).cast("long")
    return joined.withColumn("taken", taken).drop("_mix_key", "_mix_range", "_mix_of", "_mix_at", "_mix_before")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixed rows of a documents table, with its columns: each document as often as it is taken whole, and once
    more with its first words where only some are taken. Null texts have no words and aren't taken; no row is kept of
    a document of which nothing is taken. n_chars, where there is one, is that of the new text."""
    columns = docs.columns
    mixed = mix(docs.withColumn("size", n_words(F.col("text"))), **how)
    whole = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    times = F.when(whole > 0, F.array_repeat(F.lit(None).cast("int"), whole)).otherwise(F.array().cast("array<int>"))
    times = F.concat(times, F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = mixed.withColumn("_mix_part", F.explode(times))
    # up to the end of word number _mix_part; one repeated class at a time, as a repeated group would recurse for each word
    with_blanks = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)
    first = F.array_join(F.slice(with_blanks, F.lit(1), F.col("_mix_part")), "")
    rows = rows.withColumn("text", F.when(F.col("_mix_part").isNull(), F.col("text")).otherwise(first))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_mix_part").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*columns)
