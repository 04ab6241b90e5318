"""Packing into optimal length buckets.

Documents are cut into segments of at most ``longest`` words, so the histogram of segment lengths has at most that many
rows whatever the corpus. Dynamic programming over it chooses the bucket boundaries with the least padding. Each bucket
holds sequences padded to its boundary; batches of a token budget form inside a bucket in random-key order, numbered by
bucket totals of equal key ranges and a window within each range, so no bucket is gathered in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY_BITS, hash_key, n_words, stage

LONGEST = 2048
BUCKETS = 8
BUDGET = 65536
SEED = 6
RANGE_BITS = 10


def boundaries(counts: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper ends of at most ``buckets`` buckets over lengths >= 1 that minimise the padding, ascending.

    best[b][j] is the least total padded length of the first j distinct lengths in b buckets; ties go to the earliest
    cut. The last boundary is the largest length.
    """
    lengths = np.array(sorted(counts), dtype=np.int64)
    if not len(lengths):
        return []
    total = np.concatenate(([0], np.cumsum([counts[x] for x in lengths.tolist()]))).astype(np.int64)
    n = len(lengths)
    most = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, most, dtype=np.int64)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        after = np.full(n + 1, most, dtype=np.int64)
        cut = np.zeros(n + 1, dtype=np.int64)
        for j in range(1, n + 1):
            costs = best[:j] + (total[j] - total[:j]) * lengths[j - 1]
            cut[j] = int(np.argmin(costs))
            after[j] = costs[cut[j]]
        after[0] = 0
        best = after
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return out[::-1]


def segments(sized: DataFrame, longest: int = LONGEST) -> DataFrame:
    """A row for each segment of a document: seg_no and seg_start (words before it) from 0, and length >= 1."""
    pieces = F.ceil(F.col("size") / longest).cast("int")
    out = sized.where("size > 0").withColumn("seg_no", F.explode(F.sequence(F.lit(0), pieces - 1)))
    start = F.col("seg_no").cast("long") * longest
    return out.withColumn("seg_start", start).withColumn("length", F.least(F.lit(longest).cast("long"), F.col("size") - start))


def pack(sized: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = SEED) -> DataFrame:
    """doc_id, seg_no, seg_start, length, bucket (its padded length), batch_id, slot for each segment.

    A batch holds floor(budget / bucket) sequences of one bucket, at least one; only a bucket's last batch may hold
    fewer. ``sized`` has doc_id and size (long). Null, zero and empty sizes have no segment. Null ids and repeated rows
    are documents like others; equal rows may swap slots, which leaves the same rows. An empty table gives no rows.
    """
    cut = segments(sized.select("doc_id", "size"), longest)
    cut = stage(cut.select("doc_id", "seg_no", "seg_start", "length"), "pack-segments")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `longest` rows
    ends = boundaries(counts, buckets)
    bucket = F.lit(None).cast("long")
    for end in reversed(ends):
        bucket = F.when(F.col("length") <= end, F.lit(end).cast("long")).otherwise(bucket)
    keyed = cut.withColumn("bucket", bucket).withColumn("_key", hash_key(seed, F.col("doc_id"), F.col("seg_no"))).withColumn("_range", F.shiftright("_key", KEY_BITS - RANGE_BITS))
    ranges = keyed.groupBy("bucket", "_range").agg(F.count(F.lit(1)).alias("n"))  # at most buckets * 2^RANGE_BITS rows
    ranges = stage(ranges, "pack-ranges")
    before = ranges.select("bucket", "_range", (F.sum("n").over(Window.partitionBy("bucket").orderBy("_range")) - F.col("n")).alias("_before"))
    inside = Window.partitionBy("bucket", "_range").orderBy("_key", "doc_id", "seg_no", "length")
    place = F.col("_before") + F.row_number().over(inside) - 1
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket")))
    # first batch number of each bucket
    totals = {r["bucket"]: r["n"] for r in ranges.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    base, so_far = F.lit(0).cast("long"), 0
    for end in ends:
        base = F.when(F.col("bucket") == end, F.lit(so_far).cast("long")).otherwise(base)
        so_far += -(-totals.get(end, 0) // max(1, budget // end))
    out = keyed.join(F.broadcast(before), ["bucket", "_range"]).withColumn("_place", place)
    out = out.withColumn("batch_id", base + F.floor(F.col("_place") / each)).withColumn("slot", F.pmod(F.col("_place"), each))
    return out.select("doc_id", "seg_no", "seg_start", "length", "bucket", "batch_id", "slot")


def pack_documents(docs: DataFrame, **how) -> DataFrame:
    """The segments of pack for a table with doc_id and text; sizes are words, other columns, clashing names too, don't
    matter. Null texts and texts without words have no segment."""
    return pack(docs.select("doc_id", n_words(F.col("text")).alias("size")), **how)
