"""Importance resampling towards a target distribution: hashed n-gram counts of corpus and target, log-ratio gains.

DuckDB counts inside each task: SQL unnests the words of a batch, joins them to n-grams with window functions and puts
them into buckets with a registered zlib CRC function. The bucket counts of each document go to Parquet in the shared
folder; Spark adds them up for corpus and target, works out the gains of the buckets (a bounded table) and scores.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ship, stage

BUCKETS, LONGEST, SEED, PERCENT, FEWEST = 10_000, 1, 2024, 10, 20
#: Words after lower-casing A-Z: digits, letters and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that DuckDB gets at once, beyond which a batch is cut (a single text stays whole).
AT_ONCE = 8 << 20


def _sql(longest: int, buckets: int) -> str:
    joined = ["w"] + [" || ' ' || ".join(["w", *[f"lead(w, {k}) OVER one" for k in range(1, n)]]) for n in range(2, longest + 1)]
    grams = " UNION ALL ".join(f"SELECT _row, g{i} AS g FROM windowed WHERE g{i} IS NOT NULL" for i in range(len(joined)))
    return f"""
    WITH texts AS (SELECT _row, doc_id, regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS ws FROM batch),
    words AS (SELECT _row, unnest(ws) AS w, generate_subscripts(ws, 1) AS place FROM texts),
    windowed AS (SELECT _row, {", ".join(f"{x} AS g{i}" for i, x in enumerate(joined))} FROM words{" WINDOW one AS (PARTITION BY _row ORDER BY place)" if longest > 1 else ""}),
    counted AS (SELECT _row, g, count(*) AS n FROM ({grams}) GROUP BY ALL),
    hashed AS (SELECT g, crc(g) % {buckets} AS bucket FROM (SELECT DISTINCT g FROM counted)),
    summed AS (SELECT _row, bucket, sum(n) AS n FROM counted JOIN hashed USING (g) GROUP BY ALL),
    lists AS (SELECT _row, sum(n) AS n, list(bucket ORDER BY bucket) AS bucket, list(n ORDER BY bucket) AS times FROM summed GROUP BY ALL)
    SELECT _row, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(bucket AS INTEGER[]) AS bucket, CAST(times AS INTEGER[]) AS times
    FROM texts LEFT JOIN lists USING (_row)
    """


def _crc(words: pa.Array) -> pa.Array:
    return pa.array([None if w is None else zlib.crc32(w.encode()) for w in words.to_pylist()], pa.int64())


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes, begin, held = [len(x.as_buffer() or b"") for x in batch.column("text")], 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > AT_ONCE:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    yield batch.slice(begin)


def _counted(batches: Iterator[pa.RecordBatch], longest: int, buckets: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    import duckdb
    from duckdb.sqltypes import BIGINT, VARCHAR

    con = duckdb.connect(config={"threads": "1", "temp_directory": ""})
    con.create_function("crc", _crc, [VARCHAR], BIGINT, type="arrow")
    for batch in batches:
        for piece in _pieces(batch):
            con.register("batch", pa.Table.from_batches([piece]))
            yield from con.sql(_sql(longest, buckets)).to_arrow_table().cast(schema).to_batches()
            con.unregister("batch")


def features(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """_row, doc_id, n_words, n_features, bucket, times of (_row, doc_id, text): the buckets of a text's runs of 1 to
    ``longest`` words, ascending, and how often each is hit. A text without words, or null, has none (null lists)."""
    ship(texts.sparkSession)
    whole = texts.select("_row", "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = whole.schema["doc_id"].dataType
    lists = T.ArrayType(T.IntegerType())
    made = T.StructType([T.StructField("_row", T.LongType()), T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("bucket", lists), T.StructField("times", lists)])
    schema = to_arrow_schema(made)
    return whole.mapInArrow(lambda b: _counted(b, longest, buckets, schema), made)


def _totals(counted: DataFrame, name: str) -> DataFrame:
    hits = counted.select(F.explode(F.arrays_zip("bucket", "times")).alias("_h"))
    return hits.groupBy(F.col("_h.bucket").alias("bucket")).agg(F.sum("_h.times").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): floor(1000 * ln of the smoothed share in target over that in corpus) for every bucket."""
    s_all, t_all = (float(x.agg(F.sum("n_features")).first()[0] or 0) for x in (corpus, target))
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(_totals(corpus, "s"), "bucket", "left").join(_totals(target, "t"), "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in "st")
    ratio = (t + 1) * F.lit(s_all + buckets) / ((s + 1) * F.lit(t_all + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _floored(total: Column, n: Column) -> Column:
    return F.call_function("div", total - F.pmod(total, n), n)


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, fewest: int = FEWEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs (doc_id, text), drawn towards target (text).

    weight: floored mean of the gains of a document's features, 0 without any. score: weight plus Gumbel noise of
    sha256(seed:doc_id), so that the highest scores are a draw without replacement. rank: 1, 2, 3, ... of the highest
    percent of the documents with at least ``fewest`` words, equal scores by doc_id, null for the rest.

    Null texts have no features; a null doc_id is written as nothing and comes last among equals. Repeated rows are
    documents of their own. Other columns don't matter, whatever their names. An empty table gives no rows, an empty
    target leaves the smoothing alone. The rank is a range sort: row numbers within ranges, after the sizes of those before.
    """
    row = F.monotonically_increasing_id()  # for the time until counts are written
    counted = stage(features(docs.select(row.alias("_row"), "doc_id", "text"), longest, buckets), "draw-corpus")
    wanted = stage(features(target.select(row.alias("_row"), F.lit(None).cast("int").alias("doc_id"), "text"), longest, buckets), "draw-target")
    gained = stage(gains(counted, wanted, buckets), "draw-gains")
    hits = counted.select("_row", F.explode(F.arrays_zip("bucket", "times")).alias("_h")).select("_row", "_h.*")
    # one row for each of a fixed number of buckets
    sums = hits.join(F.broadcast(gained), "bucket").groupBy("_row").agg(F.sum(F.col("times") * F.col("gain")).alias("_sum"))
    n = F.greatest(F.col("n_features"), F.lit(1).cast("long"))
    weight = _floored(F.coalesce("_sum", F.lit(0).cast("long")), n)
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    slim = counted.select("_row", "doc_id", "n_words", "n_features").join(sums, "_row", "left")
    scored = slim.withColumn("weight", weight).withColumn("score", F.col("weight") + noise).select("doc_id", "n_words", "n_features", "weight", "score")
    return _ranked(stage(scored, "draw-scores"), percent, fewest).select("doc_id", "n_features", "weight", "score", "rank")


def _ranked(scored: DataFrame, percent: int, fewest: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    able = F.col("n_words") >= fewest
    n = scored.where(able).count()
    parts = max(1, min(4096, n // 50_000 + 1), int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stage(scored.where(able).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "draw-ranges")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")  # a row for each range
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    ranked = dealt.join(F.broadcast(before), "_part").withColumn("rank", place.cast("long")).drop("_part", "_before")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
