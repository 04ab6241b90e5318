"""Shared pieces: the word rule, staged tables in the shared folder, distributed ranks."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these six.
SPACES = "[ \\x09-\\x0D]+"

_own_dir: dict[str, str] = {}
_staged: list[tuple[SparkSession, str]] = []


def words(text: Column) -> Column:
    """Array of a text's words; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, as in tests) one of our own."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    return _own_dir[app]


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/ledgerloom/{name}-{uuid.uuid4().hex[:12]}"
    _staged.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Drop the files of a staged table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/ledgerloom/" in path:
            _delete(df.sparkSession, path)


def done_with(*tables: DataFrame) -> None:
    """Drop staged tables, and the shuffle files of the steps so far: those go when the driver collects their plans."""
    for df in tables:
        unstage(df)
    free_shuffles(tables[0].sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Drop the shuffle files of finished steps."""
    spark.sparkContext._jvm.System.gc()


def staged_so_far() -> int:
    """A mark for unstage_since."""
    return len(_staged)


def unstage_since(mark: int, *kept: str) -> None:
    """Drop the tables staged since the mark, but for those of the names kept."""
    stay = [x for x in _staged[mark:] if x[1].rsplit("/", 1)[-1].rsplit("-", 1)[0] in kept]
    for one in _staged[mark:]:
        if one not in stay:
            _delete(*one)
    _staged[mark:] = stay


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _staged:
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(spark, path)


def hash_key(seed: int, *cols: Column) -> Column:
    """Non-negative 60-bit random key from md5, the same in any SQL engine: substr(md5('seed|a|b'), 1, 15) as hex."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


KEY_BITS = 60

#: Blocks of 256 bits in the filter of ids that are needed, least and most (2 and 8 MB); so many ids a block between them.
FILTER_BLOCKS, MOST_BLOCKS, BLOCK_IDS = 1 << 16, 1 << 18, 16


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of an id, and the two bits that it sets in each of the block's four longs."""
    h = F.xxhash64(key, F.lit(7))
    one = F.lit(1).cast("long")

    def bit(at: int) -> Column:
        return F.call_function("shiftleft", one, F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))

    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), [bit(12 * w).bitwiseOR(bit(12 * w + 6)) for w in range(4)]


def likely_in(rows: DataFrame, needed: DataFrame, key: str, member: bool = True) -> DataFrame:
    """The rows whose key is in ``needed``, and a few more; or else (member=False) all the others.

    A blocked Bloom filter goes to all tasks, so that few other rows are shuffled by the exact join that follows; it grows
    with needed (a staged table) up to MOST_BLOCKS. A null key is as any other here.
    """
    blocks = min(MOST_BLOCKS, max(FILTER_BLOCKS, 1 << (needed.count() // BLOCK_IDS).bit_length()))
    block, words = _bits(F.col(key), blocks)
    names = [f"_w{i}" for i in range(4)]
    bits = needed.select(block.alias("_block"), *[w.alias(n) for n, w in zip(names, words, strict=True)])
    bits = F.broadcast(bits.groupBy("_block").agg(*[F.bit_or(n).alias(n) for n in names]))
    hit = F.lit(True)
    for n, w in zip(names, words, strict=True):
        hit = hit & (F.col(n).bitwiseAND(w) == w)
    met = rows.withColumn("_block", block).join(bits, "_block", "inner" if member else "left")
    return met.where(hit if member else F.coalesce(~hit, F.lit(True))).select(*rows.columns)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="ledgerloom-ship-")) / f"{package.name}-{app}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
