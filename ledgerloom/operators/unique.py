"""Unique columns and column sets without redraw loops: duplicates are numbered and take the free slots of their family.

A family is what the duplicates share: the text before a suffix, or the other columns of the set. Its slots are numbers
from 0 on, some of them taken by values that stay. The j-th duplicate takes the j-th free slot, which is j plus the
number of taken slots t_i (i from 0 on, ascending) with t_i - i <= j: a running count over both, no search.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a running count is one window by key; beyond it, keys are cut into ranges of about so many rows.
PER_TASK = 1_000_000


class ExpansionError(ValueError):
    """The plan can't be turned into rows."""


class Exhausted(ExpansionError):
    """There are fewer values than rows."""


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder of the cluster (a folder of our own where none is set, as in tests)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="ledgerloom-"))
    return df.checkpoint()


def running(df: DataFrame, keys: list[str], order: list[str], amount: Col, name: str, per_task: int = PER_TASK) -> DataFrame:
    """Add the sum of amount over the rows of the same keys (nulls are equal) that come before in the order.

    Beyond per_task rows the table is range-sorted by keys and order, so that a key with most of the rows is spread over
    many tasks: each range sums its own part, and a row for each key and range carries what the ranges before it have.
    """
    rows = df.count()
    if rows <= per_task:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(amount).over(before), F.lit(0)).cast("long"))
    dealt = cut(df.withColumn("__amount", amount.cast("long")).repartitionByRange(-(-rows // per_task), *keys, *order).withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy(*keys, "__part").agg(F.sum("__amount").alias("__own"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("__part").alias("__at"), F.coalesce(F.sum("__own").over(earlier), F.lit(0)).alias("__base"))
    same = F.col("__part") == F.col("__at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    inside = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(parts, same).withColumn(name, (F.col("__base") + F.coalesce(F.sum("__amount").over(inside), F.lit(0))).cast("long"))
    return out.select(*df.columns, name)


def allocate(waiting: DataFrame, taken: DataFrame, keys: list[str], order: list[str], per_task: int = PER_TASK) -> DataFrame:
    """waiting with __slot: each row, in order, the next slot of its family that is not in taken (keys, slot; distinct).

    Families are equal keys, nulls included."""
    numbered = running(waiting, keys, order, F.lit(1), "__j", per_task)
    names = [f"__f_{k}" for k in keys]
    families = waiting.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).distinct()
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same &= F.col(k).eqNullSafe(F.col(n))
    held = running(taken.join(families, same, "left_semi"), keys, ["slot"], F.lit(1), "__i", per_task)
    held = held.withColumn("__j", F.col("slot") - F.col("__i")).withColumn("__row_waits", F.lit(0))
    both = numbered.withColumn("__row_waits", F.lit(1)).unionByName(held.select(*keys, "__j", "__row_waits"), allowMissingColumns=True)
    both = running(both, keys, ["__j", "__row_waits"], 1 - F.col("__row_waits"), "__passed", per_task)
    return both.where("__row_waits = 1").withColumn("__slot", F.col("__j") + F.col("__passed")).select(*waiting.columns, "__slot")


def _suffixed(x: Col) -> tuple[Col, Col]:
    """(local, host) of a value: a suffix goes before the @ of an address."""
    address = x.contains("@") & ~x.contains(" ")
    return F.when(address, F.substring_index(x, "@", 1)).otherwise(x), F.when(address, F.substr(x, F.instr(x, "@"))).otherwise(F.lit(""))


def suffix_unique(df: DataFrame, column: str, order: str, max_length: int | None = None, per_task: int = PER_TASK, within: list[str] | None = None) -> DataFrame:
    """Later occurrences of a value (in order) get ``-2``, ``-3``, ... before the @ of an address; numbers that would give
    a value of another row are passed over.

    Where suffix and value don't fit max_length, the value is cut, and all values that are cut to the same text share its
    numbers. Nulls stay. Raises Exhausted when there is no room for all; nothing is longer than max_length unless it was.
    With ``within``, rows that repeat all those columns (column among them) are the occurrences, and others stay.
    Work goes in one round for values that needn't be cut, and one more for each number of digits of those that must.
    """
    x = F.col(column)
    marked = running(df, within or [column], [order], F.lit(1), "__n", per_task)
    again = F.col("__n") > 0
    for c in within or [column]:
        again &= F.col(c).isNotNull()
    if not marked.where(again).limit(1).count():
        return df
    marked = cut(marked)
    local, host = _suffixed(x)
    kept = marked.where(~again).drop("__n")
    waiting = marked.where(again).drop("__n").withColumns({"__local": local, "__host": host})
    room = F.lit(18) if max_length is None else F.least(F.lit(18), max_length - 1 - F.char_length("__local") - F.char_length("__host"))
    waiting = waiting.withColumn("__room", F.greatest(room, F.lit(0)))
    taken = kept.where(x.isNotNull()).select(x.alias("__value")).distinct()
    done: list[DataFrame] = []
    for digits in [0, *range(1, min(18, max_length or 0))]:  # 0: as many as fit behind the whole value
        if not digits:
            stem, base, end = F.col("__local"), F.lit(2), F.pow(F.lit(10.0), "__room").cast("long")
            able = F.col("__room") > 0
        else:
            base, end = F.lit(max(2, 10 ** (digits - 1))), F.lit(10**digits)
            left = max_length - 1 - digits - F.char_length("__host")
            stem = F.substring("__local", F.lit(1), F.greatest(left, F.lit(0)))
            able = (F.col("__room") < digits) & (left >= F.when(F.col("__host") == "", 0).otherwise(1))
        of_value, value_host = _suffixed(F.col("__value"))
        number = F.regexp_extract(of_value, "-([1-9][0-9]{0,17})$", 1)
        held = taken.withColumns({"__number": number, "__of": of_value, "__host": value_host}).where("__number <> ''")
        held = held.select(F.expr("substring(__of, 1, char_length(__of) - char_length(__number) - 1)").alias("__stem"), "__host", (F.col("__number").cast("long") - base).alias("slot"), F.char_length("__number").alias("__digits"))
        held = held.where("slot >= 0").where(F.col("__digits") == digits if digits else F.lit(True)).select("__stem", "__host", "slot")
        tried = waiting.where(able).withColumn("__stem", stem)
        placed = cut(allocate(tried, held, ["__stem", "__host"], [column, order], per_task))
        fits = F.col("__slot") + base < end
        new = placed.where(fits).withColumn(column, F.concat("__stem", F.lit("-"), (F.col("__slot") + base).cast("string"), "__host"))
        done.append(new.select(*df.columns))
        taken = taken.unionByName(new.select(x.alias("__value")))
        rest = waiting.where(~able).unionByName(placed.where(~fits).drop("__slot", "__stem"))
        if not rest.limit(1).count():
            break
        waiting = cut(rest)
    else:
        raise Exhausted(f"{column}: {waiting.count()} rows are left without a distinct value within {max_length} characters")
    out = kept.select(*df.columns)
    for part in done:
        out = out.unionByName(part)
    return out


def set_unique(df: DataFrame, columns: list[str], order: str, slots: int, to_slot: Col, from_slot: Callable[[DataFrame, str], DataFrame], seed: int = 0, per_task: int = PER_TASK) -> DataFrame:
    """Rows whose columns repeat those of an earlier row get another value in the last one.

    The last column has ``slots`` values; to_slot is the number of the value that a row has (null: none of them), and
    from_slot(df, name) sets the column from the slots in df's column of that name. The free slots are gone through from
    a place that depends on the other columns, so that repairs are spread over the values. Rows with a null never repeat.
    Raises Exhausted when a family has more rows than there are values.
    """
    others, last = columns[:-1], columns[-1]
    whole = F.lit(True)
    for c in columns:
        whole &= F.col(c).isNotNull()
    counted = running(df.where(whole), columns, [order], F.lit(1), "__n", per_task)
    if not counted.where("__n > 0").limit(1).count():
        return df
    counted = cut(counted.withColumn("__from", to_slot.cast("long")))
    turn = F.lit(0).cast("long")
    if others:
        text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in others])
        turn = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") % slots
    kept = counted.where("__n = 0")
    keys = others or ["__all"]
    everything = {} if others else {"__all": F.lit(1)}
    taken = kept.withColumns(everything).where(F.col("__from").between(0, slots - 1)).select(*keys, F.pmod(F.col("__from") - turn, F.lit(slots)).alias("slot"))
    placed = allocate(counted.where("__n > 0").withColumns(everything), taken, keys, [order], per_task)
    placed = cut(placed)
    if placed.where(F.col("__slot") >= slots).limit(1).count():
        raise Exhausted(f"UNIQUE ({', '.join(columns)}): {slots} values of {last} are too few — widen the range or lower the number of rows")
    moved = from_slot(placed.withColumn("__to", F.pmod(F.col("__slot") + turn, F.lit(slots))), "__to")
    return df.where(~whole | whole.isNull()).unionByName(kept.select(*df.columns)).unionByName(moved.select(*df.columns))


def permuted(position: Col, size: int, seed: str) -> Col:
    """A keyed permutation of 0 .. size - 1 at a position below size: four rounds of a Feistel network over the least
    even number of bits that holds size. A value outside is sent on along its cycle, which leads inside at last; the
    chance that a walk is longer than the 256 steps made here is below 1e-31.

    No sort, no state: each row works out its own value, in any partition.
    """
    bits = max(1, -(-max(1, size - 1).bit_length() // 2))
    mask = (1 << bits) - 1

    def once(v: Col) -> Col:
        left, right = F.shiftright(v, bits), v.bitwiseAND(F.lit(mask))
        for r in range(4):
            mixed = F.xxhash64(F.lit(f"{seed}|{r}"), right).bitwiseAND(F.lit(mask))
            left, right = right, left.bitwiseXOR(mixed)
        return F.shiftleft(left, bits).bitwiseOR(right)

    start = F.transform(F.array(position.cast("long")), once)[0]
    # one fold, which stays where it is once inside
    return F.aggregate(F.sequence(F.lit(1), F.lit(256)), start, lambda v, _: F.when(v < size, v).otherwise(F.transform(F.array(v), once)[0]))
