"""Exact top-k by inner product over vector-approximation files.

Each component is quantised to one of CELLS cells, one byte each; boundaries per dimension are quantiles of a bounded
sample. Approximations are packed in blocks of BLOCK vectors; only these meet the query blocks. A scan of the cells
gives a lower and an upper bound of each inner product. Candidates are vectors whose upper bound reaches the kth lower
bound; their exact vectors are then joined in the order of the bounds: first a few of each query, whose kth score tells
which of the others must be read as well, after which the kth result is certain. Of equal vectors only as many rows as
a result can hold take part, those of the smallest ids, as ties go to these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_key, ship, stage

SCALE = 64
TOP = 20
EVERY = 20
#: At most 256: a cell is one byte.
CELLS = 64
BLOCK = 2048
QUERIES = 512
#: Candidate blocks that one task reads for a query block.
STRIDE = 8
#: The largest double within a long: components beyond it are cut to it.
LONG = float(2**63 - 1024)
#: Vectors whose components the cell boundaries are fitted on.
SAMPLE = 4096


def _quantise(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            n = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(n)))
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(pc.fill_null(vectors.flatten(), float("nan")).to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                peak = np.zeros(len(n))
                if len(x):
                    peak[n > 0] = np.maximum.reduceat(np.abs(x), ends[:-1][n > 0])
                fit = np.isfinite(peak)  # false with a null or infinite component
                raw = np.clip(np.nan_to_num(x), -LONG, LONG).astype("<i8")
            rows = [pa.array(n.astype(np.int32)), pa.array(np.clip(np.where(fit, peak, 0), 0, LONG).astype(np.int64)), pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(raw)])]
            whole = pa.RecordBatch.from_arrays([batch.column("vec_id"), *rows], names=["vec_id", "dims", "peak", "v"])
            yield whole.filter(pc.and_(pc.and_(pa.array(fit), pc.is_valid(vectors)), pc.is_valid(batch.column("vec_id"))))

    return run


def _matrix(column: pa.Array | pd.Series, dims: int, kind: str) -> np.ndarray:
    parts = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(parts), dtype=kind).reshape(len(parts), dims)


def boundaries(sample: np.ndarray, cells: int) -> np.ndarray:
    """Lower ends of cells 1, 2, ... in each dimension: integers, as the components are."""
    if not len(sample):
        return np.zeros((cells - 1, sample.shape[1]), dtype=np.int64)
    return np.ceil(np.quantile(sample, np.arange(1, cells) / cells, axis=0)).astype(np.int64)


def approximate(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The cell of each component."""
    out = np.zeros(x.shape, dtype=np.uint8)
    for row in cuts:
        out += x >= row
    return out


def bounds(cell: np.ndarray, cuts: np.ndarray, least: np.ndarray, most: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of each query's product with each vector; least and most: extremes of the dimensions.

    Exact where no sum can pass 2**53; beyond it both go outwards by more than doubles can be wrong."""
    dims = np.arange(cell.shape[1])
    # outer cells end at the block's extremes, and so does a cell that passes them
    low = np.maximum(np.concatenate((least[None], cuts)), least)[cell, dims].astype(np.float64)
    high = np.minimum(np.concatenate((cuts - 1, most[None])), most)[cell, dims].astype(np.float64)
    up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    lower, upper = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    largest = max((float(abs(x).max()) for x in (low, high) if x.size), default=0.0)
    if len(dims) * largest * max(float(up.max(initial=0)), -float(down.min(initial=0))) >= 2**53:
        margin = (up - down) @ np.maximum(np.abs(low), np.abs(high)).T * ((len(dims) + 8) * 2.0**-52)
        lower, upper = lower - margin, upper + margin
    return lower, upper


def _pack(cuts: np.ndarray, kind: str):
    """Blocks of up to BLOCK vectors of a partition: no shuffle, and no vector is in a group with any other."""
    dims = cuts.shape[1]

    def block(part: pd.DataFrame, at: int) -> pd.DataFrame:
        x = _matrix(part["v"], dims, kind)
        kept = {c: [part[c].to_numpy("<i8").tobytes()] for c in ("uid", "vec_id", "copies")}
        extremes = {"least": [x.min(axis=0).astype("<i8").tobytes()], "most": [x.max(axis=0).astype("<i8").tobytes()]}
        return pd.DataFrame({"block": [TaskContext.get().partitionId() << 32 | at], **kept, "cells": [approximate(x, cuts).tobytes()], **extremes})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = None, 0
        for part in batches:
            held = part if held is None else pd.concat((held, part), ignore_index=True)
            while len(held) >= BLOCK:
                yield block(held[:BLOCK], at)
                held, at = held[BLOCK:], at + 1
        if held is not None and len(held):
            yield block(held, at)

    return run


def candidates(blocks: Iterator[tuple], qids: np.ndarray, queries: np.ndarray, cuts: np.ndarray, top: int) -> list[tuple[np.ndarray, ...]]:
    """(uid, vec_id, copies, lower, upper) of each query's possible results; blocks: (uid, vec_id, copies, cells, least, most)."""
    floor = np.full((len(qids), top), -np.inf)  # the highest lower bounds so far
    found: list[list] = [[] for _ in qids]
    for uid, ids, copies, cell, least, most in blocks:
        lower, upper = bounds(cell, cuts, least, most, queries)
        own = ids[None] == qids[:, None]
        lower[own] = upper[own] = -np.inf
        floor = np.partition(np.concatenate((floor, lower), axis=1), -top, axis=1)[:, -top:]
        least_of = floor.min(axis=1)
        for i, mask in enumerate((upper >= least_of[:, None]) & ~own):
            some = np.flatnonzero(mask)
            if len(some):
                found[i].append((uid[some], ids[some], copies[some], lower[i, some], upper[i, some]))
    out = []
    for i, parts in enumerate(found):
        if not parts:
            out.append(())
            continue
        uid, ids, copies, lower, upper = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = upper >= floor[i].min()
        sure = np.flatnonzero(keep & (lower == upper))
        if len(sure) > top:  # scores that are known already: the best of them only, ties to the smaller id
            keep[sure[np.lexsort((ids[sure], -upper[sure]))[top:]]] = False
        out.append((uid[keep], ids[keep], copies[keep], lower[keep], upper[keep]))
    return out


def _scan(cuts: np.ndarray, top: int, kind: str):
    dims = cuts.shape[1]

    def rows(blocks: pd.DataFrame) -> Iterator[tuple]:
        for r in blocks.itertuples(index=False):
            ids = [np.frombuffer(x, dtype="<i8") for x in (r.uid, r.vec_id, r.copies)]
            yield *ids, np.frombuffer(r.cells, dtype=np.uint8).reshape(len(ids[0]), dims), np.frombuffer(r.least, dtype="<i8"), np.frombuffer(r.most, dtype="<i8")

    def run(blocks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["uid", "vec_id", "copies", "lower", "upper"]
        if not len(blocks) or not len(asked):
            return pd.DataFrame({c: pd.Series(dtype="float64" if c in ("lower", "upper") else "int64") for c in ["quid", "query_id", *names]})
        found = candidates(rows(blocks), asked["query_id"].to_numpy(np.int64), _matrix(asked["q"], dims, kind).astype(np.int64), cuts, top)
        n = [len(f[0]) if f else 0 for f in found]
        parts = [f for f in found if f]
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 5
        return pd.DataFrame({"quid": np.repeat(asked["quid"].to_numpy(np.int64), n), "query_id": np.repeat(asked["query_id"].to_numpy(np.int64), n), **dict(zip(names, columns, strict=True))})

    return run


def _scores(dims: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, q = (_matrix(batch.column(c), dims, kind).astype(np.int64) for c in ("v", "q"))
            score = np.einsum("ij,ij->i", v, q)  # right wherever the sum fits a long, whatever passes on the way
            for i in np.flatnonzero(np.abs(np.einsum("ij,ij->i", v.astype(np.float64), q.astype(np.float64))) >= 2**62):
                exact = sum(a * b for a, b in zip(v[i].tolist(), q[i].tolist(), strict=True))
                score[i] = max(-(2**63), min(2**63 - 1, exact))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("quid", "query_id", "vec_id", "copies")), pa.array(score, pa.int64())], names=["quid", "query_id", "vec_id", "copies", "score"])

    return run


def _narrow(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            narrow = pa.array([np.frombuffer(v, dtype="<i8").astype(kind).tobytes() for v in batch.column("v").to_pylist()], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("v"), "v", narrow)

    return run


def top_k(vectors: DataFrame, every: int = EVERY, top: int = TOP, scale: int = SCALE, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` highest inner products of each query with all other rows.

    Components are floor(scale * x). Queries are rows whose vec_id is divisible by ``every``; a candidate is any row
    with another vec_id. Ties go to the smaller vec_id. Vectors that are null, or hold a null or a component that isn't
    finite, and rows with a null vec_id take no part; vectors only meet those of the same length. Components and scores
    beyond a long are cut to it (scores then tie). Repeated vec_ids among candidates are results of their own; a repeated
    query vec_id is asked once for each of its distinct vectors, with ranks of its own. Vectors without components score 0. An empty table gives no rows.
    """
    ship(vectors.sparkSession)
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_quantise(scale), "vec_id long, dims int, peak long, v binary")
    whole = stage(whole.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    out = None
    for row in whole.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max("peak").alias("peak")).orderBy("dims").collect():  # vector lengths
        kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if row["peak"] <= np.iinfo(k).max)
        own = whole.where(F.col("dims") == row["dims"]).select("uid", "vec_id", "v").mapInArrow(_narrow(kind), "uid long, vec_id long, v binary")
        found = _top_of(own, row["dims"], kind, row["n"], every, top, cells)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def _first_of_equal(whole: DataFrame, top: int) -> DataFrame:
    """(uid, vec_id, copies, v): of equal vectors the top + 1 smallest ids, one of them perhaps the query's own."""
    ids = whole.select("uid", "vec_id", F.unhex(F.md5("v")).alias("same")).groupBy("same", "vec_id").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("copies"))
    ids = ids.withColumn("place", F.row_number().over(Window.partitionBy("same").orderBy("vec_id"))).where(F.col("place") <= top + 1)
    return whole.join(ids.select("uid", "copies"), "uid").select("uid", "vec_id", "copies", "v")


def _top_of(whole: DataFrame, dims: int, kind: str, rows: int, every: int, top: int, cells: int) -> DataFrame:
    vectors = stage(_first_of_equal(whole, top), "vectors-distinct")
    sample = vectors.orderBy(hash_key(8, F.col("vec_id"), F.col("uid"))).limit(SAMPLE).select("v").collect()
    cuts = boundaries(_matrix(pd.Series([r["v"] for r in sample], dtype=object), dims, kind), cells)
    blocks = stage(vectors.mapInPandas(_pack(cuts, kind), "block long, uid binary, vec_id binary, copies binary, cells binary, least binary, most binary"), "vector-blocks")
    asked = stage(whole.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.min("uid").alias("quid")).select("quid", F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "queries")

    # each query block meets each slice of candidate blocks; numbers follow the rows, sizes stay
    slices, parts = math.ceil(rows / (BLOCK * STRIDE)), math.ceil(rows / every / QUERIES)
    left = blocks.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = asked.withColumn("part", F.pmod(F.xxhash64("quid"), F.lit(parts)).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    met = left.groupBy("part", "slice").cogroup(right.groupBy("part", "slice")).applyInPandas(_scan(cuts, top, kind), "quid long, query_id long, uid long, vec_id long, copies long, lower double, upper double")

    of_query = Window.partitionBy("quid")
    met = met.withColumn("low_place", F.row_number().over(of_query.orderBy(F.desc("lower")))).withColumn("place", F.row_number().over(of_query.orderBy(F.desc("upper"), "vec_id")))
    kth = F.max(F.when(F.col("low_place") == top, F.col("lower"))).over(of_query)
    kept = met.withColumn("kth", kth).where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
    kept = stage(kept.select("quid", "query_id", "uid", "vec_id", "copies", "upper", "place"), "vector-candidates")

    def exact(pairs: DataFrame) -> DataFrame:
        read = pairs.join(vectors.select("uid", "v"), "uid").join(asked.select("quid", "q"), "quid").select("quid", "query_id", "vec_id", "copies", "v", "q")
        return read.mapInArrow(_scores(dims, kind), "quid long, query_id long, vec_id long, copies long, score long")

    first = stage(exact(kept.where(F.col("place") <= 2 * top)), "vector-scores")
    certain = first.withColumn("at", F.row_number().over(of_query.orderBy(F.desc("score")))).where(F.col("at") == top).select("quid", F.col("score").alias("kth"))
    others = kept.where(F.col("place") > 2 * top).join(certain, "quid").where(F.col("upper") >= F.col("kth")).drop("kth")
    found = first.unionByName(exact(others))
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(top).cast("long")).cast("int"))))
    rank = F.row_number().over(of_query.orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
