"""MinHash near-dedup with odd sketches.

Texts with the same word sequence form one class. Of each class, MINHASHES minima of its shingles' hashes are kept two
ways: bands of ROWS minima, for candidates, and an odd sketch, a bitmap in which each (position, minimum) flips one
bit. The number of ones in the XOR of two sketches gives the similarity of similar texts precisely, so that few
candidates need a look at their full sets.

Pairs of a bucket are not all made. First every class meets the leader of its bucket, the class with the most copies.
What that links is joined into components; a second pass takes only buckets that still hold several components, and
only pairs across components whose sketches are near. Each member names its NEAREST partners; of two components the
best pair is confirmed first, the others only if that leaves them apart. Where a member has more partners than it names
and its bucket still holds several components, the members' full sets meet block by block inside tasks, which give only
links that join components. So output grows with the members, not with their pairs, and no pair near by its sketches
is left out. A link is missed only if its estimate is off by more than MARGIN or it shares no band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import likely_in, ship, stage, staged_so_far, unstage_since
from .components import components
from .text_arrays import U, distinct, mix64, sequence_keys, shingle_hashes, word_hashes

K = 5
PERCENT = 85
#: 21 bands of 6: a pair of similarity 0.85 shares a band with probability 0.99995.
BANDS, ROWS = 21, 6
MINHASHES = 252
SKETCH_BITS = 1024
#: Estimates of pairs at the threshold spread by about 0.023 (252 samples and the sketch); three and a half times that.
MARGIN = 0.08
#: Partners that a member of a bucket names; if it has more, the full sets of its block meet.
NEAREST = 8
#: Shingles of the texts that meet at a time; a block of more is dealt in parts of this size.
PART = 1 << 21
#: Members of a bucket that one task compares at a time; larger buckets are compared block by block.
BLOCK = 2048

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 32, MINHASHES, dtype=np.uint64).astype(np.uint32)
_MULTIPLY = (_rng.integers(0, 1 << 32, MINHASHES, dtype=np.uint64).astype(np.uint32)) | np.uint32(1)


def flips_at(similarity: float) -> float:
    """Expected number of ones in the XOR of two odd sketches whose MinHash samples agree at this rate."""
    return SKETCH_BITS / 2 * (1 - np.exp(-4 * MINHASHES * (1 - similarity) / SKETCH_BITS))


def most_flips(percent: int = PERCENT, margin: float = MARGIN) -> int:
    """XOR counts above this are of pairs well below the threshold."""
    return int(np.ceil(flips_at(percent / 100 - margin)))


def signatures(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """MINHASHES minima (32 bits) of each text's shingles; texts without shingles have the largest value."""
    n = len(start) - 1
    out = np.full((n, MINHASHES), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(start))
    if not len(full):
        return out
    x = (values >> U(32)).astype(np.uint32)
    # texts in chunks that stay in the cache
    groups = np.searchsorted(start[full], np.arange(0, len(x), 1 << 16))
    for lo, hi in zip(groups, [*groups[1:], len(full)], strict=True):
        if lo == hi:
            continue
        own = full[lo:hi]
        base, end = start[own[0]], start[own[-1] + 1]
        part, at = x[base:end], start[own] - base
        for k in range(MINHASHES):
            h = (part ^ _XOR[k]) * _MULTIPLY[k]
            h ^= h >> np.uint32(15)
            out[own, k] = np.minimum.reduceat(h, at)
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """Odd sketches as rows of 64-bit words."""
    keys = mix64(sig.astype(np.uint64) | (np.arange(MINHASHES, dtype=np.uint64) << U(32)))
    bits = (keys % U(SKETCH_BITS)).astype(np.int64)
    flat = np.bincount((np.arange(len(sig))[:, None] * SKETCH_BITS + bits).ravel(), minlength=len(sig) * SKETCH_BITS) & 1
    return np.packbits(flat.astype(np.uint8).reshape(len(sig), SKETCH_BITS), axis=1).view(np.uint64)


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15), (len(sig), BANDS)).copy()
        rows = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS).astype(np.uint64)
        for r in range(ROWS):
            h = mix64(h ^ (rows[:, :, r] + U(r) * U(0xD1B54A32D192ED03)))
    return h.view(np.int64)


def _lists(rows: np.ndarray, kind: pa.DataType, keep: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    counts = np.where(keep, width, 0)
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows[keep].ravel().view(np.int64), kind))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for at in range(0, len(big), 1000):
            batch = big.slice(at, 1000)
            own_names = [c for c in batch.schema.names if c != "text"]
            words, _, first = word_hashes(batch.column("text"))
            values, start = distinct(*shingle_hashes(words, first, K))
            keep = np.diff(first) >= K  # shorter texts only match their own sequence
            sig = np.zeros((len(batch), MINHASHES), dtype=np.uint32)
            rows = np.flatnonzero(keep)
            if len(rows):
                spans = np.concatenate([np.arange(start[i], start[i + 1]) for i in rows])
                own = np.concatenate(([0], np.cumsum(np.diff(start)[rows])))
                sig[rows] = signatures(values[spans], own)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in own_names],
                    pa.array(sequence_keys(words, first), pa.binary()),
                    pa.array(np.diff(start), pa.int64()),
                    _lists(band_keys(sig), pa.int64(), keep),
                    _lists(sketches(sig), pa.int64(), keep),
                ],
                names=[*own_names, "cid", "n_shingles", "bands", "sketch"],
            )


def _key_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for at in range(0, len(big), 1000):
            batch = big.slice(at, 1000)
            words, _, first = word_hashes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(sequence_keys(words, first), pa.binary()), batch.column("text")], names=["cid", "text"])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] | None = None
        for big in batches:
            for at in range(0, len(big), 500):
                batch = big.slice(at, 500)
                a = batch.column("a").to_pylist()
                b = batch.column("b").to_pylist()
                words, _, first = word_hashes(batch.column("text_a"))
                sets_a, start_a = distinct(*shingle_hashes(words, first, K))
                fresh = [i for i in range(len(b)) if i == 0 or b[i] != b[i - 1]]
                words, _, first = word_hashes(batch.column("text_b").take(pa.array(fresh)))
                sets_b, start_b = distinct(*shingle_hashes(words, first, K))
                good, k = [], -1
                for i in range(len(a)):
                    if k + 1 < len(fresh) and fresh[k + 1] == i:
                        k += 1
                        last = (b[i], sets_b[start_b[k] : start_b[k + 1]])
                    own = sets_a[start_a[i] : start_a[i + 1]]
                    shared = len(np.intersect1d(own, last[1], assume_unique=True))
                    good.append(100 * shared >= percent * (len(own) + len(last[1]) - shared))
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


class _Block:
    """Members of one bucket that meet: rows of (cid, label, sketch, n, side, bands)."""

    def __init__(self, rows: list, key: int, most: int, percent: int):
        self.most, self.percent = most, percent
        names: dict[bytes, int] = {}
        self.label = np.array([names.setdefault(r[1], len(names)) for r in rows])
        self.labels = len(names)
        self.bits = np.array([r[2] for r in rows], dtype=np.int64).view(np.uint64)
        self.size = np.array([r[3] for r in rows])
        self.side = np.array([r[4] for r in rows])
        self.bands = np.array([r[5] for r in rows], dtype=np.int64)
        # a pair counts in the first band that it shares
        self.band = int(np.flatnonzero(self.bands[0] == key)[0])

    def partners(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Later members of other components whose size and sketch are near member i's, and their flips."""
        # blocks of one bucket meet across, a block by itself once
        other = np.arange(i + 1, len(self.label))
        other = other[(self.label[other] != self.label[i]) & ((self.side[other] != self.side[i]) | (self.side[i] == 2))]
        other = other[np.minimum(self.size[other], self.size[i]) * 100 >= (self.percent - 1) * np.maximum(self.size[other], self.size[i])]
        other = other[~(self.bands[other, : self.band] == self.bands[i, : self.band]).any(axis=1)]
        flips = np.bitwise_count(self.bits[other] ^ self.bits[i]).sum(axis=1)
        return other[flips <= self.most], flips[flips <= self.most]


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list]]:
    """(key, rows) of each group; the rows of a group come together."""
    key, rows = None, []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in (*keys, *columns)]
        for row in zip(*cols, strict=True):
            if row[: len(keys)] != key:
                if rows:
                    yield key, rows
                key, rows = row[: len(keys)], []
            rows.append(row[len(keys) :])
    if rows:
        yield key, rows


_MEMBER = ("cid", "label", "sketch", "n", "side", "bands")


def _cross_pairs(most: int, percent: int):
    """Near pairs across components within each (key, p), rows of which come together: the NEAREST partners of each
    member, of other components each if it has more than that; ``more`` says that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, p), rows in _groups(batches, ("key", "p"), _MEMBER):
            block = _Block(rows, key, most, percent)
            found = []
            for i in range(len(rows) if block.labels > 1 else 0):
                other, flips = block.partners(i)
                more = len(other) > NEAREST
                if more:
                    order = np.argsort(flips, kind="stable")
                    _, first = np.unique(block.label[other[order]], return_index=True)
                    chosen = order[np.sort(first)[:NEAREST]]
                    other, flips = other[chosen], flips[chosen]
                for j, f in zip(other.tolist(), flips.tolist(), strict=True):
                    found.append((*sorted((rows[i][0], rows[j][0])), *sorted((rows[i][1], rows[j][1])), f, key, p, more))
            for at in range(0, len(found), 10000):
                a, b, la, lb, flips, keys, ps, more = zip(*found[at : at + 10000], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x, pa.binary()) for x in (a, b, la, lb)), pa.array(flips, pa.int32()), pa.array(keys, pa.int64()), pa.array(ps, pa.int32()), pa.array(more)],
                    names=["a", "b", "la", "lb", "flips", "key", "p", "more"],
                )

    return run


def _cross_members(most: int, percent: int):
    """Members of each (key, p) with a near partner in another component, dealt in parts of PART shingles: a row for each
    two parts, lo and hi, in which a member has a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, p), rows in _groups(batches, ("key", "p"), _MEMBER):
            block = _Block(rows, key, most, percent)
            if block.labels < 2:
                continue
            part = (np.cumsum(block.size) - block.size) // PART
            meets = np.zeros((len(rows), int(part[-1]) + 1), dtype=bool)
            for i in range(len(rows)):
                other, _ = block.partners(i)
                meets[i, part[other]] = True
                meets[other, part[i]] = True
            member, partner = np.nonzero(meets)
            for at in range(0, len(member), 1000):
                i, c = member[at : at + 1000], partner[at : at + 1000]
                own = part[i]
                cid, label, sketch, n, side, bands = zip(*(rows[x] for x in i), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(np.full(len(i), x), kind) for x, kind in ((key, pa.int64()), (p, pa.int32()))),
                        *(pa.array(x, pa.int32()) for x in (np.minimum(own, c), np.maximum(own, c), own)),
                        *(pa.array(x, pa.binary()) for x in (cid, label)),
                        pa.array(sketch, pa.list_(pa.int64())),
                        pa.array(n, pa.int64()),
                        pa.array(side, pa.int32()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["key", "p", "lo", "hi", "part", *_MEMBER],
                )

    return run


def _cross_links(most: int, percent: int):
    """Links (a, b) that join components of each (key, p, lo, hi), confirmed on the full sets of its members' texts; at
    most one less than its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _, lo, hi), rows in _groups(_with_sets(batches), ("key", "p", "lo", "hi"), (*_MEMBER, "part", "set")):
            block = _Block(rows, key, most, percent)
            sets = [np.frombuffer(r[7], dtype=np.uint64) for r in rows]
            start = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
            values, flat = np.unique(np.concatenate(sets), return_inverse=True)
            part = np.array([r[6] for r in rows])
            root = np.arange(block.labels)  # of each label
            mine = np.zeros(len(values), dtype=bool)
            links = []
            for i in range(len(rows)):
                other, _ = block.partners(i)
                other = other[(lo == hi) | (part[other] != part[i])]
                other = other[root[block.label[other]] != root[block.label[i]]]
                if not len(other):
                    continue
                size = np.diff(start)[other]
                at = np.concatenate(([0], np.cumsum(size)))
                span = np.repeat(start[other] - at[:-1], size) + np.arange(at[-1])
                own = flat[start[i] : start[i + 1]]
                mine[own] = True
                shared = np.add.reduceat(mine[flat[span]].astype(np.int64), at[:-1])
                mine[own] = False
                for j in other[100 * shared >= percent * (len(own) + size - shared)].tolist():
                    one, two = root[block.label[i]], root[block.label[j]]
                    if one != two:
                        root[root == two] = one
                        links.append((rows[i][0], rows[j][0]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*links, strict=True)], names=["a", "b"])

    return run


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the sorted shingle set of each text (bytes of 64-bit hashes) in its place."""
    for big in batches:
        for at in range(0, len(big), 500):
            batch = big.slice(at, 500)
            words, _, first = word_hashes(batch.column("text"))
            values, start = distinct(*shingle_hashes(words, first, K))
            sets = pa.array([values[start[i] : start[i + 1]].tobytes() for i in range(len(batch))], pa.large_binary())
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), sets], names=[*kept, "set"])


def _linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity on their full sets."""
    one = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(_verify(percent), "a binary, b binary")


def _texts_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cid, text) of the classes in the pairs. Only texts whose id is the least of such a class go through Python (an id
    may have other texts too), and few others are shuffled; the join that follows is exact."""
    needed = stage(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), "near-needed")
    least = stage(likely_in(classes, needed, "cid").join(needed, "cid").select(F.col("least").alias("doc_id")), "near-least")
    keyed = likely_in(docs.select("doc_id", "text"), least, "doc_id").select("text").mapInArrow(_key_texts, "cid binary, text string")
    likely = likely_in(keyed, needed, "cid")
    # one text of each class; a class may have many copies, so the first of each is a partial aggregate
    likely = likely.groupBy("cid").agg(F.first("text").alias("text"))
    return stage(likely.join(needed, "cid", "left_semi"), "near-texts")


def _grouped(docs: DataFrame, percent: int, *extra: str) -> DataFrame:
    """doc_id, n_shingles, smallest for each row, and with extra columns (long), those and the label of its component."""
    ship(docs.sparkSession)
    mark = staged_so_far()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)
    passed = "".join(f", {c} long" for c in extra)
    signed = stage(docs.mapInArrow(_sign, f"doc_id long{passed}, cid binary, n_shingles long, bands array<long>, sketch array<long>"), "near-signed")
    # one row for each class: its bands are taken apart where they lie
    whole = signed.groupBy("cid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    whole = stage(whole, "near-classes")
    classes = whole.select("cid", "least", "copies", "n")

    ranked = whole.where(F.size("bands") > 0).select("cid", "copies", F.explode(F.array_distinct("bands")).alias("key"))
    buckets = ranked.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("copies", "cid"))["cid"].alias("leader")).where("members > 1")
    buckets = stage(buckets, "near-buckets")
    followed = stage(ranked.join(buckets, "key"), "near-followed")
    first = followed.where("cid != leader").select(F.col("cid").alias("a"), F.col("leader").alias("b")).distinct()
    wanted = stage(first, "near-pairs")
    members = wanted.select(F.col("a").alias("cid")).union(wanted.select("b")).distinct()
    sketch = stage(whole.select("cid", "sketch", "bands", "n").join(members, "cid", "left_semi"), "near-sketches")
    most = most_flips(percent)
    flips = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    sized = F.least("n_a", "n_b") * 100 >= (percent - 1) * F.greatest("n_a", "n_b")
    near = (
        wanted.join(sketch.drop("bands").toDF("a", "sketch_a", "n_a"), "a")
        .join(sketch.drop("bands").toDF("b", "sketch_b", "n_b"), "b")
        .where(sized & (flips <= most))
        .select("a", "b")
    )
    near = stage(near, "near-pairs")
    links = stage(_linked(near, _texts_of(docs, classes, near), percent), "near-links")
    joined = stage(components(links), "near-components")

    # buckets that still hold several components
    labelled = followed.join(sketch, "cid").join(joined.withColumnRenamed("node", "cid"), "cid", "left")
    labelled = stage(labelled.select("key", "cid", "members", "sketch", "n", "bands", F.coalesce("component", "cid").alias("label")), "near-labelled")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
    mixed = labelled.join(stage(mixed, "near-mixed"), "key")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct((F.least(own, j) * blocks + F.greatest(own, j)).alias("p"), F.when(own == j, 2).when(own < j, 0).otherwise(1).alias("side")))
    dealt = mixed.withColumn("meet", F.explode(meets)).select("key", F.col("meet.p").alias("p"), "cid", "label", "sketch", F.col("n").cast("long").alias("n"), F.col("meet.side").alias("side"), "bands")
    grouped = dealt.repartition("key", "p").sortWithinPartitions("key", "p", "cid")
    named = stage(grouped.mapInArrow(_cross_pairs(most, percent), "a binary, b binary, la binary, lb binary, flips int, key long, p int, more boolean"), "near-crossing")
    tried = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crossing = stage(named.drop("key", "p", "more").join(tried, ["a", "b"], "left_anti"), "near-crossing")
    # of two components first the best pair, then the others of those that it leaves apart
    best = crossing.groupBy("la", "lb").agg(F.min(F.struct("flips", "a", "b")).alias("top"))
    best = stage(best.select("la", "lb", "top.a", "top.b"), "near-best")
    more = stage(_linked(best.select("a", "b"), _texts_of(docs, classes, best), percent), "near-links")
    merged = stage(components(best.join(more, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b"))), "near-merged")
    for side in ("la", "lb"):
        crossing = crossing.join(merged.toDF(side, "_root"), side, "left").withColumn(side, F.coalesce("_root", side)).drop("_root")
    rest = stage(crossing.where("la != lb").select("a", "b").distinct().join(best, ["a", "b"], "left_anti"), "near-pairs")
    rest = stage(_linked(rest, _texts_of(docs, classes, rest), percent), "near-links")
    joined = stage(components(joined.toDF("a", "b").union(more).union(rest)), "near-components")

    # blocks with members that have more partners than they named: their full sets meet
    open_ = stage(named.where("more").select("key", "p").distinct(), "near-open")
    if not open_.isEmpty():
        again = dealt.join(open_, ["key", "p"]).drop("label").join(joined.withColumnRenamed("node", "cid"), "cid", "left")
        again = again.select("key", "p", "cid", F.coalesce("component", "cid").alias("label"), "sketch", "n", "side", "bands")
        again = again.repartition("key", "p").sortWithinPartitions("key", "p", "cid")
        kinds = "key long, p int, lo int, hi int, part int, cid binary, label binary, sketch array<long>, n long, side int, bands array<long>"
        members = stage(again.mapInArrow(_cross_members(most, percent), kinds), "near-members")
        texts = _texts_of(docs, classes, members.select(F.col("cid").alias("a"), F.col("cid").alias("b")))
        met = members.join(texts, "cid").repartition("key", "p", "lo", "hi").sortWithinPartitions("key", "p", "lo", "hi", "cid")
        last = stage(met.mapInArrow(_cross_links(most, percent), "a binary, b binary"), "near-links")
        joined = stage(components(joined.toDF("a", "b").union(last)), "near-components")

    final = classes.join(joined.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "least", F.coalesce("component", "cid").alias("label"))
    smallest = stage(final.groupBy("label").agg(F.min("least").alias("smallest")), "near-smallest")
    label = ["label"] if extra else []
    final = stage(final.join(smallest, "label").select("cid", "smallest", *label), "near-final")
    unstage_since(mark, "near-signed", "near-final")
    return signed.select("doc_id", "cid", "n_shingles", *extra).join(final, "cid").drop("cid")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of a table with doc_id (long) and text.

    A text's set is its distinct 5-word shingles, or its whole sequence if that is shorter. Texts are linked if
    100 * intersection >= percent * union. Null and empty texts have no set and no link. Rows with the same text,
    repeated rows and repeated ids among them, share a component; component_id is its smallest doc_id. Rows with a
    null doc_id link like others; theirs is null only if no id is in their component; kept is false for them.
    """
    out = _grouped(docs, percent)
    group = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("smallest"))
    return out.select("doc_id", "n_shingles", group.alias("component_id"), F.coalesce(F.col("doc_id") == group, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component, and every row whose text is null or has no words, with all columns.

    The row with the smallest doc_id stays, null ids last; among rows of one id, or of none, that with the least hash of
    all its columns. Of rows that are the same in all columns one stays.
    """
    every = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]
    keyed = docs.withColumns({f"_r{i}": F.xxhash64(F.lit(i), *every) for i in (1, 2)})
    mark = staged_so_far()
    rows = _grouped(keyed, percent, "_r1", "_r2")
    rows = rows.groupBy("label", "_r1", "_r2").agg(F.first("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
    rows = stage(rows, "near-rows")
    unstage_since(mark, "near-rows")
    best = rows.where("n > 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_r1", "_r2", "copies")).alias("best"))
    stay = best.select("best._r1", "best._r2", (F.col("best.copies") > 1).alias("_several"))
    stay = stage(stay.union(rows.where("n = 0").select("_r1", "_r2", F.lit(False))), "near-stay")
    alone = keyed.join(stay.where("not _several"), ["_r1", "_r2"], "left_semi")
    several = stay.where("_several")
    one = likely_in(keyed, several, "_r1").join(several, ["_r1", "_r2"], "left_semi").dropDuplicates(["_r1", "_r2"])
    return alone.unionByName(one).select(*docs.columns)
