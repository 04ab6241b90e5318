"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all pairwise interactions in
time linear in a document's features. The model is trained on the driver on a bounded sample of labelled rows (SAMPLE);
its size is fixed by the parameters, and every whole text is scored on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_key, ship
from .text_arrays import U, buffers, distinct, mix64, shingle_hashes, word_hashes

#: Word buckets, factors, and labelled rows that the model is fitted on.
BUCKETS, FACTORS, SAMPLE = 1 << 14, 8, 8000
FOLDS = 5
THRESHOLD = 0.3
SEED = 4
STATISTICS = (
    "words", "characters", "bytes_per_word", "long_words", "short_words", "distinct_words", "distinct_shingles", "lines", "distinct_lines", "words_per_line",
    "digits", "capitals", "symbols", "stops", "other_marks", "beyond_ascii", "n_chars",
)
LINEAR, N = len(STATISTICS), BUCKETS + len(STATISTICS)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_SYMBOLS, _STOPS = _table("#*$%&|<>{}[]\\^~_=+@/"), _table(".!?,;:")
_DIGITS, _CAPITALS = _table("0123456789"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARKS = _table("\"'()-`")
_HIGH = np.zeros(256, dtype=np.int64)
_HIGH[192:] = 1
_NEWLINE = _table("\n")


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return (total[offs[1:]] - total[offs[:-1]]).astype(np.float64)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def features(texts: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, values, first feature of each text and the end): word buckets, then the statistics.

    A word bucket has 1 + log of its count, scaled to length 1 over the text's words; statistics are logarithms of
    sizes and shares. A null text is empty; a null n_chars counts as 0.
    """
    raw, offs = buffers(texts)
    hashes, sizes, first = word_hashes(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(first))
    bucket = (mix64(hashes ^ U(0x3C6EF372FE94F82B)) % U(BUCKETS)).astype(np.int64)
    key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
    rows, cols = key // BUCKETS, key % BUCKETS
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(rows, weights=value * value, minlength=n))
    value = value / np.maximum(norm[rows], 1e-12)

    words = np.diff(first).astype(np.float64)
    bytes_ = np.diff(offs).astype(np.float64)
    shingles, start = shingle_hashes(hashes, first, 5)
    _, unique = distinct(shingles, start)
    _, unique_words = distinct(hashes, first)
    # lines as runs between newlines, compared by the sums of their word hashes in order
    newline = np.concatenate(([0], np.cumsum(_NEWLINE[raw])))
    lines = _sums(_NEWLINE[raw], offs) + (bytes_ > 0)
    starts = np.flatnonzero(_line_starts(raw, offs))
    line_first = np.searchsorted(starts, offs)
    del newline
    line_hash = _line_hashes(raw, starts)
    _, unique_lines = distinct(line_hash, line_first)
    stats = np.stack(
        [
            np.log1p(words) / 5, np.log1p(bytes_) / 8, _ratio(_sums(sizes, first), words) / 6, _ratio(_sums(sizes > 12, first), words), _ratio(_sums(sizes < 3, first), words),
            _ratio(np.diff(unique_words), words), _ratio(np.diff(unique), np.diff(start)), np.log1p(lines) / 3, _ratio(np.diff(unique_lines), lines), np.log1p(_ratio(words, lines)) / 4,
            _ratio(_sums(_DIGITS[raw], offs), bytes_) * 5, _ratio(_sums(_CAPITALS[raw], offs), bytes_) * 5, _ratio(_sums(_SYMBOLS[raw], offs), words), _ratio(_sums(_STOPS[raw], offs), words),
            _ratio(_sums(_MARKS[raw], offs), words), _ratio(_sums(_HIGH[raw], offs), bytes_) * 5, np.log1p(np.maximum(0, pc.fill_null(n_chars, 0).to_numpy(zero_copy_only=False).astype(np.float64))) / 8,
        ],
        axis=1,
    )
    counts = np.bincount(rows, minlength=n)
    at = np.concatenate(([0], np.cumsum(counts + LINEAR)))
    index, out = np.empty(at[-1], dtype=np.int32), np.empty(at[-1], dtype=np.float32)
    place = np.arange(len(rows)) + rows * LINEAR
    index[place], out[place] = cols, value
    tail = (at[1:] - LINEAR)[:, None] + np.arange(LINEAR)
    index[tail], out[tail] = BUCKETS + np.arange(LINEAR), stats
    return index, out, at


def _line_starts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    start = np.zeros(len(raw), dtype=bool)
    start[1:] = raw[:-1] == 0x0A
    start[offs[:-1][offs[:-1] < len(raw)]] = True
    return start


def _line_hashes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    ends = np.concatenate((starts[1:], [len(raw)]))
    lines = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate((starts, [len(raw)])).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
    hashes, _, first = word_hashes(lines, fold_case=False)
    place = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
    total = np.zeros(len(starts), dtype=np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        total[full] = np.add.reduceat(mix64(hashes + place.astype(np.uint64)), first[:-1][full])
    del ends
    return total


class FactorMachine:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def margins(self, index: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The margin of each text by the sum-of-squares identity; every text has a feature at least."""
        start = at[:-1]
        out = self.w0 + np.add.reduceat(self.w[index] * value, start)
        for f in range(self.v.shape[1]):
            vx = self.v[:, f][index] * value
            out += 0.5 * (np.add.reduceat(vx, start) ** 2 - np.add.reduceat(vx * vx, start))
        return out

    def scores(self, index: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(index, value, at), -40, 40)))


def train(index: np.ndarray, value: np.ndarray, at: np.ndarray, labels: np.ndarray, steps: int = 1600, batch: int = 128, rate: float = 0.05, decay: float = 1e-5, seed: int = SEED) -> FactorMachine:
    """Minimise the logistic loss with AdaGrad steps on shuffled batches; the same rows give the same model."""
    rng = np.random.default_rng(seed)
    share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
    w0, w, v = float(np.log(share / (1 - share))), np.zeros(N, dtype=np.float64), rng.normal(0, 0.05, (N, FACTORS))
    g0, gw, gv = 1.0, np.full(N, 1e-2), np.full((N, FACTORS), 1e-2)
    left = steps if len(labels) else 0
    while left > 0:
        order = rng.permutation(len(labels))[: left * batch]
        left -= -(-len(order) // batch)
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            size = (at[1:] - at[:-1])[own]
            start = np.concatenate(([0], np.cumsum(size)))
            flat = np.repeat(at[own] - start[:-1], size) + np.arange(start[-1])
            idx, x = index[flat], value[flat].astype(np.float64)
            row = np.repeat(np.arange(len(own)), size)
            vx = v[idx] * x[:, None]
            sums = np.add.reduceat(vx, start[:-1], axis=0)
            margin = w0 + np.add.reduceat(w[idx] * x, start[:-1]) + 0.5 * (sums**2 - np.add.reduceat(vx * vx, start[:-1], axis=0)).sum(axis=1)
            err = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels[own]) / len(own)
            e = err[row]
            d = float(err.sum())
            g0 += d * d
            w0 -= rate * d / np.sqrt(g0)
            used, where = np.unique(idx, return_inverse=True)
            dw = np.bincount(where, weights=e * x, minlength=len(used)) + decay * w[used]
            gw[used] += dw * dw
            w[used] -= rate * dw / np.sqrt(gw[used])
            grad = (e * x)[:, None] * (sums[row] - vx)
            dv = np.stack([np.bincount(where, weights=grad[:, f], minlength=len(used)) for f in range(FACTORS)], axis=1) + decay * v[used]
            gv[used] += dv * dv
            v[used] -= rate * dv / np.sqrt(gv[used])
    return FactorMachine(w0, w.astype(np.float32), v.astype(np.float32))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        index, value, at = features(batch.column("text"), batch.column("n_chars"))
        rows = range(len(batch))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array([index[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary()), pa.array([value[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary())],
            names=["doc_id", "quality", "index", "value"],
        )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorMachine:
    """A model of labels (doc_id, quality) from at most ``sample`` labelled rows outside the held-out fold.

    The rows are those with the smallest random keys; they join their texts, and only they are turned into features.
    Null labels, ids and labels other than 0 and 1 aren't learnt from; a document labelled twice is two rows. Of several
    texts of one id that with the least hash is learnt from, so that no more than ``sample`` rows reach the driver.
    """
    ship(docs.sparkSession)
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).orderBy(hash_key(SEED, F.col("_id")), "_id", "quality").limit(sample)
    chosen = chosen.withColumn("_label", F.monotonically_increasing_id())
    rows = _sized(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "_label", "quality", "text", "n_chars")
    one = F.min(F.struct(F.xxhash64("text", "n_chars").alias("hash"), "text", "n_chars")).alias("one")
    rows = rows.groupBy("doc_id", "_label", "quality").agg(one).select("doc_id", "quality", "one.text", "one.n_chars")
    got = rows.mapInArrow(_featurise, "doc_id long, quality int, index binary, value binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["quality"], r["index"], r["value"]))
    index = np.frombuffer(b"".join(r["index"] for r in got), dtype=np.int32)
    value = np.frombuffer(b"".join(r["value"] for r in got), dtype=np.float32)
    at = np.concatenate(([0], np.cumsum([len(r["index"]) // 4 for r in got]))).astype(np.int64)
    return train(index, value, at, np.array([r["quality"] for r in got], dtype=np.float64))


def _sized(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.length("text").cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", n_chars.alias("n_chars"))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = FactorMachine(*shared.value)
        for big in batches:
            for at in range(0, len(big), 2000):
                batch = big.slice(at, 2000)
                got = model.scores(*features(batch.column("text"), batch.column("n_chars")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got.astype(np.float64))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: FactorMachine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of a table with doc_id and text.

    Null and empty texts have a score like others, from their statistics. A null doc_id isn't held out. Rows are scored
    one by one, so repeated rows score alike. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.w0, model.w, model.v))  # N * (1 + FACTORS) floats
    out = _sized(docs).mapInArrow(_score(shared), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
