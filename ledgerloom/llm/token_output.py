"""Token ids in ORC: integer run-length encoded lists, row indexes and Bloom filters on document ids.

Documents are range-partitioned and sorted by doc_id, encoded in that order and written as they come: files, stripes
and rows are in ascending doc_id order, and each row carries its file's number and its place in it. Readers take
stripes in parallel; a look-up by doc_id prunes files, stripes and row groups by their statistics and Bloom filters.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import ship, stage

END_ID = 1
#: New words encoded as one text, and such texts encoded at a time.
JOINED, TEXTS = 200, 100
OPTIONS = {"orc.create.index": "true", "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(16 << 20), "compression": "snappy"}


def _gather(table: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of a table that begin there and have these sizes, one after the other."""
    sums = np.cumsum(size)
    return table[np.repeat(begin - sums + size, size) + np.arange(sums[-1] if len(sums) else 0)]


class WordEncoder:
    """Encodes texts word by word with a tokenizer whose tokens never cross white space: each distinct word of a batch once.

    Words of letters are encoded many at a time; a token that ends a word says where each one's ids end. A full stop or
    comma behind a word of ASCII letters is a token of its own. Nothing is kept from batch to batch.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(file)
        self.suffix = self.tokenizer.model.end_of_word_suffix
        if not self.suffix:
            raise ValueError("the tokenizer must mark the ends of words")
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith(self.suffix)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each one's)."""
        sizes = np.zeros(len(words), dtype=np.int64)
        pieces: list[np.ndarray] = []
        plain = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        listed, n = words.take(pa.array(order)).to_pylist(), int(plain.sum())
        for at in range(0, n, JOINED * TEXTS):
            groups = [listed[k : min(k + JOINED, n)] for k in range(at, min(at + JOINED * TEXTS, n), JOINED)]
            for g, (some, ids) in enumerate(zip(groups, self._ids([" ".join(x) for x in groups]), strict=True)):
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) != len(some) or stops[-1] != len(ids):  # some word falls into parts, such as one whose lower case is two characters
                    own = self._ids(some)
                    ids, stops = np.concatenate(own), np.cumsum([len(x) for x in own])
                pieces.append(ids)
                sizes[order[at + g * JOINED : at + g * JOINED + len(some)]] = np.diff(stops, prepend=0)
        for at in range(n, len(listed), 1000):
            own = self._ids(listed[at : at + 1000])
            pieces += own
            sizes[order[at : at + 1000]] = [len(x) for x in own]
        flat = np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.int32)
        # back in the order of the words
        there = np.concatenate(([0], np.cumsum(sizes[order])))[:-1]
        begin = np.empty(len(words), dtype=np.int64)
        begin[order] = there
        return _gather(flat, begin, sizes), sizes

    def words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each one's)."""
        marked = pc.match_substring_regex(distinct, "^[A-Za-z]+[.,]$")
        base = pc.if_else(marked, pc.utf8_slice_codeunits(distinct, 0, -1), distinct)
        # lower case is what the tokenizer makes of ASCII words
        base = pc.if_else(pc.match_substring_regex(base, "^[A-Za-z]+$"), pc.ascii_lower(base), base).dictionary_encode()
        at, marked = base.indices.to_numpy(zero_copy_only=False), marked.to_numpy(zero_copy_only=False)
        flat, size = self._learn(base.dictionary)
        own = size[at] + marked
        out = np.zeros(int(own.sum()), dtype=np.int32)
        last = np.cumsum(own)[marked] - 1
        full_stop, comma = (self._ids([m])[0] for m in (".", ","))
        stop = pc.ends_with(distinct, ".").to_numpy(zero_copy_only=False)[marked]
        out[last] = np.where(stop, full_stop[0], comma[0])
        rest = np.ones(len(out), dtype=bool)
        rest[last] = False
        out[rest] = _gather(flat, (np.cumsum(size) - size)[at], size[at])
        return out, own

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of texts: (first text, ids, offsets of each text's ids and the end), each text with the end id."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        offs = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        table, size = self.words(coded.dictionary)
        begin = np.cumsum(size) - size
        words = coded.indices.to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(offs, offs[at] + 200_000, side="right")) - 1)
            stop = min(stop, len(texts), at + 2000)
            own = words[offs[at] : offs[stop]]
            n = size[own]
            sums = np.concatenate(([0], np.cumsum(n)))
            flat = _gather(table, begin[own], n)
            to = sums[offs[at : stop + 1] - offs[at]]
            ends = to + np.arange(len(to))  # with one end id a text
            out = np.full(ends[-1], end_id, dtype=np.int32)
            keep = np.ones(ends[-1], dtype=bool)
            keep[ends[1:] - 1] = False
            out[keep] = flat
            yield at, out, ends
            at = stop


_encoders: dict[str, WordEncoder] = {}


def _encode(file: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if file not in _encoders:
            _encoders[file] = WordEncoder(file)
        seq = 0
        for batch in batches:
            for at, ids, ends in _encoders[file].encode(batch.column("text"), end_id):
                n = len(ends) - 1
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), batch.column("part").slice(at, n), pa.array(np.arange(seq, seq + n)), lists], names=["doc_id", "part", "seq", "ids"])
                seq += n

    return run


def write_tokens(docs: DataFrame, path: str, file: str, end_id: int = END_ID) -> None:
    """Write the ids of every text as ORC: doc_id, part (file number), seq (row in the file) and ids.

    Null texts are empty: they have the end id only. Null doc_ids come first; rows with equal ids keep any order, which
    part and seq record. An empty table gives files without rows.
    """
    ship(docs.sparkSession)
    order = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows = order.withColumn("part", F.spark_partition_id()).mapInArrow(_encode(file, end_id), "doc_id long, part int, seq long, ids array<int>")
    rows.write.options(**OPTIONS).orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        data = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        offs = lists.offsets.to_numpy()
        crc = [zlib.crc32(data[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("seq"), pa.array(np.diff(offs).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "seq", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, part int, seq long, ids array<int>").orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files; start counts the ids of all before it."""
    ship(spark)
    rows = stage(read_tokens(spark, path).mapInArrow(_digest, "doc_id long, part int, seq long, n_tokens long, ids_crc32 long"), "token-index")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("_before") + F.sum("n_tokens").over(inside) - F.col("n_tokens")
    return rows.join(F.broadcast(before), "part").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")
