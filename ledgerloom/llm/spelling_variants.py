"""Grouping of spelling variants: rare-first bigram prefix filter, position limits, exact check of one edit.

Words that differ by one edit keep all but two of their bigrams, so the three rarest of each (by one order of all
bigrams: frequency, then bigram, then position) have one in common, at the same place before or after the edit. As the
edit lies on one side of that bigram, the other side is the same to the end of the word: pairs are joined on the
bigram with everything to its left, or with everything to its right, and on lengths that differ by at most one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stage

SHORTEST, FEWEST, RATIO, DAMAGED_EVERY = 6, 5, 5, 199
#: Bigrams kept of each word: one edit spoils two at most.
RAREST = 3
#: Distinct words that a task holds before it hands their counts on.
HELD = 200_000


def _counted(batches: Iterator[pa.RecordBatch], shortest: int, every: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task's texts, in parts of at most HELD words and those of one text."""
    # runs below the least length can't become longer; a run is taken whole or not at all
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            raw = text.as_buffer()
            if raw is None:
                continue
            head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            # bytes.lower() changes A-Z only
            for word, n in Counter(runs.findall(raw.to_pybytes().lower().decode())).items():
                h = zlib.crc32(word.encode(), head)
                if h % every == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < shortest:
                        continue
                counts[word] += n
            if len(counts) > HELD:
                yield out()
    yield out()


def word_counts(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, every: int = DAMAGED_EVERY) -> DataFrame:
    """(word, n) of all words with at least ``shortest`` code points and ``fewest`` occurrences in doc_id, text."""
    ship(docs.sparkSession)
    parts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda b: _counted(b, shortest, every), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def _sides(words: DataFrame) -> DataFrame:
    """(word, n, size, side, part): each word with its rarest bigrams, once with all to the left and once to the right."""
    at = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("at")
    grams = words.select("word", "n", F.char_length("word").alias("size")).select("*", at).withColumn("gram", F.substring("word", F.col("at"), F.lit(2)))
    # at most 90 letters, so at most 8,100 bigrams
    often = F.broadcast(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often")))
    rank = F.row_number().over(Window.partitionBy("word").orderBy("often", "gram", "at"))
    rare = grams.join(often, "gram").withColumn("rank", rank).where(F.col("rank") <= RAREST)
    left = F.struct(F.lit("l").alias("side"), F.substring("word", F.lit(1), F.col("at") + 1).alias("part"))
    right = F.struct(F.lit("r").alias("side"), F.substring("word", F.col("at"), F.col("size")).alias("part"))
    return rare.select("word", "n", "size", F.explode(F.array(left, right)).alias("_s")).select("word", "n", "size", "_s.side", "_s.part")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): every pair of different words of (word, n) that one inserted, deleted or replaced code point
    tells apart, once, the shorter first (of equal lengths the smaller)."""
    sides = stage(_sides(words), "spelling-sides")
    short = sides.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "side", "part", F.col("size").alias("size_a"), F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("size"))
    long = sides.select(F.col("word").alias("b"), F.col("n").alias("n_b"), "side", "part", "size")
    met = short.join(long, ["side", "part", "size"]).where((F.col("size") > F.col("size_a")) | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b", "n_a", "n_b").distinct()


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) from (word, n), n at least 1.

    form is the near word of largest n (of equal ones the smallest by code points), if that is at least ratio * n, else
    null; root follows forms to the last. As n grows by the ratio with each step, paths are short: a path of k steps
    needs a word with ratio^k occurrences, and each round doubles the steps that are behind.
    """
    pairs = stage(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")).union(pairs.select("b", "a", "n_a"))
    best: Column = F.min(F.struct((-F.col("n_other")).alias("minus"), F.col("other")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    found = words.join(near, "word", "left").withColumn("_takes", -F.col("_best.minus") >= ratio * F.col("n"))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("_takes"), F.col("_best.other")).alias("form"), F.when(F.col("_takes"), -F.col("_best.minus")).alias("form_n"))
    found = stage(found, "spelling-forms")
    links = stage(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-links")
    most = found.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(math.log(most, max(2, ratio)) + 1)) if most > 1 else 0):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = stage(links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "spelling-links")
    return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Words of a table with doc_id and text, with their variants: word, n, n_near, form, form_n, root.

    A null text has no words, an empty one neither; a null doc_id is written as nothing in the text that decides about
    damage. Repeated rows count as often as they occur. Other columns don't matter, whatever their names. No words
    give no rows. Texts are read whole; a task holds the counts of at most HELD words and of one text.
    """
    return variants(stage(word_counts(docs), "spelling-words"))
