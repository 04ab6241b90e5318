"""Token counts by prefix dynamic programming.

For a byte-pair vocabulary the encoding of a prefix ends in exactly one piece that is compatible with the piece before
it, so that the count at every prefix follows from the count at an earlier one: count[i] = count[i - len(piece)] + 1.
No piece of the vocabulary has a blank after another character, or a newline, so texts are cut there into segments
that are encoded independently; the counts of a segment's prefixes are computed once for each distinct segment, and
the counts at the ends of a text's segments are prefix sums. Together they give the exact count at every prefix of the
text: truncation and budget questions are look-ups and need no encoding.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .text_arrays import buffers

LIMIT = 4096
#: Distinct segments whose counts, at every prefix, a Python worker keeps; then it starts anew.
CACHE = 300_000


class PrefixCounter:
    """Counts of pieces at every prefix of a segment, for a sentencepiece BPE model with byte fallback."""

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        self.score = {sp.id_to_piece(i).replace("▁", " "): sp.get_score(i) for i in range(sp.get_piece_size()) if not skip(i)}
        self.longest = max(map(len, self.score))
        if bad := [p for p in self.score if "\n" in p or " " in p.lstrip(" ")]:
            raise ValueError(f"segments can't be cut at blanks and newlines: {bad[:3]}")
        if sp.encode("\n\n", out_type=str)[-2:] != ["<0x0A>", "<0x0A>"] or sp.encode("a  b", out_type=str)[0] != "▁a":
            raise ValueError("the model must keep texts as they are, put a blank before them and fall back to bytes")
        self._fits: dict[tuple[str, str], bool] = {}
        self._cache: dict[str, array] = {}

    def _merged(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i, (x, y) in enumerate(pairwise(parts)):
                s = self.score.get(x + y)
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, before: str, piece: str) -> bool:
        key = (before, piece)
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > CACHE:
                self._fits.clear()
            known = self._fits[key] = self._merged(before + piece) == ([before, piece] if before else [piece])
        return known

    def counts(self, segment: str) -> list[int]:
        """Pieces of each prefix of a segment, from that of length 0 on."""
        score, fits, compatible = self.score, self._fits, self._compatible
        n = len(segment)
        count, last = [0] * (n + 1), [""] * (n + 1)
        for i in range(1, n + 1):
            if segment[i - 1] not in score:  # its bytes; nothing merges across it
                count[i] = count[i - 1] + len(segment[i - 1].encode())
                continue
            for j in range(i - 1, max(-1, i - 1 - self.longest), -1):
                piece = segment[j:i]
                if piece in score:
                    known = fits.get((last[j], piece))
                    if known if known is not None else compatible(last[j], piece):
                        count[i], last[i] = count[j] + 1, piece
                        break
            else:
                raise ValueError(f"no piece ends at {i} of {segment[:50]!r}")
        return count

    def stored(self, segment: str) -> array:
        """counts(), worked out once for each distinct segment."""
        known = self._cache.get(segment)
        if known is None:
            if len(self._cache) >= CACHE:
                self._cache.clear()
            known = self._cache[segment] = array("i", self.counts(segment))
        return known

    def total(self, segment: str) -> int:
        return self.stored(segment)[-1]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(byte each segment starts at, pieces up to each segment's end, first segment of each text and the end, segments).

        Texts get the blank that the model puts before them; bytes count from the batch's start, with that blank.
        """
        texts = pc.fill_null(texts, "")
        shown = pc.replace_substring(texts, "▁", " ")
        shown = pc.if_else(pc.equal(shown, ""), "", pc.binary_join_element_wise(pa.scalar(" "), shown, ""))
        raw, offs = buffers(shown)
        n = len(raw)
        blank, line = raw == 0x20, raw == 0x0A
        start = np.zeros(n, dtype=bool)
        start[1:] = (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1]
        start[offs[:-1][offs[:-1] < n]] = True
        at = np.flatnonzero(start)
        first = np.searchsorted(at, offs)
        ends = np.concatenate((at, [n])).astype(np.int32)
        segs = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(raw))
        coded = segs.dictionary_encode()
        each = np.fromiter(map(self.total, coded.dictionary.to_pylist()), dtype=np.int64, count=len(coded.dictionary))
        sums = np.cumsum(each[coded.indices.to_numpy(zero_copy_only=False)]) if len(at) else np.zeros(0, dtype=np.int64)
        return at, sums, first, segs


_counters: dict[str, PrefixCounter] = {}


def counter(model: str) -> PrefixCounter:
    if model not in _counters:
        _counters[model] = PrefixCounter(model)
    return _counters[model]


class PrefixCounts:
    """The stored counts of one text: answers for any prefix without encoding the text again."""

    def __init__(self, text: str, model: str):
        self.text, self._of = text, counter(model)
        shown = " " + text.replace("▁", " ") if text else ""
        self.starts = [i for i in range(len(shown)) if i == 0 or (shown[i] == " " and shown[i - 1] != " ") or "\n" in (shown[i], shown[i - 1])]
        self._shown = shown
        self.sums = [0]
        for a, b in pairwise([*self.starts, len(shown)]):
            self.sums.append(self.sums[-1] + self._of.total(shown[a:b]))

    def count(self, length: int) -> int:
        """Tokens of the text's first ``length`` characters."""
        if length <= 0 or not self.text:
            return 0
        end = min(length, len(self.text)) + 1  # with the blank before the text
        k = bisect_right(self.starts, end - 1) - 1
        stop = self.starts[k + 1] if k + 1 < len(self.starts) else len(self._shown)
        return self.sums[k] + self._of.stored(self._shown[self.starts[k] : stop])[end - self.starts[k]]

    def truncate(self, budget: int) -> int:
        """The most characters whose prefix has at most ``budget`` tokens."""
        if not self.text or budget <= 0:
            return 0
        k = bisect_right(self.sums, budget) - 1  # whole segments that fit
        if k >= len(self.starts):
            return len(self.text)
        stop = self.starts[k + 1] if k + 1 < len(self.starts) else len(self._shown)
        own = self._of.stored(self._shown[self.starts[k] : stop])
        fit = max(i for i, c in enumerate(own) if self.sums[k] + c <= budget)
        return max(0, self.starts[k] + fit - 1)


def _prefixes(model: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for batch in batches:
            texts = batch.column("text")
            at, sums, first, segs = own.batch(texts)
            n = np.diff(first)
            # segments end where the next one starts, the last of a text where the text does; the blank before it isn't its own
            blank = np.cumsum(n > 0) - (n > 0)
            size = np.cumsum(np.concatenate(([0], pc.fill_null(pc.binary_length(pc.replace_substring(texts, "▁", " ")), 0).to_numpy(zero_copy_only=False))))
            starts = size[:-1] + blank
            row = np.repeat(np.arange(len(n)), n)
            ends = np.append(at[1:], size[-1] + np.count_nonzero(n)) if len(at) else at
            base = np.concatenate(([0], sums))[first[:-1]]
            offsets = pa.array(first.astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (ends - starts[row] - 1, sums - base[row])]
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            fit = size[1:] - size[:-1]  # of texts within the limit, all
            for i in np.flatnonzero(np.concatenate(([0], sums))[first[1:]] - base > limit):
                # the segment in which the limit is passed: its stored counts say where
                k = first[i] + np.searchsorted(sums[first[i] : first[i + 1]] - base[i], limit, side="right")
                before = (sums[k - 1] if k > first[i] else base[i]) - base[i]
                segment = segs[int(k)].as_py()
                inside = max(j for j, n_before in enumerate(own.stored(segment)) if before + n_before <= limit)
                fit[i] = max(0, at[k] - (size[i] + blank[i]) + len(segment[:inside].encode()) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, *lists, pa.array(fit, pa.int64())], names=["doc_id", "n_bytes", "end_byte", "n_tokens", "fit_bytes"])

    return run


def prefix_table(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, end_byte, n_tokens, fit_bytes: the count at the end of every segment of each text, as two
    parallel arrays, and the bytes of the longest prefix, of whole characters, with at most ``limit`` tokens.

    Other budgets are answered in SQL to the end of a segment: the last end_byte whose n_tokens fits; fit_bytes goes on
    inside the segment by the counts that are stored for each of its prefixes. Bytes of segments are those of the text
    with each U+2581 taken as the blank it encodes as; n_bytes is the text's own size. Null and empty texts have empty
    arrays.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_prefixes(model, limit), "doc_id long, n_bytes long, end_byte array<int>, n_tokens array<int>, fit_bytes long")


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_bytes for each row of a table with doc_id and text.

    All are look-ups in the prefix table: n_tokens is the last prefix's count, fit_bytes the bytes of the longest prefix
    within the limit. Counts are those of the library without added tokens. Null and empty texts
    have 0 bytes and tokens; rows are counted one by one, so null or repeated ids need no care. An empty table gives no
    rows.
    """
    total = F.coalesce(F.try_element_at("n_tokens", F.lit(-1)), F.lit(0)).cast("long")
    return prefix_table(docs, model, limit).select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"), "fit_bytes")
