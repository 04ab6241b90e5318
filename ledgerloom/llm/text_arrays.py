"""Words and shingles of whole batches of texts as numpy arrays (64-bit hashes), without a loop over texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
#: Modular inverse of the base, so that a word's hash does not depend on where it starts.
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Texts are hashed in chunks of this many bytes, for the cache.
CHUNK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _byte_table(fold_case: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if fold_case:
        codes[65:91] += U(32)
    return mix64(codes + U(0x632BE59BD9B4E019))


_TABLES = {True: _byte_table(True), False: _byte_table(False)}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
    return _powers[key]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of each text and the end); null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offs[0] : offs[-1]] if len(offs) else raw, offs - (offs[0] if len(offs) else 0)


def word_hashes(texts: pa.Array, fold_case: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, byte length of each word, first word of each text and the end).

    Words are runs of bytes other than the six ASCII spaces; fold_case lower-cases A-Z.
    """
    raw, offs = buffers(texts)
    n = len(raw)
    solid = ~_SPACE[raw]
    before = np.empty(n + 1, dtype=bool)
    before[:n] = solid
    before[n] = False
    prior = np.empty(n + 1, dtype=bool)
    prior[0] = False
    prior[1:] = solid
    cut = np.zeros(n + 1, dtype=bool)
    cut[offs] = True  # a text's end also ends a word
    starts = np.flatnonzero(before & (~prior | cut))
    ends = np.flatnonzero(prior & (~before | cut))
    hashes = np.empty(len(starts), dtype=np.uint64)
    table = _TABLES[fold_case]
    at = 0
    while at < len(starts):
        base = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        size = int(ends[stop - 1] - base)
        up, down = _power(_BASE, size + 1), _power(_INVERSE, size + 1)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(table[raw[base : base + size]] * up[:size], out=sums[1:])
        s, e = starts[at:stop] - base, ends[at:stop] - base
        hashes[at:stop] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = stop
    return hashes, ends - starts, np.searchsorted(starts, offs)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each text and the end) of the k-word shingles, with repeats; a shorter text is one shingle."""
    counts = np.diff(first)
    spread = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    start = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(spread, out=start[1:])
    rolled = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
    for j in range(k):
        rolled = rolled * _BASE + words[j : j + len(rolled)]
    at = np.repeat(first[:-1], spread) + np.arange(start[-1]) - np.repeat(start[:-1], spread)
    out = np.zeros(int(start[-1]), dtype=np.uint64)
    long = np.repeat(counts >= k, spread)
    out[long] = mix64(rolled[at[long]])
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        h = U(counts[i])
        with np.errstate(over="ignore"):
            for w in words[first[i] : first[i + 1]]:
                h = h * _BASE + w + U(1)
        out[start[i]] = mix64(np.array([h ^ U(0xA5A5A5A5A5A5A5A5)], dtype=np.uint64))[0]
    return out, start


def distinct(values: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, sorted, and where each text's begin."""
    out, counts = [], np.zeros(len(start) - 1, dtype=np.int64)
    for i in range(len(start) - 1):
        part = np.sort(values[start[i] : start[i + 1]])
        if len(part) > 1:
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        out.append(part)
        counts[i] = len(part)
    at = np.zeros(len(start), dtype=np.int64)
    np.cumsum(counts, out=at[1:])
    return (np.concatenate(out) if out else values[:0]), at


def sequence_keys(words: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A 128-bit key of each text's whole word sequence."""
    out = []
    for seed in (U(0x1F83D9ABFB41BD6B), U(0x5BE0CD19137E2179)):
        base = seed | U(1)
        per = np.zeros(len(first) - 1, dtype=np.uint64)
        longest = int(np.diff(first).max(initial=0))
        powers = np.multiply.accumulate(np.concatenate((np.ones(1, dtype=np.uint64), np.full(longest, base, dtype=np.uint64))))
        if len(words):
            place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
            value = mix64(words ^ seed) * powers[place]
            full = np.flatnonzero(np.diff(first))
            per[full] = np.add.reduceat(value, first[:-1][full])
        out.append(mix64(per + np.diff(first).astype(np.uint64) * seed))
    return [x.tobytes() for x in np.stack(out, axis=1)]
