"""Importance resampling and spelling variants against brute force, nulls, ties, repeated rows and clashing columns included."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import importance_sampling, spelling_variants

SCHEMA = "doc_id long, text string"


def low(text):
    return (text or "").encode().lower().decode()


def drawn(rows, target, longest, buckets, percent, fewest):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def hits(text):
        w = pattern.findall(low(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    docs, aims = [hits(t) for _, t in rows], [hits(t) for t in target]
    s, t = Counter(x for _, d in docs for x in d), Counter(x for _, d in aims for x in d)
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for (doc, _), (n, d) in zip(rows, docs, strict=True):
        weight = sum(gain[b] for b in d) // len(d) if d else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(d), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((o for o in out if o[5] >= fewest), key=lambda o: (-o[3], o[0] is None, o[0] or 0, o[1], o[2]))
    for i, o in enumerate(able[: percent * len(able) // 100]):
        o[4] = i + 1
    return Counter(tuple(o[:5]) for o in out)


def texts():
    rng = random.Random(3)
    lexicon = ["".join(rng.choice("abcdeéñ日") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    rows = [(i, " ".join(rng.choice(lexicon) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, rows[5][1]), (None, None), (7, rows[7][1]), (202, "A\x00b C-D_e 12.5 " * 9), (203, " ".join(rng.choice(lexicon) for _ in range(70_000)))]
    return rows, [rows[9][1], None, "ab cd " * 20]


@pytest.mark.parametrize("longest", [1, 3])
def test_draw_towards_a_target(spark, longest):
    rows, target = texts()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("weight", F.lit("clash")).withColumn("rank", F.lit(0)).repartition(5)
    aims = spark.createDataFrame([(t,) for t in target], "text string").withColumn("bucket", F.lit(1))
    out = importance_sampling.resample(docs, aims, longest=longest, percent=30)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = Counter(map(tuple, out.collect()))
    assert got == drawn(rows, target, longest, 10_000, 30, 20)
    assert sum(r[4] is not None for r in got) > 20


def test_draw_from_nothing_and_towards_nothing(spark):
    none, docs = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "one two"), (2, None)], SCHEMA)
    assert importance_sampling.resample(none, docs).count() == 0
    got = Counter(map(tuple, importance_sampling.resample(docs, none, percent=100, fewest=1).collect()))
    assert got == drawn([(1, "one two"), (2, None)], [], 1, 10_000, 100, 1)


def edits_of_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    return any(a[:i] + a[i + (len(a) == len(b)) :] == b[:i] + b[i + 1 :] for i in range(len(b)))


def grouped(n):
    near = {w: [v for v in n if edits_of_one(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w, f in form.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n[w], len(near[w]), f, f and n[f], root))
    return out


def test_variants_of_all_near_words(spark):
    rng = random.Random(8)
    words = {}
    for _ in range(60):  # few letters, so that bigrams repeat within a word
        w = "".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))
        words[w] = rng.choice([5, 30, 31, 160, 900])
        for _ in range(5):
            at, x = rng.randrange(len(w)), rng.choice("abéÿ")
            words[rng.choice([w[:at] + x + w[at + 1 :], w[:at] + x + w[at:], w[:at] + w[at + 1 :], w + x])] = rng.choice([5, 6, 30, 200])
    words = {w: n for w, n in words.items() if len(w) >= 6}
    words |= {f"chain{'abcdefg'[i]}{'x' * i}": 5**i * 5 for i in range(7)} | {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625}
    got = spelling_variants.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in got.collect()} == grouped(words)


def test_words_are_counted_whole_and_damaged(spark):
    rng = random.Random(4)
    lexicon = ["".join(rng.choice("abcÀéß") for _ in range(rng.randint(4, 12))) for _ in range(90)]
    rows = [(i, rng.choice([" ", "-", "\n", "1", "日"]).join(rng.choice([w, w.upper(), w.title()]) for w in rng.choices(lexicon, k=80))) for i in range(60)]
    rows += [(None, rows[0][1]), (None, None), (70, ""), (3, rows[3][1]), (71, "gigantic" * 20_000), (71, "gigantic" * 20_000), (72, " ".join(lexicon * 2000))]
    n = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 7 == 0 else w] += 1
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).repartition(4)
    got = dict(map(tuple, spelling_variants.word_counts(docs, every=7).collect()))
    assert got == {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    assert spelling_variants.spelling_variants(docs.where("false")).count() == 0
    assert spelling_variants.spelling_variants(docs).count() > 50
