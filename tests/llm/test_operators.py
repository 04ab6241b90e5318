"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from ledgerloom.llm import line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, token_counts, token_output, url_filter, vector_search  # noqa: E402
from ledgerloom.llm.common import n_words, staged_path  # noqa: E402
from ledgerloom.llm.components import components  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SP = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return WORD.findall(text or "")


def corpus(seed=1):
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice("abcdefghiklmnoprstuvéñ") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    base = [" ".join(rng.choice(lexicon) for _ in range(120)) for _ in range(8)]
    rows = []
    for i in range(60):
        w = base[i % 8].split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(lexicon)
        rows.append((i, " ".join(w), "en", f"s{i % 4}" if i % 7 else None, 10))
    rows += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, "three short words", "en", "s1", 5), (103, "Three short WORDS", "en", "s1", 5), (None, base[0], "en", "s0", 5), (3, rows[3][1], "en", "s3", 10), (104, " \t\n", "en", "s2", 3)]
    rows.append((105, "\n".join([base[1]] * 3 + ["x", base[2] + " end"]), "en", "s2", 1))
    rows.append((106, " ".join(rng.choice(lexicon) for _ in range(6000)), "fr", "s9", 1))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("label", F.lit("clash")).withColumn("size", F.lit(-1))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(docs, rows, empty):
    sized = docs.select("doc_id", "source", "label", n_words(F.col("text")).alias("size"))
    got = mixing.mix(sized).collect()
    assert sorted(r["size"] for r in got) == sorted(len(words(t)) for _, t, *_ in rows)
    totals = Counter()
    for _, t, _, s, _ in rows:
        totals[s] += len(words(t))
    names = sorted((s for s in totals if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, left, budget = {}, set(names), 1.5 * sum(totals.values())
    while True:  # fill by weight, cap, share the excess again
        rest = budget - sum(full.values())
        level = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if level[s] > 2 * totals[s]]
        if not over:
            break
        for s in over:
            full[s] = 2 * totals[s]
            left.discard(s)
    target = {**level, **full}
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in names:
        assert taken[s] == math.floor(target[s] + 1e-9)
    assert sorted(map(str, mixing.mix(sized.repartition(3)).collect())) == sorted(map(str, got))
    out = mixing.mix_documents(docs).collect()
    assert sum(len(words(r["text"])) for r in out) == sum(taken.values()) and len(out[0]) == 7
    assert mixing.mix(empty.select("doc_id", "source", F.lit(1).cast("long").alias("size"))).count() == 0


def _edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_line_dedup(spark, docs, empty):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    text = [(1, f"{base}\nshort line\n{base}"), (2, f"other words that stand alone here today\n{base.upper()}\n\nshort line"), (3, base.replace("theta iota", "theta iotas") + "\nlast words of the third document go here"), (4, None), (5, ""), (None, base)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(text, "doc_id long, text string")).collect()}
    assert got[1]["text"] == f"{base}\nshort line" and got[1]["n_removed"] == 1
    assert got[2]["text"] == "other words that stand alone here today\n\nshort line"
    assert got[3]["text"] == "last words of the third document go here"
    assert got[4]["text"] is None and got[4]["n_lines"] == 0 and got[5]["text"] == "" and got[None]["text"] == ""
    rows = line_dedup.dedup_lines(docs).collect()
    assert len(rows) == docs.count() and rows[0]["label"] == "clash"
    assert line_dedup.dedup_lines(empty).count() == 0
    # links that were made are within the distance
    assert _edit_distance(base, base.replace("theta iota", "theta iotas")) == 1


def _near(rows):
    sets = []
    for _, t, *_ in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                group[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


def test_near_duplicates(docs, rows, empty):
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == _near(rows)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    for similar in (0.7, 0.85, 0.95):
        n = 2000
        shared = round(2 * n * similar / (1 + similar))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        values = np.concatenate([np.sort(pool[:n]), np.sort(pool[n - shared : 2 * n - shared])])
        sig = near_dedup.signatures(values, np.array([0, n, 2 * n]))
        ones = int(np.bitwise_count(np.bitwise_xor(*near_dedup.sketches(sig))).sum())
        assert abs(ones - near_dedup.flips_at(similar)) < 30


def test_classifier(spark, empty):
    rng = random.Random(3)
    good = [f"{' '.join(rng.choice(['the', 'river', 'flows', 'past', 'old', 'stone', 'houses', 'and']) for _ in range(60))}." for _ in range(150)]
    bad = [" ".join(rng.choice(["buy$$$", "now###", "cheap***", "the"]) for _ in range(50)) for _ in range(150)]
    rows = [(i, t, 5) for i, t in enumerate(x for pair in zip(good, bad, strict=True) for x in pair)] + [(900, None, None), (901, "", 0), (None, good[0], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels, sample=200)
    got = {r["doc_id"]: r for r in quality_classifier.score(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i]["held_out"] for i in held) and sum(got[i]["predicted"] == 1 - i % 2 for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and not got[None]["held_out"]
    assert quality_classifier.score(empty, model).count() == 0
    # repeated rows of an id are one row to learn from
    again = quality_classifier.fit(docs.union(docs).union(docs), labels, sample=200)
    assert again.w0 == model.w0 and (again.w == model.w).all() and (again.v == model.v).all()
    # the identity equals the sum over pairs
    index, value, at = np.array([3, 9, 40]), np.array([0.5, 1.0, -2.0], dtype=np.float32), np.array([0, 3])
    pairs = sum(float(model.v[index[i]] @ model.v[index[j]]) * value[i] * value[j] for i in range(3) for j in range(i))
    assert model.margins(index, value, at)[0] == pytest.approx(model.w0 + float(model.w[index] @ value) + pairs, rel=1e-4, abs=1e-5)


def test_quality_rules(docs, rows, spark, empty):
    repeated = "one two three four five six seven eight nine ten eleven twelve"
    more = [(200, f"{repeated}\n{repeated}\n{repeated}", "en", "s", 1), (201, "ab### cd*** ef$$$ gh&&& " * 20, "en", "s", 1)]
    got = quality_rules.judge(docs.select("doc_id", "text").union(spark.createDataFrame(more, SCHEMA).select("doc_id", "text")), drop_text=True).collect()
    want = []
    for i, t, *_ in [*rows, *more]:
        w, t = words(t), t or ""
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        often = Counter(windows)
        covered = {j for k, x in enumerate(windows) if often[x] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((tuple(r[k] for k in names) for r in got), key=str) == sorted(want, key=str)
    assert not any(r["kept"] for r in got if r["base_failed"] or r["doc_id"] == 201) and all(r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 60)
    assert quality_rules.judge(empty).count() == 0 and quality_rules.fit_patterns([]) == {}


def test_packing(docs, rows, empty):
    rng = random.Random(5)
    counts = {n: rng.randint(1, 9) for n in rng.sample(range(1, 60), 12)}
    lengths = sorted(counts)

    def padding(cuts):
        return sum(counts[n] * (min(c for c in cuts if c >= n) - n) for n in lengths)

    import itertools

    best = min(padding((*c, lengths[-1])) for c in itertools.combinations(lengths[:-1], 3))
    assert padding(packing.boundaries(counts, 4)) == best and packing.boundaries({}) == []
    got = packing.pack_documents(docs, longest=100, buckets=4, budget=400).collect()
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
        assert 1 <= r["length"] <= r["bucket"] <= 100
    want = Counter()
    for i, t, *_ in rows:
        want[i] += len(words(t))
    assert total == +want
    per = Counter((r["batch_id"], r["bucket"]) for r in got)
    assert len({b for b, _ in per}) == len(per) and all(n <= max(1, 400 // c) for (_, c), n in per.items())
    for c in {c for _, c in per}:
        assert sum(n < max(1, 400 // c) for (_, x), n in per.items() if x == c) <= 1
    assert len({(r["batch_id"], r["slot"]) for r in got}) == len(got) and packing.pack_documents(empty).count() == 0


def test_token_output(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    odd = [(300, "İstanbul <|endoftext|> don't A<|ENDOFTEXT|>b ﬁ e\u0301 50%, x.", "", "", 0), (301, "It's.\u00a0wide\u3000space , . ..", "", "", 0)]
    ordered = sorted([*rows, *odd], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    path = staged_path(spark, "test.orc")
    token_output.write_tokens(docs.select("doc_id", "text").union(spark.createDataFrame(odd, SCHEMA).select("doc_id", "text")), path, BPE)
    got = {(r["start"], r["doc_id"]): r for r in token_output.token_index(spark, path).collect()}
    at = 0
    for i, t, *_ in ordered:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        r = got[(at, i)]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert token_output.read_tokens(spark, path).where("doc_id = 102").count() == 1
    path = staged_path(spark, "none.orc")
    token_output.write_tokens(empty, path, BPE)
    assert token_output.token_index(spark, path).count() == 0


def test_vector_search(spark, empty):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 16)]) for i in range(300)] + [(400 + i, [0.1] * 16) for i in range(60)]
    rows += [(None, [0.5] * 16), (1000, None), (1001, [None] + [0.1] * 15), (1002, [float("nan")] * 16), (1020, [0.1, 0.2]), (1021, [0.3, 0.4]), (1040, [])]
    got = vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    ints = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q, v in ints.items():
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in ints.items() if c != q and len(w) == len(v))[:20]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert vector_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_token_counts(docs, rows, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    got = token_counts.token_counts(docs, SP, limit=200).collect()
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 200) for i, t, *_ in rows]
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(empty, SP).count() == 0
    texts = ["a  b\n\nc ▁d", "日本語 text — ünïcode 👍🏽", "x" * 200, "   ", "\r\n\t<s>x</s>", "1234 567,89", *[t[:300] for _, t, *_ in rows[:5]]]
    for t in texts:
        own = token_counts.PrefixCounts(t, SP)
        assert [own.count(k) for k in range(len(t) + 1)] == [len(sp.encode(t[:k])) for k in range(len(t) + 1)]
        assert own.truncate(10**6) == len(t) and len(sp.encode(t[: own.truncate(5)])) <= 5
    ids = docs.select(F.monotonically_increasing_id().alias("doc_id"), "text")
    for i, text, fit, over in ids.join(token_counts.token_counts(ids, SP, limit=50), "doc_id").select("doc_id", "text", "fit_bytes", "over_limit").collect():
        part = (text or "").replace("▁", " ").encode()[:fit].decode()
        assert len(sp.encode(part)) <= 50 and over == (part != (text or "").replace("▁", " ")), i
    table = token_counts.prefix_table(docs.where("doc_id = 102"), SP).first()
    assert table["end_byte"][-1] == len("three short words") and table["n_tokens"][-1] == len(sp.encode("three short words"))


def test_bytes_within_a_limit_are_exact(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    rng = random.Random(3)
    texts = ["".join(rng.choice("日本語中文字典的是不了人我在有他这") for _ in range(10_000)), "x" * 3000, "é" * 700, "ab " * 900, "▁" * 50 + "日本" * 300, "a\n\n" * 400 + "abcdefghij" * 100, "short", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    for limit in (1, 37, 256, 4096):
        for i, fit in ((r["doc_id"], r["fit_bytes"]) for r in token_counts.token_counts(frame, SP, limit).collect()):
            text = texts[i].replace("▁", " ")
            cut = len(text.encode()[:fit].decode())
            counts = {k: len(sp.encode(text[:k])) for k in range(cut, min(len(text), cut + 40) + 1)}
            assert counts[cut] <= limit and (cut == len(text) or min(n for k, n in counts.items() if k > cut) > limit), (i, limit)
    assert token_counts.token_counts(frame.where("doc_id = 0"), SP).first()["fit_bytes"] > 11_000


def test_url_filter(spark):
    urls = ["https://A.Example.org/es/x?q", "http://example.org/en/12#f", "x://example.org/en/2", "http://m.net/p.html", "http://www.m.net/p/", "http://m.net/q", "nohost", None, "http://b.com/fr/", "http://com/de/9", "http://notcom/de/", "http://x.org", "http://x.org?y", "http://a://b/c", "", "://h/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit("clash"))
    listed = spark.createDataFrame([("m.net/p",), ("net/p",), ("net/p",), (None,)], "url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, listed).collect()}
    rules = [(r["rule"], r["verdict"]) for _, r in sorted(got.items())]
    assert rules[:6] == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), (None, "block"), (None, "block"), (None, "allow")]
    assert rules[6:] == [(None, "allow"), (None, "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow")]
    assert (got[0]["host"], got[0]["path"], got[13]["host"], got[13]["path"], got[15]["host"]) == ("a.example.org", "/es/x", "a:", "", "h") or (got[13]["host"], got[13]["path"]) == ("a:", "//b/c")
    assert url_filter.judge_urls(pages.limit(0), listed).count() == 0


def test_spam_list_decides_verdicts(spark):
    urls = ["http://www.spam-farm.example.com/it/1.html", "http://spam-farm.example.com/it/1", "http://a.spam-farm.net/q/", "http://example.com/it/1", "http://no-spam-farm.example.com/it/1", "http://www.spam-farm.example.org/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["is_listed"]) for r in url_filter.judge_urls(pages, url_filter.spam_list(pages)).collect()}
    assert got == {0: (None, "block", True), 1: (None, "block", True), 2: (None, "block", True), 3: (None, "allow", False), 4: (None, "allow", False), 5: ("org/", "allow", True)}


def test_votes_of_a_mostly_bad_corpus():
    bad, good = (-1,) * 6, (1,) * 6
    post = quality_rules.fit_patterns([(bad, 900), (good, 100), ((-1, -1, -1, -1, 1, 1), 50)])
    assert post[bad] < 0.01 < 0.99 < post[good]


def test_large_vectors_take_part(spark):
    """Every finite vector takes part (the contract leaves out null and non-finite ones); scores stay exact."""
    rng = random.Random(6)
    rows = [(0, [1.0, 0.5]), (1, [2e6, 0.0]), (2, [0.5, 0.5]), (20, [3e6, 1.0])]
    rows += [(i, [rng.choice([-1, 1]) * 10 ** rng.uniform(-2, 7.4) for _ in range(2)]) for i in range(30, 130)]
    ints = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    want = []
    for q in (i for i in ints if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], w, strict=True)), c) for c, w in ints.items() if c != q)[:20]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored)]
    assert max(w[3] for w in want) > 2**59
    got = vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    cut = vector_search.top_k(spark.createDataFrame([(0, [1.0, 0.5]), (1, [1e300, 0.0]), (2, [0.5, 0.5]), (3, [-1e300, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["vec_id"], r["score"]) for r in cut] == [(1, 2**63 - 1), (2, 64 * 32 + 32 * 32), (3, -(2**63))]


def test_repeated_vectors_and_ids(spark):
    rows = [(i, [0.5, 0.25]) for i in range(1, 200)] + [(7, [0.5, 0.25])] * 3 + [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (500, [0.0, 0.0])]
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = []
    for q, v in {(i, tuple(v)) for i, v in ints if i % 20 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in ints if c != q)[:20]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored)]
    got = vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_words_that_lower_to_two_characters_are_encoded_whole():
    encoder = token_output.WordEncoder(BPE)
    texts = ["\u0130. x\u0130, Abc. ABC, abc abc.. <|endoftext|> 12. \u00e9t\u00e9. na\u00efve,", "", None, "A " * 500 + "b."]
    got = [ids[a:b].tolist() for _, ids, ends in encoder.encode(pa.array(texts), 1) for a, b in zip(ends[:-1], ends[1:])]
    assert got == [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_pipeline(spark, rows, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "source_mixing", "length_packing"]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    steps = []
    for _, f in pipeline.STAGES:
        docs = spark.createDataFrame((out := f(spark, docs, str(tmp_path))).collect(), out.schema)
        steps.append(docs)
    assert all(s.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") for s in steps[:4])
    bad = {100, 101, 102, 103, 104}
    assert not bad & {r["doc_id"] for r in steps[0].collect()} and steps[1].count() == steps[0].count()
    sizes = sum(len(words(r["text"])) for r in steps[3].collect())
    assert sum(r["length"] for r in steps[4].collect()) == sizes


def test_mix_documents_cuts_long_texts_at_a_word(spark):
    long = "  " + " \t\n".join(f"w{i}" for i in range(30000)) + " "
    docs = spark.createDataFrame([(1, "a", long, 7), (2, "b", "x y", 3), (3, "a", None, 0), (4, None, "z", 1)], "doc_id long, source string, text string, n_chars long")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.selectExpr("doc_id", "source", "coalesce(size(filter(split(text, '[ \t\n]+'), w -> w != '')), 0) AS size").selectExpr("doc_id", "source", "CAST(greatest(size, 0) AS long) AS size")).collect()}
    rows = mixing.mix_documents(docs).collect()
    assert sum(len(r["text"].split()) for r in rows if r["doc_id"] == 1) == taken[1]
    assert all(long.startswith(r["text"]) for r in rows if r["doc_id"] == 1) and any(r["text"] != long for r in rows if r["doc_id"] == 1)
    assert not any(r["doc_id"] == 3 for r in rows)


def test_line_verification_equals_edit_distance(spark):
    rng = random.Random(3)
    lines = []
    for _ in range(60):
        base = [rng.choice(["|", "alpha", "bee", "gamma", "de", "epsilon"]) + rng.choice(["", "s", "x"]) for _ in range(rng.randint(1, 14))]
        other = list(base)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(other) + 1)
            other[at : at + rng.randint(0, 1)] = rng.choice([[], ["zeta"], ["a", "b"]])
        lines.append((" ".join(base), " ".join(other)))
    rows = [(f"a{i}".encode(), f"b{i}".encode(), a, b) for i, (a, b) in enumerate(lines)]
    met = spark.createDataFrame([(x, t) for a, b, s, u in rows for x, t in ((a, s), (b, u))], "gid binary, norm string")
    pairs = spark.createDataFrame([(a, b) for a, b, _, _ in rows], "a binary, b binary")
    got = {bytes(r["a"]) for r in line_dedup._verified(met, pairs, 0.8).collect()}

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    want = {a for a, _, s, u in rows if distance(s, u) <= int(max(len(s), len(u)) * (1 - 0.8))}
    assert got == want and want


def _exchanged(rng, words_of_line, lexicon, most):
    """The line with words exchanged for others of the same length, while its edit similarity surely stays at 0.8."""
    out, left = list(words_of_line), len(" ".join(words_of_line)) // 5 - 1
    for n, at in enumerate(rng.sample(range(len(out)), len(out))):
        if n < most and len(out[at]) <= left:
            left -= len(out[at])
            out[at] = rng.choice(lexicon[len(out[at])])
    return out


def test_perturbed_lines_of_all_lengths_are_found(spark):
    rng = random.Random(5)
    lexicon = {n: ["".join(rng.choice("abcdefghiklmnoprstuv") for _ in range(n)) for _ in range(4000)] for n in range(2, 8)}
    rows, kinds = [], [(low, high, most) for low, high in ((5, 9), (10, 19), (20, 39), (40, 79), (80, 160)) for most in (1, 2, 99)]
    for low, high, most in kinds:
        made = 0
        while made < 100:
            base = [rng.choice(lexicon[rng.randint(2, 7)]) for _ in range(rng.randint(low, high))]
            other = _exchanged(rng, base, lexicon, most)
            if other != base:
                rows += [(len(rows), f"{low} {most}", " ".join(base)), (len(rows) + 1, f"{low} {most}", " ".join(other))]
                made += 1
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, kind string, text string")).collect()
    gone = Counter(r["kind"] for r in got if r["n_removed"])
    assert all(r["doc_id"] % 2 for r in got if r["n_removed"])
    assert all(gone[f"{low} {most}"] >= 90 for low, _, most in kinds), dict(gone)


def test_pipeline_near_copies_from_080(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    base = [f"w{i}" for i in range(104)]
    # two words changed: 90 of 110 shingles shared, 0.818
    other = [w + "x" if i in (30, 60) else w for i, w in enumerate(base)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base[::-1]))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]


def test_cross_pairs_of_sizes_at_the_threshold():
    names = ("key", "p", "cid", "label", "sketch", "n", "side", "bands")
    rows = [(7, 0, b"a", b"a", [0], 100, 2, [7]), (7, 0, b"b", b"b", [0], 82, 2, [7])]
    batch = pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)})
    assert [len(x) for x in near_dedup._cross_pairs(10, 80)([batch])] == [1]
    assert not [x for x in near_dedup._cross_pairs(10, 85)([batch]) if len(x)]


def test_members_with_many_near_partners_are_linked_exactly(spark):
    base = [f"w{i}" for i in range(120)]
    # two neighbouring words differ: 104 of 128 shingles shared, more where the places overlap
    places = random.Random(4).choices((8, 10, 12, 20, 21, 40, 45, 60, 63, 66, 90, 105), k=60)
    rows = [(i, " ".join(f"n{i}{k}" if k in (at, at + 1) else w for k, w in enumerate(base))) for i, at in enumerate(places)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == _near(rows)
    assert 5 <= len({c for _, _, c in got}) < 12


def test_output_of_a_bucket_grows_with_its_members():
    n = 1500
    names = ("key", "p", "cid", "label", "sketch", "n", "side", "bands")
    rows = [(7, 0, i.to_bytes(4), i.to_bytes(4), [i % 16], 100, 2, [7]) for i in range(n)]
    batch = pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(names)})
    named = [r for x in near_dedup._cross_pairs(10, 85)([batch]) for r in x.to_pylist()]
    assert n < len(named) <= near_dedup.NEAREST * n
    assert {r["more"] for r in named} == {True, False}
    members = [r for x in near_dedup._cross_members(10, 85)([batch]) for r in x.to_pylist()]
    assert len(members) == n


def test_parts_of_long_texts_meet_once():
    names = ("key", "p", "cid", "label", "sketch", "n", "side", "bands")
    size = near_dedup.PART
    rows = [(7, 0, bytes([i]), bytes([i]), [0], size, 2, [7]) for i in range(3)]
    batch = pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(names)})
    members = [r for x in near_dedup._cross_members(10, 85)([batch]) for r in x.to_pylist()]
    assert sorted((r["lo"], r["hi"], r["cid"][0]) for r in members) == [(0, 1, 0), (0, 1, 1), (0, 2, 0), (0, 2, 2), (1, 2, 1), (1, 2, 2)]
    text = " ".join(f"w{i}" for i in range(40))
    for r in members:
        r["text"] = text
    links = near_dedup._cross_links(10, 85)([pa.RecordBatch.from_pylist(sorted(members, key=lambda r: (r["lo"], r["hi"], r["cid"])))])
    assert sorted((r["a"][0], r["b"][0]) for x in links for r in x.to_pylist()) == [(0, 1), (0, 2), (1, 2)]


def test_pipeline_keeps_one_row_of_each_group(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(None, one, 1), (None, two, 2), (None, two, 2), (5, three, 3), (5, three, 3), (5, three, 4), (5, one + " more", 5), (6, three, 6), (None, "", 7), (7, None, 8)]
    got = pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, n long"), "").collect()
    assert Counter(r["text"] for r in got) == {one + " more": 1, two: 1, three: 1, "": 1, None: 1}
    assert {r["doc_id"] for r in got if r["text"] == three} == {5}


def test_lines_at_exactly_the_similarity_are_linked(spark):
    pairs = [("x" * n, "x" * (n - n // 5 - more) + "y" * (n // 5 + more)) for n in (5, 10, 50, 55) for more in (0, 1)]
    met = spark.createDataFrame([(f"{side}{i}".encode(), p[k]) for i, p in enumerate(pairs) for k, side in enumerate("ab")], "gid binary, norm string")
    ids = spark.createDataFrame([(f"a{i}".encode(), f"b{i}".encode()) for i in range(len(pairs))], "a binary, b binary")
    got = {bytes(r["a"]).decode() for r in line_dedup._verified(met, ids, Fraction(4, 5)).collect()}
    assert got == {f"a{i}" for i in range(0, len(pairs), 2)}


def test_copies_of_short_and_unspaced_lines(spark):
    kanji = "東京都新宿区西新宿二丁目八番一号庁舎前広場"
    rows = [(1, f"Home | About\n\n{kanji}"), (2, f"home |  about\n\n{kanji[:-1]}所"), (3, "Home\nhome | abouts")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, short_copies=True).collect()}
    assert got == {1: rows[0][1], 2: "", 3: rows[2][1]}


def test_long_lines_without_the_usual_first_letters_are_found(spark):
    line = " ".join(f"w{i}x" for i in range(30))
    docs = spark.createDataFrame([(1, line), (2, line.replace("w7x", "w7z"))], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()} == {1: line, 2: ""}


@pytest.mark.parametrize("tile", [1024, 3])
def test_pairs_of_large_blocks_are_all_compared(spark, monkeypatch, tile):
    monkeypatch.setattr(line_dedup, "TILE", tile)
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("bcdfghklm") for _ in range(6)) for _ in range(12)) for _ in range(14)]
    texts += [t[:-1] + "z" for t in texts[3:6]]  # near lines that share this block alone, none of which leads it
    rows = [(f"g{i:02}".encode(), t, 2 if i == 0 else 1, len(t), [1]) for i, t in enumerate(texts)]
    classes = spark.createDataFrame(rows, "gid binary, norm string, weight long, chars int, keys array<long>")
    got = {bytes(r["node"]): bytes(r["component"]) for r in line_dedup.near_lines(classes.select("gid", "norm"), classes, Fraction(4, 5)).collect()}
    assert {x: y for x, y in got.items() if x != y} == {f"g{14 + i}".encode(): f"g0{3 + i}".encode() for i in range(3)}


def test_letters_keep_all_near_lines_and_stop_others_before_a_row_is_made(spark):
    rng = random.Random(17)
    pairs = []
    for i in range(300):
        a = [rng.choice("aab cdeé.,zß1") for _ in range(rng.randint(10, 120))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 4)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice([[], ["a"], ["q"], ["é"], ["ß"]])
        if i % 3 == 0:
            b = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in a]
        pairs.append((i, "".join(a), "".join(b)))
    pairs.append((300, "a" * 60 + "b" * 40, "a" * 40 + "b" * 60))  # counts above 16: not told apart, and near
    both = spark.createDataFrame(pairs, "i long, norm1 string, norm2 string")
    sides = [line_dedup._lettered(both.select("i", F.col(f"norm{k}").alias("norm"), F.length(f"norm{k}").alias("chars"), F.size(F.split(f"norm{k}", " ")).alias("n_words"))).toDF("i", *[f"{c}{k}" for c in ("norm", "chars", "n_words", *[f"letters{n}" for n in range(len(line_dedup.LETTERS) // 4)])]) for k in "12"]
    met = {r["i"] for r in sides[0].join(sides[1], "i").where(line_dedup._may_be_near(Fraction(4, 5))).collect()}
    near = {i for i, a, b in pairs if _edit_distance(a, b) <= max(len(a), len(b)) // 5}
    assert near <= met and 300 in met
    assert len(met - near) < 60 <= len(pairs) - len(near)


def test_pairs_of_a_large_block_that_are_not_near_leave_no_row(spark, monkeypatch):
    rng = random.Random(21)
    texts = [" ".join("".join(rng.choice("bcdfghklm") for _ in range(6)) for _ in range(12)) for _ in range(14)]
    texts.append(texts[5][:-1] + "z")
    rows = [(1, f"g{i:02}".encode(), len(t), 15, t) for i, t in enumerate(texts)]
    members = spark.createDataFrame(rows, "key long, gid binary, chars int, members long, norm string")
    joined = spark.createDataFrame([], "node binary, component binary")
    compared, near = [], line_dedup._near
    monkeypatch.setattr(line_dedup, "_near", lambda both, similarity: compared.append(both.count()) or near(both, similarity))
    got = line_dedup._joining(members.select("gid", "norm"), members.drop("norm"), joined, Fraction(4, 5)).collect()
    assert [(bytes(r["a"]), bytes(r["b"])) for r in got] == [(b"g05", b"g14")] and compared == [1]


def test_steps_of_line_dedup_are_dropped_when_done(spark):
    from ledgerloom.llm import common

    one, two = (common.stage(spark.range(n), "step") for n in (3, 4))
    path = Path(one.inputFiles()[0].removeprefix("file://"))
    assert path.exists()
    common.done_with(one)
    assert not path.exists() and two.count() == 4


def test_steps_of_near_dedup_are_dropped(spark):
    from ledgerloom.llm import common

    mark = common.staged_so_far()
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 2}{k}" for k in range(20))) for i in range(4)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_dedup.one_of_each(docs, percent=80).collect()) == [0, 1]
    assert sorted(path.rsplit("/", 1)[1].rsplit("-", 1)[0] for _, path in common._staged[mark:]) == ["near-rows", "near-stay"]
