"""Quality rules by weak supervision (native).

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation over the table of vote
patterns (at most 3^rules rows, whatever the corpus) estimates how often each rule is right on good and on bad
documents; a document is kept if the posterior probability that it is good is at least a half. Documents that fail the
base rules are rejected in any case. All document work is DataFrame functions; the driver sees pattern counts only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, words

#: Frequent short words of the corpus' languages; fixed values.
STOPWORDS = (
    "the of and to in is that it for on with as was by be this are at from or an have not "
    "de la le les des et un une du en que qui dans pour par sur est au aux pas ne ce se il elle "
    "el los las y por con del una no su al lo como más pero sus o "
    "der die das und zu den von mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei"
).split()

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
ROUNDS = 30
#: Documents by which the starting votes of each rule weigh in its estimates.
PSEUDO = 10
#: A text's share of distinct words falls with its length; 15 % of so many words are enough for texts of any length.
VARIED = 5000
SYMBOLS = "#*$%&|<>"

RULES = ("length", "word_length", "symbols", "letters", "mark_runs", "dup_lines", "repeats", "stopwords", "distinct")


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeat_words() -> Column:
    """Words covered by windows that occur twice or more, from the window hashes in _windows.

    Texts whose windows are all distinct (most) need no more than that test. Else equal hashes are brought together
    by a sort, and the positions of repeated ones, sorted again, each cover up to the next one's start.
    """
    return F.expr(
        "CASE WHEN size(_windows) = 0 OR size(array_distinct(_windows)) = size(_windows) THEN 0L ELSE "
        "aggregate(array_sort(filter(zip_with(zip_with("
        "  _sorted, concat(array(CAST(NULL AS struct<h: bigint, i: int>)), slice(_sorted, 1, size(_sorted) - 1)), (x, p) -> struct(x.i AS i, x.h AS h, x.h <=> p.h AS same)),"
        "  concat(slice(_sorted, 2, size(_sorted)), array(CAST(NULL AS struct<h: bigint, i: int>))), (x, n) -> IF(x.same OR x.h <=> n.h, x.i, NULL)), x -> x IS NOT NULL)),"
        f" named_struct('n', 0L, 'end', -1), (acc, i) -> named_struct('n', acc.n + {WINDOW} - greatest(0, least({WINDOW}, acc.end - i)), 'end', i + {WINDOW}), acc -> acc.n) END"
    )


def measured(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct_words, n_stopwords, n_lines,
    n_letters and n_mark_runs (runs of three or more marks), all long.

    Whole texts; a null or empty text has zeros. Windows are compared by 64-bit hashes of their words' hashes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = _without(text, " \t\n\x0b\x0c\r")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    last = F.size("_hashes") - WINDOW
    window = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + k) for k in range(WINDOW)]))
    out = (
        docs.withColumn("_words", words(F.col("text")))
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_windows", F.when(last >= 0, window).otherwise(F.array().cast("array<bigint>")))
        .withColumn("_many", F.size(F.array_distinct("_windows")) < F.size("_windows"))
        .withColumn("_sorted", F.when(F.col("_many"), F.expr("array_sort(transform(_windows, (h, i) -> struct(h AS h, i AS i)))")))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(bare).cast("long"))
        .withColumn("n_symbols", (F.length(bare) - F.length(_without(bare, SYMBOLS))).cast("long"))
        .withColumn("n_letters", (F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))).cast("long"))
        .withColumn("n_mark_runs", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D\p{L}\p{N}]{3,}")).cast("long"))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", _repeat_words())
        .withColumn("n_distinct_words", F.size(F.array_distinct("_hashes")).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
    )
    stop = F.array(*[F.xxhash64(F.lit(w)) for w in STOPWORDS])
    out = out.withColumn("n_stopwords", F.size(F.array_intersect(F.col("_hashes"), stop)).cast("long"))
    return out.drop("_words", "_hashes", "_windows", "_many", "_sorted", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def votes() -> dict[str, Column]:
    """Rule -> 1 good, -1 bad, 0 abstains; every rule abstains on a text without words."""
    n = F.col("n_words")

    def rule(bad: Column, good: Column) -> Column:
        return F.when(n == 0, 0).when(bad, -1).when(good, 1).otherwise(0)

    mean = F.col("word_chars") / F.greatest(n, F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "length": rule(n < MIN_WORDS, n >= 50),
        "word_length": rule((mean < 2.5) | (mean > 14), (mean >= 3) & (mean <= 10)),
        "symbols": rule(10 * F.col("n_symbols") > n, 50 * F.col("n_symbols") <= n),
        "letters": rule(100 * F.col("n_letters") < 75 * chars, 100 * F.col("n_letters") >= 90 * chars),
        "mark_runs": rule(10 * F.col("n_mark_runs") > n, 100 * F.col("n_mark_runs") <= n),
        "dup_lines": rule(2 * F.col("n_dup_lines") > F.col("n_lines"), 5 * F.col("n_dup_lines") <= F.col("n_lines")),
        "repeats": rule(100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n, 100 * F.col("n_repeat_words") <= 15 * n),
        "stopwords": rule((F.col("n_stopwords") < 2) & (n >= 2 * MIN_WORDS), F.col("n_stopwords") >= 3),
        "distinct": rule(100 * F.col("n_distinct_words") < 15 * F.least(n, F.lit(VARIED)), 100 * F.col("n_distinct_words") >= 35 * n),
    }


def fit_patterns(counts: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Vote pattern -> posterior probability of good, by expectation-maximisation.

    Each rule has a probability of each vote given good and given bad, with PSEUDO documents of the
    starting votes added. It starts
    from rules that are right four times in five and from a share of 0.8 good documents, which also fixes which class
    is which. Patterns are summed in sorted order, so reruns agree.
    """
    counts = sorted(counts)
    if not counts:
        return {}
    rules = len(counts[0][0])
    kinds = (-1, 0, 1)
    start = {1: {1: 0.6, 0: 0.25, -1: 0.15}, 0: {1: 0.15, 0: 0.25, -1: 0.6}}
    given = [{c: dict(start[c]) for c in (0, 1)} for _ in range(rules)]
    prior = 0.8
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for pattern, _n in counts:
            odds = math.log(prior) - math.log(1 - prior)
            for r, v in enumerate(pattern):
                odds += math.log(given[r][1][v]) - math.log(given[r][0][v])
            post[pattern] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        total = sum(n for _, n in counts)
        good = math.fsum(n * post[p] for p, n in counts)
        prior = (good + 4) / (total + 5)
        for r in range(rules):
            for v in kinds:
                has = [(n * post[p], n) for p, n in counts if p[r] == v]
                g = math.fsum(x for x, _ in has)
                b = math.fsum(n - x for x, n in has)
                given[r][1][v] = (g + PSEUDO * start[1][v]) / (good + PSEUDO)
                given[r][0][v] = (b + PSEUDO * start[0][v]) / (total - good + PSEUDO)
    return post


def judge(docs: DataFrame, rounds: int = ROUNDS, drop_text: bool = False) -> DataFrame:
    """Add the measures of :func:`measured`, base_failed, p_good (double) and kept (boolean) to documents.

    A null or empty text fails the base rules. Rows are judged one by one, so repeated rows, null ids and ties need no
    care. An empty table gives no rows. With drop_text the result has no text.
    """
    out = measured(docs)
    # written once: a filter pushed below the measures would repeat them
    out = stage(out.drop("text") if drop_text else out, "quality-measures")
    cast = votes()
    names = [f"_vote_{k}" for k in cast]
    out = out.withColumns({f"_vote_{k}": v for k, v in cast.items()})
    counted = out.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3^rules rows
    post = fit_patterns([(tuple(r[k] for k in names), r["n"]) for r in counted], rounds)
    code = sum((F.col(k) + 1) * 3**i for i, k in enumerate(names))
    seen = sorted((sum((v + 1) * 3**i for i, v in enumerate(pattern)), p) for pattern, p in post.items())
    # a map literal with a row for each pattern seen
    known = F.create_map(*[F.lit(x) for pair in seen or [(-1, 0.0)] for x in pair])
    p_good = F.element_at(known, code.cast("int"))
    failed = base_failed()
    return out.withColumn("base_failed", failed).withColumn("p_good", p_good).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)).drop(*names)


def rejected_removed(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    return judge(docs).where("kept").select(*docs.columns)
