"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import importance_sampling, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, spelling_variants, suffix_dedup, token_counts, token_output, url_filter, vector_search
from .common import n_words, stage, staged_path


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "source", "text")
    sizes = stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    return mixing.mix(sizes).select("doc_id", "source", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return line_dedup.dedup_lines(docs, short_copies=True).select("doc_id", "n_lines", "n_removed", F.md5(F.col("text")).alias("text_md5"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    model = quality_classifier.fit(docs, _table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_classifier.score(docs, model)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents", "doc_id", "text"), drop_text=True)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op6_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staged_path(spark, "tokens.orc")
    token_output.write_tokens(_table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_output.token_index(spark, path)


def op8_vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages", "page_id", "url")
    return url_filter.judge_urls(pages, url_filter.spam_list(pages))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_importance_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sampling.resample(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "text"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(_table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict:
    named = (op1_source_mixing, op2_line_dedup, op3_minhash_near_dedup, op4_quality_classifier, op5_quality_rules, op6_length_packing, op7_token_output, op8_vector_top_k, op9_token_counts, op10_url_filter, op11_suffix_dedup, op12_importance_sampling, op13_spelling_variants)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": OP1_SQL, "op8_vector_top_k": OP8_SQL, "op10_url_filter": OP10_SQL, "op12_importance_sampling": OP12_SQL, "op13_spelling_variants": OP13_SQL}


OP1_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rnk FROM sizes GROUP BY source
), weighted AS (
  SELECT *, CAST(CASE rnk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, 2 * source_size / CAST(CASE rnk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS ratio FROM totals
), levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM totals)
     - (sum(2 * source_size) OVER (ORDER BY ratio, rnk ROWS UNBOUNDED PRECEDING) - 2 * source_size))
     / ((SELECT sum(weight) FROM weighted) - sum(weight) OVER (ORDER BY ratio, rnk ROWS UNBOUNDED PRECEDING) + weight) AS lvl
  FROM weighted
), rate AS (
  SELECT lvl AS rate FROM levels WHERE lvl <= ratio ORDER BY ratio, rnk LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN (SELECT rate FROM rate) IS NULL THEN CAST(2 * source_size AS DOUBLE) ELSE least(CAST(2 * source_size AS DOUBLE), (SELECT rate FROM rate) * weight) END AS target FROM levels
), keyed AS (
  SELECT s.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    sum(size) OVER (PARTITION BY s.source ORDER BY CAST('0x' || substr(md5('20|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before_
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
  CAST(CASE WHEN size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - before_)) ELSE 0 END AS BIGINT) AS taken
FROM keyed
"""

OP8_SQL = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP10_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), canon AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/+)$', '') END AS canonical,
    CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts
), listed AS (SELECT DISTINCT canonical FROM canon WHERE regexp_matches(host, '(^|\.)spam-farm\.') AND canonical IS NOT NULL),
judged AS (SELECT c.*, l.canonical IS NOT NULL AS is_listed FROM canon c LEFT JOIN listed l ON c.canonical = l.canonical)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN is_listed THEN 'block' ELSE 'allow' END AS verdict, is_listed
FROM judged
"""

#: CRC-32 of the UTF-8 bytes of x.s for a table with one list, crc_table.t.
_CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
)"""
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hex(s)) // 2), lambda i: CAST('0x' || substr(hex(s), 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUNS = r"unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+'))"

OP12_SQL = rf"""
WITH {_CRC_TABLE}, docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), words AS (SELECT r, s, count(*) AS n FROM (SELECT r, unnest(ws) AS s FROM docs) GROUP BY ALL),
target AS (
  SELECT s, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS s FROM benchmark) GROUP BY ALL
), crcs AS (SELECT s, {_CRC} % 10000 AS bucket FROM (SELECT s FROM words UNION SELECT s FROM target), crc_table),
corpus AS (SELECT bucket, sum(n) AS n FROM words JOIN crcs USING (s) GROUP BY ALL),
aimed AS (SELECT bucket, sum(n) AS n FROM target JOIN crcs USING (s) GROUP BY ALL),
gains AS (
  SELECT b AS bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM corpus) + 10000)::DOUBLE / ((coalesce(c.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM aimed) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) x(b) LEFT JOIN corpus c ON c.bucket = b LEFT JOIN aimed t ON t.bucket = b
), sums AS (SELECT r, sum(n * gain) AS total FROM words JOIN crcs USING (s) JOIN gains USING (bucket) GROUP BY ALL),
weighed AS (
  SELECT doc_id, len(ws) AS n_features, CASE WHEN len(ws) = 0 THEN 0 ELSE CAST(floor(total / len(ws)) AS BIGINT) END AS weight,
    CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM docs LEFT JOIN sums USING (r)
), scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weighed),
placed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST, n_features, weight) END AS p FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CAST(CASE WHEN p <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN p END AS BIGINT) AS rank
FROM placed
"""

OP13_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT w, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s, count(*) AS n
  FROM (SELECT doc_id, {_LOW.format(_RUNS)} AS w FROM documents) WHERE length(w) >= 6 GROUP BY ALL
), hashed AS (SELECT w, n, {_CRC} AS h FROM runs, crc_table),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, n FROM hashed),
vocabulary AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY ALL HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary),
shorter AS (SELECT word, n, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r FROM places),
pairs AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS n_other FROM shorter a JOIN shorter b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM shorter a JOIN vocabulary b ON a.l || a.r = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM shorter a JOIN vocabulary b ON a.l || a.r = b.word
), near AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -n_other, o := other)) AS best FROM pairs GROUP BY ALL),
forms AS (
  SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN -best.m >= 5 * v.n THEN best.o END AS form, CAST(CASE WHEN -best.m >= 5 * v.n THEN -best.m END AS BIGINT) AS form_n
  FROM vocabulary v LEFT JOIN near USING (word)
), paths AS (
  SELECT word, word AS at FROM forms UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON f.word = p.at WHERE f.form IS NOT NULL
), roots AS (SELECT p.word, p.at AS root FROM paths p JOIN forms f ON f.word = p.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
