"""URL filters: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of BLOCKS blocks of 256 bits (four longs): its size is fixed by the parameter, so it may be
broadcast whatever the list's length. URLs that pass go to an exact join with the list, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: verdict, host, path; the longest rule that fits wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BLOCKS = 1 << 14
BITS = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.`` and path without an ending ``.html`` or slash; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/+)$", "")))


def _block(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(1)), F.lit(BLOCKS)).cast("int")


def _masks(url: Column) -> list[Column]:
    """Four longs with the BITS bits that a URL sets in its block."""
    h = F.xxhash64(url, F.lit(2))
    out = []
    for w in range(4):
        mask = F.lit(0).cast("long")
        for k in range(BITS):
            at = F.shiftrightunsigned(h, 8 * k).bitwiseAND(F.lit(255)).cast("int")
            mask = mask.bitwiseOR(F.when(F.shiftright(at, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long")))
        out.append(mask)
    return out


def bloom_filter(listed: DataFrame) -> DataFrame:
    """(block, m0..m3) of a table with a column url; at most BLOCKS rows."""
    rows = listed.select(_block(F.col("url")).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks(F.col("url")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"m{i}") for i in range(4)])


def _rule(host: Column, path: Column, rules, verdict: bool) -> Column:
    out = F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.lit(what if verdict else rule_host + rule_path)).otherwise(out)
    return out


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, is_listed for each row of a table with page_id and url.

    ``listed`` has canonical URLs in its column url; nulls and repeats in it count for nothing. Where no rule fits,
    listed URLs are blocked and others allowed. A null url or one without ``://`` has an empty host and path, fits no
    rule and isn't listed. Repeated rows and null ids are judged like others.
    """
    listed = listed.where(F.col("url").isNotNull()).select("url").distinct()
    found = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = found.withColumn("_canonical", canonical(F.col("host"), F.col("path"))).withColumn("_block", _block(F.col("_canonical")))
    bits = F.broadcast(bloom_filter(listed).withColumnRenamed("block", "_block"))  # BLOCKS rows at most
    probed = found.join(bits, "_block", "left")
    passes = F.lit(True)
    for i, mask in enumerate(_masks(F.col("_canonical"))):
        passes = passes & (F.coalesce(F.col(f"m{i}"), F.lit(0).cast("long")).bitwiseAND(mask) == mask)
    probed = probed.withColumn("_hit", F.when(passes & F.col("_canonical").isNotNull(), F.col("_canonical")))
    # only possible hits carry a key; the others go to no list entry, spread by page
    spread = F.coalesce(F.col("_hit"), F.concat(F.lit(" "), F.xxhash64("page_id", "path").cast("string")))
    exact = listed.select(F.col("url").alias("_url"), F.lit(True).alias("_on"))
    out = probed.withColumn("_probe", spread).join(exact, F.col("_probe") == F.col("_url"), "left")
    is_listed = F.coalesce(F.col("_on"), F.lit(False))
    rule = _rule(F.col("host"), F.col("path"), rules, False)
    verdict = F.coalesce(_rule(F.col("host"), F.col("path"), rules, True), F.when(is_listed, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), is_listed.alias("is_listed"))


def spam_list(pages: DataFrame, label: str = "spam-farm") -> DataFrame:
    """The listed canonical URLs of the registered query: those of pages on hosts with this label before their domain."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return pages.where(host.rlike(rf"(^|\.){label}\.")).select(canonical(host, path).alias("url"))
