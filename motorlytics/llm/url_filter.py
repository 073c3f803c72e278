"""URL filters: host/path rules, then a blocked Bloom filter of listed
canonical URLs whose possible hits an exact hash join confirms.

The filter is a table, one row per 256-bit block, OR-ed together by Spark; a
probe reads exactly one block. It is broadcast only if its known number of
blocks is small, else joined by block. Only possible hits reach the exact join.

Defined results: a null url, or one without ``://``, has empty host and path,
is never listed and is allowed. A null list entry is ignored, a repeated one
counts once. An empty list blocks nothing. Repeated pages are judged one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlytics.llm.common import BROADCAST_BYTES, lower_ascii, stored

URL_PARTS = r"://([^/?#]*)([^?#]*)"
BITS_PER_KEY = 16
BLOCK_BITS = 256
#: Bytes of a broadcast filter row: block number and four 64-bit words.
BLOCK_ROW_BYTES = 64


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 2)


def canonical_url(host: Column, path: Column) -> Column:
    """Scheme, query, fragment, a leading ``www.`` and trailing slashes do not tell
    two pages apart. Null for a url without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", "")))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits. ``rules`` are
    (verdict, host, path prefix); a rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the last `when` built is the first asked: build from short to long
    for says, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2], r[0])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _masks(key: Column) -> list[Column]:
    """Eight bits of a block: two in each of its four 64-bit words."""
    h = F.xxhash64(F.lit(11), key)

    def bit(shift: int) -> Column:
        at = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), at)

    return [bit(12 * j).bitwiseOR(bit(12 * j + 6)) for j in range(4)]


def bloom_blocks(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """One row per non-empty block: ``block, w0..w3``."""
    made = listed.select(_block(F.col(key), n_blocks).alias("block"), *(m.alias(f"w{j}") for j, m in enumerate(_masks(F.col(key)))))
    return made.groupBy("block").agg(*(F.bit_or(f"w{j}").alias(f"w{j}") for j in range(4)))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``pages(page_id, url)`` and ``listed(url)`` -> one row per page: ``page_id,
    host, path, rule, verdict, bloom_hit, listed``. The rule decides, else a listed
    canonical URL is blocked, else the page is allowed."""
    url = F.col("url").cast("string")
    keys = listed.select(canonical_url(host_of(url), path_of(url)).alias("canon")).where("canon is not null").distinct()
    keys = stored(keys, "listed-urls")
    n_blocks = max(1, -(-keys.count() * BITS_PER_KEY // BLOCK_BITS))
    blocks = bloom_blocks(keys, "canon", n_blocks)
    if n_blocks * BLOCK_ROW_BYTES <= BROADCAST_BYTES:
        blocks = F.broadcast(blocks)

    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, "says": says, "canon": canonical_url(F.col("host"), F.col("path"))})
    parts = parts.withColumn("block", _block(F.coalesce("canon", F.lit("")), n_blocks))
    hit = F.col("w0").isNotNull() & F.col("canon").isNotNull()
    for j, mask in enumerate(_masks(F.col("canon"))):
        hit = hit & (F.col(f"w{j}").bitwiseAND(mask) == mask)
    probed = parts.join(blocks, "block", "left").withColumn("bloom_hit", F.coalesce(hit, F.lit(False)))
    kept = ["page_id", "host", "path", "rule", "says", "canon", "bloom_hit"]
    missed = probed.where(~F.col("bloom_hit")).select(*kept, F.lit(False).alias("listed"))
    found = (probed.where("bloom_hit").select(*kept)
             .join(keys.withColumn("listed", F.lit(True)), "canon", "left")
             .select(*kept, F.coalesce("listed", F.lit(False)).alias("listed")))
    return missed.unionByName(found).select(
        "page_id", "host", "path", "rule",
        F.coalesce("says", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "bloom_hit", "listed")
