"""Operator 9 [native]: URL filters.

Listed canonical URLs go into a split-block Bloom filter built with column functions: a hash picks a block of four 64-bit words
and two bits in each word; a block row holds the or of its URLs' bits. Pages probe their block; possible hits go on to an exact
hash join with the list, which removes false positives, and all others skip that join. Host and path rules come first: the
longest rule that fits decides, else the list does (listed: block).

The filter is broadcast only while its computed size is below ``broadcast_bytes``; beyond that, pages meet their block in a
shuffled join. Defined cases: null url or one without :// has empty host and path, fits no rule, is not listed and is allowed;
repeated pages keep their rows; a list with repeats counts once; empty tables give empty results; columns of pages keep their values
whatever their names, but for host, path, rule, listed and verdict, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

# The rules of op9 in order, verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
# Hosts whose pages make up the list of op9.
LISTED_HOSTS = ["ads-track.example.com", "adult-x.example.net", "casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.com"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_URL, BLOCK_BYTES = 16, 48


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)://(.*)", 1)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without www. or m., path without trailing slash or .html, query without tracking fields; null without a host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"\.html$", ""), "/+$", "")
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)(utm_[a-z]+|ref)=[^&]*", ""), "^&", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], value) -> Column:
    """value of the longest rule that fits, else null."""
    out = None
    for rule in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        out = (F.when if out is None else out.when)(fits(host, path, rule[1], rule[2]), F.lit(value(rule)))
    return F.lit(None).cast("string") if out is None else out


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(17))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int"))
    return [bit(2 * i).bitwiseOR(bit(2 * i + 1)).alias(f"__m{i}") for i in range(4)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).alias("__block")


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(__block, __w0..3) of listed (canon): a row for each block that is not empty."""
    rows = listed.select(_block(F.col("canon"), blocks), *_bits(F.col("canon")))
    return rows.groupBy("__block").agg(*[F.bit_or(f"__m{i}").alias(f"__w{i}") for i in range(4)])


def filter_urls(pages: DataFrame, listed: DataFrame, *, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, broadcast_bytes: int = 8 << 20, shape=None) -> DataFrame:
    """pages with host, path, rule, listed and verdict. listed: a column canon of canonical URLs, repeats allowed. shape picks columns early."""
    listed = listed.where("canon is not null").select("canon").distinct()
    blocks = max(1, listed.count() * BITS_PER_URL // 256 + 1)
    bloom = bloom_filter(listed, blocks)
    # an own column of pages may have any name
    canon, h, p, block, maybe, entry = (free(pages, c) for c in ("__canon", "__h", "__p", "__block", "__maybe", "__listed"))
    words = [free(pages, f"__w{i}") for i in range(4)]
    bloom = bloom.withColumnsRenamed({"__block": block, **{f"__w{i}": w for i, w in enumerate(words)}})
    if blocks * BLOCK_BYTES <= broadcast_bytes:
        bloom = F.broadcast(bloom)
    rows = pages.withColumns({canon: canonical(F.col(url)), h: host_of(F.col(url)), p: path_of(F.col(url))})
    rows = rows.withColumn(block, _block(F.coalesce(canon, F.concat(F.lit(" "), F.col(url)), F.lit(" ")), blocks))
    rows = rows.join(bloom, block, "left")
    hit = F.col(canon).isNotNull()
    for w, bits in zip(words, _bits(F.col(canon)), strict=True):
        hit = hit & (bits.bitwiseAND(F.col(w)) == bits)
    rows = rows.withColumn(maybe, F.coalesce(hit, F.lit(False))).drop(block, *words)
    exact = listed.withColumnsRenamed({"canon": entry})
    hits = rows.where(F.col(maybe)).join(exact, F.col(canon) == F.col(entry), "left")
    rows = hits.unionByName(rows.where(~F.col(maybe)).withColumn(entry, F.lit(None).cast("string")))
    host, path = F.col(h), F.col(p)
    verdict = F.coalesce(rule_of(host, path, rules, lambda r: r[0]), F.when(F.col(entry).isNotNull(), "block").otherwise("allow"))
    out = {"host": host, "path": path, "rule": rule_of(host, path, rules, lambda r: r[1] + r[2]), "listed": F.col(entry).isNotNull(), "verdict": verdict}
    return rows.withColumns(out).drop(canon, h, p, maybe, entry)


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    bad = F.lit(False)
    for h in LISTED_HOSTS:
        bad = bad | fits(host_of(F.col("url")), F.lit("/"), h, "/")
    listed = pages.where(bad).select(canonical(F.col("url")).alias("canon"))
    return filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


def _oracle() -> str:
    fit = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{h}{p}'" for _, h, p in ordered) + " END"
    said = "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{v}'" for v, h, p in ordered) + " END"
    bad = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in LISTED_HOSTS)
    return rf"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)://(.*)', 1) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(r, '^[^?#]*\?([^#]*)', 1) AS query FROM a),
k AS (SELECT *, regexp_replace(regexp_replace(query, '(^|&)(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&', '') AS q FROM h),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canon FROM k),
l AS (SELECT DISTINCT canon FROM c WHERE {bad})
SELECT page_id, host, path, {rule} AS rule, coalesce({said}, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canon IS NOT NULL AS listed
FROM c LEFT JOIN l ON c.canon = l.canon
"""


ORACLE = _oracle()
