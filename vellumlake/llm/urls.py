"""URL filter: a blocked Bloom filter of the listed canonical URLs passes possible hits to an exact hash join.

A listed URL is a host and a path that canonical URLs of that host and its subdomains start with. A URL's keys are all
its host suffixes, each with the prefixes of its path that are as long as some listed path. Keys that the filter may
hold go on to the join with the list itself, which removes false positives. DataFrame functions only.

The filter: 256-bit blocks of eight 32-bit words. A key's hash picks the block, and sets one bit in each word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Odd multipliers, one for each word of a block.
SALTS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]
#: Listed keys for each block: about 2 % false positives.
KEYS_A_BLOCK = 24
#: The filter is broadcast, so its size is bounded: at most so many blocks of 40 bytes, 40 MB. A longer list only makes
#: more false positives, which the join removes.
MAX_BLOCKS = 1 << 20
#: A list of up to so many bytes is broadcast for the exact hash join; a longer one is dealt out by key first, where Spark splits hot keys.
BROADCAST_BYTES = 8 << 20

#: The contract's rules: (host, path, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
DEFAULT_VERDICT = "allow"


def lowered(c: Column) -> Column:
    """With A-Z in lower case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame) -> DataFrame:
    """pages with the host and path of their url."""
    rest = F.coalesce(F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")), F.lit(""))
    host = lowered(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def _words(key):
    """The block (before the modulus) and the eight bit masks of a key."""
    h = F.xxhash64(key)
    low = h.bitwiseAND(F.lit(0x7FFFFFFF))
    bits = [F.expr(f"shiftleft(1L, cast(shiftright((low * {s}L) & 4294967295L, 27) as int))") for s in SALTS]
    return F.shiftrightunsigned(h, 32).alias("high"), low.alias("low"), bits


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """The filter's non-empty blocks: block and words w0 to w7 of the distinct strings in column key."""
    high, low, bits = _words(F.col("key"))
    own = keys.select(high, low).select((F.col("high") % n_blocks).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(bits)))
    return own.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)))


def may_hold(candidates: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The rows of candidates whose column key the filter may hold. blocks has at most n_blocks rows, so it is broadcast."""
    high, low, bits = _words(F.col("key"))
    own = candidates.select("*", high, low).withColumn("block", F.col("high") % n_blocks)
    hit = own.join(F.broadcast(blocks), "block")
    for i, b in enumerate(bits):
        hit = hit.where(F.col(f"w{i}").bitwiseAND(b) != 0)
    return hit.select(*candidates.columns)


def url_filter(pages: DataFrame, listed: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, url, host, path, rule and verdict of every row of pages (page_id, url).

    listed has host, path (starting with "/") and verdict. The longest listed URL that fits gives rule (host and path in
    one string) and verdict; of two as long, the one with the longer host, then the smaller verdict. Without one, rule
    is null and verdict is default. A null url or one without "://" has an empty host and path and fits nothing. Repeated
    rows all stay; other columns are ignored; null hosts or paths in the list are dropped; an empty list fits nothing.

    A page's hits are brought together by (page_id, url), with partial sums first; repeated rows are counted and put out
    again as often, so that a page that is there a million times is one group of one row for each task.
    """
    listed = listed.select(lowered(F.col("host")).alias("l_host"), F.col("path").alias("l_path"), F.col("verdict").alias("l_verdict")).where("l_host is not null and l_path is not null")
    listed = listed.groupBy("l_host", "l_path").agg(F.min("l_verdict").alias("l_verdict"))
    listed = Scratch(pages.sparkSession, "urls").table(listed.select(F.concat("l_host", F.lit("\t"), "l_path").alias("key"), "l_host", "l_path", "l_verdict"))
    size = F.sum(2 * F.octet_length("key") + F.coalesce(F.octet_length("l_verdict"), F.lit(0)) + 64)
    n, size, most = listed.agg(F.count("*"), F.coalesce(size, F.lit(0)), F.coalesce(F.max(F.size(F.split("l_host", r"\."))), F.lit(0))).first()
    spread = [r[0] for r in listed.select(F.length("l_path")).distinct().collect()]
    n_blocks = max(1, min(MAX_BLOCKS, -(-n // KEYS_A_BLOCK)))
    blocks = bloom_blocks(listed.select("key").distinct(), n_blocks)

    own = with_parts(pages.select("page_id", F.col("url").cast("string").alias("url")))
    labels = F.split("host", r"\.")
    # only as many labels from the end as some listed host has, so that long hosts cost no more
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda i: F.concat_ws(".", F.slice(labels, F.size(labels) - i + 1, i)))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, sorted(spread))), lambda k: k <= F.length("path")), lambda k: F.expr("path").substr(F.lit(1), k)) if spread else F.array().cast("array<string>")
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\t"), p))))
    cand = own.select("page_id", "url", F.explode(keys).alias("key"))
    hits = may_hold(cand, blocks, n_blocks).join(F.broadcast(listed) if size <= BROADCAST_BYTES else listed.hint("shuffle_hash"), "key")
    best = F.struct(F.length(F.concat("l_host", "l_path")).alias("n"), F.length("l_host").alias("m"), F.concat("l_host", "l_path").alias("rule"), F.col("l_verdict").alias("verdict"))
    none = F.lit(None).cast("struct<n:int,m:int,rule:string,verdict:string>")
    both = hits.select("page_id", "url", best.alias("best"), F.lit(0).alias("row")).unionByName(own.select("page_id", "url", none.alias("best"), F.lit(1).alias("row")))
    order = F.struct(F.col("best.n"), F.col("best.m"), F.col("best.rule"))
    one = both.groupBy("page_id", "url").agg(F.max_by("best", F.when(F.col("best").isNotNull(), order)).alias("best"), F.sum("row").alias("rows"))
    one = one.select("page_id", "url", "best", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("again"))
    return with_parts(one).select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the contract's rules."""
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed).drop("url")


ORACLE = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
own AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k FROM parts),
rules(r_host, r_path, r_verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'),
  ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
hits AS (
  SELECT k, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM own JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM own LEFT JOIN hits USING (k)
"""
