"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import BROADCAST_BYTES, ascii_lower, maybe_broadcast

#: Rules of the registered query: (verdict, host and path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Bits that a listed URL sets in its block of 64.
BLOOM_BITS = 4


def url_host(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty for null or without '://'."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to '?', '#' or the end; empty for null or without '://'."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _mask(h: Column) -> Column:
    """BLOOM_BITS bits within a block, from the upper half of a hash."""
    out = F.lit(0).cast("long")
    for i in range(BLOOM_BITS):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 40 + 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def url_filter(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    rules has verdict ('allow' or 'block') and rule (host and path prefix, as 'net/'). A rule fits its host
    and all subdomains if the URL's path starts with the rule's; the longest rule wins, then the one with the
    longer host, then 'block'. Every suffix of a host at a dot, with every listed length of path prefix, is a
    canonical key. Keys that the blocked Bloom filter (one 64-bit block for each key, found by a join on the
    block's number) can't rule out go to an exact hash join, which removes false positives. URLs under no rule
    are allowed, with a null rule. Null, empty and malformed URLs have empty host and path. Repeated rows each
    give a row; rules without text are ignored, as are other columns. The filter has a block for every one or
    two rules, however many there are. Filter and rules are broadcast up to broadcast_bytes each, as measured;
    beyond that the joins are shuffled, the filter's by block number, and keys of many URLs are split by AQE.
    """
    listed = rules.select("verdict", "rule").where("rule is not null and verdict is not null")
    listed = listed.select("verdict", "rule", F.regexp_extract("rule", r"(?s)^([^/]*)", 1).alias("rule_host"))
    listed = listed.groupBy(F.concat(ascii_lower(F.col("rule_host")), F.substr("rule", F.length("rule_host") + 1)).alias("key")).agg(F.max(F.struct("verdict", "rule", F.length("rule_host").alias("host_length"))).alias("hit"))
    counted = listed.agg(F.count("*").alias("n"), F.collect_set(F.length("key") - F.col("hit.host_length")).alias("lengths")).first()
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    blocks = 1 << max(4, math.ceil(math.log2(max(1, counted.n)) - 1))
    hashed = listed.select(F.xxhash64("key").alias("h"))
    bloom = hashed.groupBy(F.col("h").bitwiseAND(F.lit(blocks - 1)).alias("block")).agg(F.bit_or(_mask(F.col("h"))).alias("bits"))

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*[F.lit(n) for n in sorted(counted.lengths)]).cast("array<int>")
    starts = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    probes = rows.select("row", "page_id", "host", "path", F.explode_outer(keys).alias("key")).withColumn("h", F.xxhash64("key"))
    possible = probes.join(maybe_broadcast(bloom, broadcast_bytes), F.col("h").bitwiseAND(F.lit(blocks - 1)) == F.col("block"), "left")
    mask = _mask(F.col("h"))
    # A key that the filter rules out becomes one that no rule can equal and that no other row has.
    possible = possible.select("row", "page_id", "host", "path", F.when(F.col("bits").bitwiseAND(mask) == mask, F.col("key")).otherwise(F.concat(F.lit("\0"), F.col("row").cast("string"))).alias("key"))
    exact = possible.join(maybe_broadcast(listed, broadcast_bytes), "key", "left")
    hit = F.when(F.col("hit").isNotNull(), F.struct(F.length("key").alias("size"), F.col("hit.host_length").alias("host_length"), F.col("hit.verdict").alias("verdict"), F.col("hit.rule").alias("rule")))
    best = exact.groupBy("row", "page_id", "host", "path").agg(F.max(hit).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
