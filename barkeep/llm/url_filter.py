"""URL filter: a blocked Bloom filter passes possible hits to an exact join.

Listed URLs are canonicalised and hashed into a filter of 64-bit blocks; every listed URL sets
``BITS_PER_URL`` bits of one block. Each page probes the filter where it is; a page whose bits are
all set is a possible hit, and only these are shuffled, to an exact join on the canonical URL that
removes the false positives, so the result never depends on the filter's size. Host rules (allow or block by host and path prefix) come before the list.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule
and is allowed; repeated rows are judged each on its own; an empty list blocks nothing. Columns named
host, path, canonical_url, rule or verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from barkeep.llm._util import free_name, hot_keys, spread_join, written

#: Bits that a listed URL sets in its block; expected URLs to a 64-bit block.
BITS_PER_URL, URLS_PER_BLOCK = 4, 4
#: A filter of at most so many blocks (8 bytes and a key each) is broadcast; a larger one is joined by block.
BROADCAST_BLOCKS = 1 << 17

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, and path without trailing slashes or ``.html``."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(/|\.html)+$", ""))


def _bits(key: Column) -> Column:
    """The mask of a key within its block."""
    mask, h = F.lit(0).cast("long"), F.xxhash64(key, F.lit("bits"))
    for i in range(BITS_PER_URL):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def bloom_blocks(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """The filter as a table (block, mask): one row for each block with a bit set."""
    return listed.select(_block(F.col(key), n_blocks).alias("block"), _bits(F.col(key)).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("mask"))


def possible_hits(pages: DataFrame, listed: DataFrame, key: str, to: str) -> DataFrame:
    """``pages`` with the column ``to``: whether the filter of the distinct keys of ``listed`` passes the row's key.

    The filter holds 64 bits for every URLS_PER_BLOCK listed URLs, so its size follows the list. Up to
    BROADCAST_BLOCKS blocks it is broadcast and each row is probed where it is; a larger one is
    joined by block, rows without key by the partition that they are in.
    """
    block, mask = free_name(pages, "block"), free_name(pages, "mask")
    n_blocks = max(1, -(-listed.count() // URLS_PER_BLOCK))
    blocks = bloom_blocks(listed, key, n_blocks).withColumnsRenamed({"block": block, "mask": mask})
    at = _block(F.col(key), n_blocks)
    if n_blocks <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    own = F.when(F.col(key).isNull(), -1 - F.spark_partition_id()).otherwise(at)
    bits = _bits(F.col(key))
    probed = pages.withColumn(block, own).join(blocks, block, "left")
    return probed.withColumn(to, F.coalesce(F.col(key).isNotNull() & (F.col(mask).bitwiseAND(bits) == bits), F.lit(False))).drop(block, mask)


def with_listed(pages: DataFrame, listed: DataFrame, key: str, to: str) -> DataFrame:
    """``pages`` with the column ``to``: whether ``listed`` has the row's key. Only possible hits are joined with the list; all other rows stay where they are."""
    listed = listed.select(key).where(F.col(key).isNotNull()).distinct()
    possible = free_name(pages, "possible")
    probed = possible_hits(pages, listed, key, possible)
    hits, others = probed.where(F.col(possible)).drop(possible), probed.where(~F.col(possible)).drop(possible)
    counts = written(hits.groupBy(key).count(), "hits")
    hot = hot_keys(counts, key, "count", counts.agg(F.sum("count")).first()[0] or 0)
    by = [f"`{f.name}`" for f in pages.schema.fields if isinstance(f.dataType, AtomicType)]
    exact = spread_join(hits, listed.withColumn(to, F.lit(True)), key, hot, by, "left")
    return exact.withColumn(to, F.coalesce(to, F.lit(False))).unionByName(others.withColumn(to, F.lit(False)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. A rule is (verdict, host/path prefix)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):  # later, longer rules stand outside
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """``pages`` with host, path, canonical_url, rule and verdict; ``listed`` has URLs in ``url``.

    The verdict is that of the longest rule that fits; without one, ``block`` for a listed
    canonical URL and ``allow`` for any other.
    """
    added = {"host": host_of(F.col(url)), "path": path_of(F.col(url))}
    out = pages.withColumns(added)
    out = out.withColumn("canonical_url", F.when(F.col("host") != "", canonical(F.col("host"), F.col("path"))))
    black = listed.select(canonical(host_of(F.col(url)), path_of(F.col(url))).alias("canonical_url"))
    is_listed = free_name(out, "listed")
    out = with_listed(out, black, "canonical_url", is_listed)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return out.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col(is_listed), "block").otherwise("allow"))}).drop(is_listed)
