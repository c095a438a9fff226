"""URL verdicts: fixed rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of blocks of eight 32-bit words. A URL's hash picks a block and one bit in each word;
listing a URL sets its bits (``bit_or`` per block), a URL may be listed only if all its bits are set. Those
that may be are joined with the list itself by hash, so false positives of the filter never show. The filter
has ``MAX_BLOCKS`` blocks at most (3 MB), whatever the length of the list: that bounds the broadcast, and a
longer list only lets more URLs through to the exact join.

Defined results: a url that is null or has no ``://`` has an empty host and path, fits no rule and is never
listed; repeated rows come out repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MAX_BLOCKS = 1 << 16
# Listed URLs per block at which a word's bit is set by chance in about one of four cases.
URLS_PER_BLOCK = 10
WORDS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.`` and path without slashes at its end; empty without a host."""
    bare = F.regexp_replace(host, r"^(?:www|m)\.", "")
    return F.when(host == "", "").otherwise(F.concat(bare, F.regexp_replace(path, r"/+$", "")))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda rule: len(rule[0] + rule[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """One bit of each word, from another hash than the block's."""
    spread = F.xxhash64(F.lit(1), key)
    place = [F.shiftrightunsigned(spread, 5 * word).bitwiseAND(F.lit(31)).cast("int") for word in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), bit) for bit in place]


def blocked_filter(listed: DataFrame, key: str, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """(``block, w0 .. w7``: at most ``max_blocks`` rows; number of blocks) for the distinct keys listed."""
    blocks = max(1, min(max_blocks, listed.count() // URLS_PER_BLOCK))
    masks = [mask.alias(f"m{word}") for word, mask in enumerate(_masks(F.col(key)))]
    bits = listed.select(_block(F.col(key), blocks).alias("block"), *masks)
    return bits.groupBy("block").agg(*[F.bit_or(f"m{word}").alias(f"w{word}") for word in range(WORDS)]), blocks


def may_be_listed(
    rows: DataFrame, key: str, listed: DataFrame, listed_key: str, max_blocks: int = MAX_BLOCKS
) -> DataFrame:
    """``rows`` with the column ``possible``: false only if the key is certainly not listed."""
    table, blocks = blocked_filter(listed, listed_key, max_blocks)
    # The table is bounded by max_blocks rows of nine numbers.
    probed = rows.withColumn("block", _block(F.col(key), blocks)).join(F.broadcast(table), "block", "left")
    set_bits = F.lit(True)
    for word, mask in enumerate(_masks(F.col(key))):
        set_bits = set_bits & (F.col(f"w{word}").bitwiseAND(mask) == mask)
    return probed.withColumn("possible", F.coalesce(set_bits, F.lit(False))).drop("block", *[f"w{word}" for word in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, possible``: the rule's verdict, else block what is listed.

    ``listed`` has canonical URLs in the column ``canonical``; ``possible`` tells what the filter said.
    """
    listed = listed.select(F.col("canonical").alias("listed_url")).filter("listed_url <> ''").distinct()
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    rows = may_be_listed(rows.withColumn("canonical", canonical(F.col("host"), F.col("path"))), "canonical", listed, "listed_url")
    ruled = rows.filter(~F.col("possible") | F.col("fit").isNotNull()).withColumn("listed_url", F.lit(None).cast("string"))
    open_rows = rows.filter(F.col("possible") & F.col("fit").isNull())
    exact = open_rows.join(listed.hint("shuffle_hash"), open_rows.canonical == listed.listed_url, "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("listed_url").isNotNull(), "block").otherwise("allow"))
    return ruled.unionByName(exact).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "possible")


def noisy_titles(pages: DataFrame) -> DataFrame:
    """``canonical``: URLs of pages whose title holds runs of symbols, as crawled junk has."""
    url = F.col("url").cast("string")
    title = F.regexp_extract(F.coalesce(F.col("html").cast("string"), F.lit("")), r"(?is)<title>(.*?)</title>", 1)
    noisy = pages.filter(title.rlike(r"[%*$#&]{3}"))
    return noisy.select(canonical(host_of(url), path_of(url)).alias("canonical"))
