"""Operator 8, URL filters: a blocked Bloom filter of listed canonical URLs, then an exact join.

A URL's verdict is that of the longest rule that fits it, else block if its canonical form is listed,
else allow. Listed URLs set 8 bits within one 512-bit block of the filter; pages whose bits are not all
set can't be listed; the rest meet the list in a hash join, which removes the false positives.

Scale: the filter grows with the list up to MOST_BITS (32 MB, some 22 million URLs at 1 in 100 false
positives), so it may be sent to every task; with a longer list only its false positives grow, never the
result. Only possible hits are shuffled, each URL's over SALTS keys.

Defined cases: a null URL or one without :// has empty host and path, fits no rule and is allowed; no
pages give no rows, an empty list blocks nothing; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: The query lists the canonical URLs of hosts with such a label, under any domain, and of all hosts those with such an end.
SPAM_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_END = "7"
BLOCK_BITS = 512
PROBES = 8
BITS_PER_URL = 12
MOST_BITS = 1 << 28
SALTS = 8  # keys of a listed URL in the join
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without www., path without a last / or .html; scheme, query and fragment don't count."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(/|\.html)\z", ""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda x: len(x[0] + x[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its PROBES bits within the block."""
    x = common.mix(h.view(np.uint64))
    block = (x % np.uint64(blocks)).astype(np.int64)
    y = common.mix(x ^ np.uint64(0x51ED270B7F5C1234))
    return block, np.stack([(y >> np.uint64(7 * k)) % np.uint64(BLOCK_BITS) for k in range(PROBES)], axis=1).astype(np.int64)


def bloom(listed: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """The filter of a ``url`` column of canonical URLs, as 64-bit words."""
    n = listed.count()
    blocks = max(1, min(most_bits, n * BITS_PER_URL) // BLOCK_BITS + 1)

    def mark(batches):
        for batch in batches:
            block, bit = _bits(batch.column(0).to_numpy(), blocks)
            at = (block[:, None] * BLOCK_BITS + bit).ravel()
            words, where = np.unique(at >> 6, return_inverse=True)
            masks = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(masks, where, np.uint64(1) << (at & 63).astype(np.uint64))
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(masks.view(np.int64))], ["word", "mask"])

    rows = listed.select(F.xxhash64("url")).mapInArrow(mark, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(blocks * BLOCK_BITS // 64, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return out


def possible(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    block, bit = _bits(hashes, len(words) * 64 // BLOCK_BITS)
    at = block[:, None] * BLOCK_BITS + bit
    return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, most_bits: int = MOST_BITS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; listed: canonical URLs in column ``url``."""
    listed = common.durable(listed.select("url").where("url is not null").distinct())
    shared = pages.sparkSession.sparkContext.broadcast(bloom(listed, most_bits))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(possible(shared.value, h.to_numpy(np.int64)))

    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), canonical(F.col("host"), F.col("path")).alias("canonical"))
    sifted = ruled.withColumn("maybe", F.col("by_rule").isNull() & maybe(F.xxhash64("canonical")))
    clear = sifted.where(~F.col("maybe")).select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"))
    # a URL's pages are spread over SALTS keys, and so is the list's row of it, so that a hot URL is no hot key
    salted = sifted.where("maybe").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    spread = listed.select(F.col("url").alias("canonical"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("hit"))
    hits = salted.join(spread, ["canonical", "salt"], "left")
    return clear.unionAll(hits.select("page_id", "host", "path", "rule", F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict")))


def listing(pages: DataFrame, names=SPAM_NAMES, end: str = LISTED_END) -> DataFrame:
    """Canonical URLs of the pages of hosts with such a label, under any domain, and those that end so."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return pages.where(host.rlike(_labels(names)) | canonical(host, path).endswith(end)).select(canonical(host, path).alias("url"))


def _labels(names) -> str:
    return rf"(^|\.)({'|'.join(names)})\."


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return judge(pages, listing(pages))


_FITS = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
_BY_LENGTH = sorted(RULES, key=lambda x: -len(x[0] + x[1]))
_sql = lambda listed: f"""
with rest as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages
), split as (
  select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest
), ruled as (
  select *, case {' '.join(f"when {_FITS(h, p)} then '{h}{p}'" for h, p, _ in _BY_LENGTH)} end as rule,
    case {' '.join(f"when {_FITS(h, p)} then '{v}'" for h, p, v in _BY_LENGTH)} end as by_rule,
    regexp_replace(host, '^www\\.', '') || regexp_replace(path, '(/|\\.html)$', '') as canonical
  from split
), listed as (
  select distinct canonical from ruled where {listed}
)
select page_id, host, path, rule, coalesce(by_rule, case when canonical in (select canonical from listed) then 'block' else 'allow' end) as verdict
from ruled
"""  # noqa: E731
OP8_SQL = _sql(f"regexp_matches(host, '{_labels(SPAM_NAMES)}') or ends_with(canonical, '{LISTED_END}')")
