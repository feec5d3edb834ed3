"""URL filters: a Bloom filter cascade gives exact membership of listed hosts, without joins.

Level 0 encodes the listed keys; level 1 those unlisted keys of the corpus's key universe that level 0 takes for
listed; level 2 the listed keys that level 1 takes for unlisted; and so on, until a level has no false positive. A
key of the universe is judged by the first level that says no, so over the complete universe the answer is exact.
Keys are a url's host and its parent domains: a listed host stands for its subdomains.

A level is a bitmap with its own hash seed, built by grouped bitmap aggregation, and tested by built-in functions on one binary
literal, so the scan of the urls has neither join nor shuffle. The cascade grows with the list, not with the corpus: while it needs at most
MAX_BYTES, some nine million hosts, it passes the driver as bitmaps of 4 KB and goes to the tasks with the plan; a longer list is met by an exact
join of the distinct hosts with it, hot hosts apart.

Edge cases: a null url, or one without "://", has an empty host and path, fits no rule and is allowed; an empty list or an
empty table builds an empty cascade; repeated urls are judged alike; null listed keys are left out; other columns pass through and clashing ones are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselum.llm.common import bind, cut, fresh, join_split, lower_ascii, table

#: Hosts that the method blocks, with their subdomains.
BLOCKED_HOSTS = tuple(f"{name}.example.{end}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org"))
#: (verdict, rule); a rule is a host, then the start of a path. The longest that fits wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Of all levels together, at most; beyond, a join decides.
MAX_BYTES = 16 << 20
LEVELS = 64
#: Bits of a bitmap of the built-in aggregation.
BITMAP = 32_768


@dataclass(frozen=True)
class Level:
    bits: bytes
    hashes: int
    seed: int


class TooLong(ValueError):
    """The cascade would need more than MAX_BYTES."""


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """A host and its parent domains."""
    return bind(F.split(host, "\\."), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    """Double hashing: h1 + i * h2 modulo the bits."""
    h1, h2 = F.xxhash64(key, F.lit(2 * seed)), F.xxhash64(key, F.lit(2 * seed + 1))
    h1, h2 = F.pmod(h1, F.lit(bits)), F.pmod(h2, F.lit(bits))
    return [F.pmod(h1 + i * h2 + i * i, F.lit(bits)) for i in range(hashes)]


def contains(key: Column, level: Level) -> Column:
    def test(bits: Column) -> Column:
        out = F.lit(True)
        for at in _positions(key, 8 * len(level.bits), level.hashes, level.seed):
            # a byte as the character of its number
            byte = F.ascii(F.decode(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
            out = out & (F.bit_get(byte, at.bitwiseAND(7).cast("int")) == 1)
        return out

    return bind(F.lit(level.bits), test)


def _size(n: int, rate: float) -> int:
    """Bytes of the Bloom filter of n keys with the false positive rate `rate`."""
    return max(1, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 8))


def _encode(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """The Bloom filter of n distinct keys (column key) with the false positive rate `rate`."""
    size = _size(n, rate)
    hashes = max(1, round(8 * size / n * math.log(2)))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), 8 * size, hashes, seed))).alias("at"))
    maps = at.groupBy(F.shiftright("at", 15).alias("k")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(BITMAP))).alias("bits"))
    out = bytearray(-(-size * 8 // BITMAP) * BITMAP // 8)
    for r in maps.collect():  # 4 KB each, MAX_BYTES at most
        out[r["k"] * BITMAP // 8 : (r["k"] + 1) * BITMAP // 8] = r["bits"]
    return Level(bytes(out[:size]), hashes, seed)


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """The levels that tell the listed keys from all other keys of the universe. Both have a column key."""
    listed = cut(listed.where(F.col("key").isNotNull()).distinct())
    n = listed.count()
    if not n:
        return []
    universe = universe.where(F.col("key").isNotNull())
    levels: list[Level] = []
    # the sets that the levels encode in turn; the first level is strict enough that what follows is small
    now, other, rate = listed, None, 1e-3
    while n:
        if len(levels) == LEVELS or _size(n, rate) + sum(len(x.bits) for x in levels) > MAX_BYTES:
            raise TooLong(f"{n} keys at level {len(levels)}")
        level = _encode(now, n, rate, len(levels))
        levels.append(level)
        if other is None:
            wrong = universe.where(contains(F.col("key"), level)).distinct().join(listed, "key", "left_anti")
        else:
            wrong = other.where(contains(F.col("key"), level))
        wrong = cut(wrong, forget=True)
        now, other, n, rate = wrong, now, wrong.count(), 0.5 if len(levels) > 1 else 0.05
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: the first level that lacks it decides by its parity."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(~contains(key, levels[i]), F.lit(i % 2 == 1)).otherwise(out)
    return out


def _fits(rule: str, host: Column, path: Column) -> Column:
    name, start = rule.split("/", 1)
    return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")


def _joined(pages: DataFrame, listed: DataFrame, name: str) -> DataFrame:
    """pages with the column `name`: whether the host or a parent domain is listed. One row per distinct host meets the list."""
    hosts = pages.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("key"))
    bad = hosts.join(listed.distinct(), "key", "left_semi").select("host").distinct().withColumn(name, F.lit(True))
    return join_split(pages, cut(bad), "host").withColumn(name, F.coalesce(name, F.lit(False)))


def judge(pages: DataFrame, url: str = "url", *, rules=RULES, blocked=BLOCKED_HOSTS) -> DataFrame:
    """pages with host, path, rule and verdict. blocked: hosts, or a DataFrame with the column key."""
    spark = pages.sparkSession
    pages = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    listed = blocked if isinstance(blocked, DataFrame) else spark.createDataFrame([(x,) for x in dict.fromkeys(blocked)], "key string")
    keep = [c for c in pages.columns if c not in ("rule", "verdict")]
    (own,) = fresh(pages, "_listed")
    try:
        levels = cascade(listed, pages.select(F.explode(suffixes(F.col("host"))).alias("key")))
        is_listed = F.exists(suffixes(F.col("host")), lambda k: member(k, levels))
    except TooLong:
        pages, is_listed = _joined(pages, listed, own), F.col(own)
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: -len(r[1])):
        fits = _fits(text, F.col("host"), F.col("path"))
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    method = F.when(is_listed, F.lit("block")).otherwise(F.lit("allow"))
    return pages.select(*keep, *([own] if own in pages.columns else []), (F.lit(None).cast("string") if rule is None else rule).alias("rule"), (method if verdict is None else verdict.otherwise(method)).alias("verdict")).drop(own)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_HOST = r"coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
ORACLE = (
    f"WITH p AS (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages), "
    "r AS (SELECT *, CASE "
    + " ".join(f"WHEN (host = '{r.split('/', 1)[0]}' OR ends_with(host, '.{r.split('/', 1)[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}') THEN '{r}'" for _, r in sorted(RULES, key=lambda x: -len(x[1])))
    + " END AS rule FROM p) SELECT page_id, host, path, rule, CASE "
    + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in RULES)
    + " ".join([""] + [f"WHEN host = '{h}' OR ends_with(host, '.{h}') THEN 'block'" for h in BLOCKED_HOSTS])
    + " ELSE 'allow' END AS verdict FROM r"
)
