"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get a global number 0..n-1 by range-partitioned order; the keyed permutation sends number r to p, and p alone gives
the shard (p mod k) and the slot in it (p div k), so that shards differ by one row at most, slots are
gapless, and any row's place can be computed from its number, or its number from its place (`unpermute`), without
looking at other rows. The permutation acts on the smallest even number of bits that holds n; values of n or more are permuted
again until they fall below n (cycle walking: under 4 rounds expected).

Edge cases: null keys sort first and are numbered like others, a null in another column differs from every value and place; rows equal in every
kept column are interchangeable, so their order doesn't matter; an empty table gives no rows; one row gives shard 0, slot 0. A null
text counts 8 bytes and CRC 0. Clashing columns (`shard`, `slot`) of the input are replaced. A hot key is spread by the
last range key, which differs in every row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselum.llm.common import cut, fresh, ship, table

ROUNDS = 6
SHARDS = 24
SEED = 20_240_607
#: Mixing constants of the round function (odd, 31 bits).
MIX = (0x2C1B3C6D, 0x297A2D39)


def _keys(seed: int) -> list[int]:
    x, out = seed & 0xFFFFFFFFFFFFFFFF, []
    for _ in range(ROUNDS):
        x = (x * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
        out.append(x >> 33)
    return out


def half_bits(n: int) -> int:
    """Bits of each half of the smallest balanced domain that holds n values."""
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _mixed(x: np.ndarray, key: int, mask: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) & np.uint64(0x7FFFFFFF)
    for m in MIX:
        x = (x * np.uint64(m)) & np.uint64(0x7FFFFFFF)
        x ^= x >> np.uint64(15)
    return x & np.uint64(mask)


def feistel(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask = (1 << half) - 1
    left, right = x >> np.uint64(half), x & np.uint64(mask)
    for key in keys:
        left, right = right, left ^ _mixed(right, key, mask)
    return (left << np.uint64(half)) | right


def unfeistel(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask = (1 << half) - 1
    left, right = x >> np.uint64(half), x & np.uint64(mask)
    for key in reversed(keys):
        left, right = right ^ _mixed(left, key, mask), left
    return (left << np.uint64(half)) | right


def _walk(x, n: int, step) -> np.ndarray:
    out = step(np.asarray(x, dtype=np.uint64))
    while len(over := np.flatnonzero(out >= np.uint64(n))):
        out[over] = step(out[over])
    return out.astype(np.int64)


def permute(x, n: int, seed: int = SEED) -> np.ndarray:
    """The places of row numbers x of 0..n-1; a bijection on 0..n-1 (n up to 2^62)."""
    half, keys = half_bits(n), _keys(seed)
    return _walk(x, n, lambda y: feistel(y, half, keys))


def unpermute(x, n: int, seed: int = SEED) -> np.ndarray:
    half, keys = half_bits(n), _keys(seed)
    return _walk(x, n, lambda y: unfeistel(y, half, keys))


def numbered(df: DataFrame, by: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """df with its global row number in the order of `by`, then of 128 hashed bits of the other columns, and the number of rows.

    One range shuffle; the driver sees one count per partition, never a row.
    """
    part, more, at = fresh(df, "_part", "_more", "_at")
    rest = [c for c in df.columns if c not in by]
    # a hash passes nulls over, so each column comes with whether it is null
    marked = [x for c in rest for x in (F.isnull(f"`{c}`"), F.col(f"`{c}`"))]
    ordered = df.withColumns({part: F.xxhash64(*marked, F.lit(1)), more: F.xxhash64(F.lit(2), *marked)})
    # rows equal in all of these are interchangeable; a last random key only deals them out
    keys = [F.col(c).asc_nulls_first() for c in by] + [F.col(part), F.col(more)]
    (tie,) = fresh(ordered, "_tie")
    ordered = ordered.withColumn(tie, F.monotonically_increasing_id())
    keys = [*keys, F.col(tie)]
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(part, more, tie)
    # 31 bits of partition, 33 bits of position in it; kept, since another run could draw other range bounds
    ordered = cut(ordered.withColumn(at, F.monotonically_increasing_id()))
    counts = sorted((r[0], r[1]) for r in ordered.groupBy(F.shiftright(at, 33).alias("p")).agg(F.max(F.col(at).bitwiseAND((1 << 33) - 1)) + 1).collect())
    starts, total = {}, 0
    for p, n in counts:
        starts[p], total = total, total + n
    if not starts:
        return ordered.withColumn(name, F.lit(0).cast("long")).drop(at), 0
    # an array by partition number: its length is the number of shuffle partitions, whatever the rows
    offsets = [starts.get(p, 0) for p in range(max(starts) + 1)]
    number = F.get(F.lit(np.array(offsets, dtype=np.int64)), F.shiftright(at, 33).cast("int")) + F.col(at).bitwiseAND((1 << 33) - 1)
    return ordered.withColumn(name, number).drop(at), total


def shard(df: DataFrame, by: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """df with the columns shard (int) and slot (long)."""
    (number,) = fresh(df, "_number")
    ship(df.sparkSession)
    out, n = numbered(df.drop("shard", "slot"), by, number)

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    out = out.withColumn(number, place(number))
    return out.withColumns({"shard": F.pmod(number, F.lit(shards)).cast("int"), "slot": F.expr(f"{number} div {shards}")}).drop(number)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0).cast("long")).alias("text_crc32"))
    out = shard(rows, ["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
