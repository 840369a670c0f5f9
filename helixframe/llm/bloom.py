"""A blocked Bloom filter as a DataFrame: 256-bit blocks, one bit in each of four lanes.

It has a block for every `KEYS` keys, and at most `MOST` blocks, so its broadcast is bounded whatever the number of keys; beyond
that more keys only let more false positives through. No key is ever missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

LANES = 4
KEYS, LEAST, MOST = 16, 1 << 10, 1 << 20


def _bits(key: Column) -> list[Column]:
    """One bit of each 64-bit lane."""
    h = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(LANES)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def blocks_for(n: int) -> int:
    """Blocks of a filter of n keys: a power of two within bounds."""
    return min(MOST, max(LEAST, 1 << (n // KEYS).bit_length()))


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, lane0..lane3) of the keys that are not null: at most `blocks` rows."""
    if blocks > MOST:
        raise ValueError(f"the filter is broadcast: at most {MOST} blocks")
    k = F.col(key)
    return keys.filter(k.isNotNull()).groupBy(_block(k, blocks).alias("block")).agg(*[F.bit_or(b).alias(f"lane{i}") for i, b in enumerate(_bits(k))])


def flag_possible(df: DataFrame, key: str, keys: DataFrame, other: str, name: str, blocks: int | None = None) -> DataFrame:
    """`df` with a boolean `name`: false where `key` is certainly not among `keys.other` (counted first unless `blocks` are given)."""
    blocks = blocks_for(keys.count()) if blocks is None else blocks
    block = fresh(df, "bloom_block")
    lanes = [fresh(df, f"bloom_lane{i}") for i in range(LANES)]
    filter_ = bloom_filter(keys, other, blocks).toDF(block, *lanes)
    probed = df.withColumn(block, _block(F.col(key), blocks)).join(F.broadcast(filter_), block, "left")
    hit = F.lit(True)
    for lane, b in zip(lanes, _bits(F.col(key))):
        hit = hit & (F.col(lane).bitwiseAND(b) != 0)
    return probed.withColumn(name, F.coalesce(hit, F.lit(False))).drop(block, *lanes)
