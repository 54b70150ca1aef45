"""A blocked Bloom filter as a table: one row per block, built and asked with SQL functions.

Each key sets a few bits in one block of four 64-bit words. There is a block for every ``KEYS_PER_BLOCK``
keys, so about the same share of strangers passes at every size, well below 5 %; no key is ever lost. An exact join
follows. Up to ``BROADCAST_BLOCKS`` the table is broadcast, 10 MB at most; a larger one is joined by shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

KEYS_PER_BLOCK = 16
LEAST_BLOCKS = 1 << 10
BROADCAST_BLOCKS = 1 << 18
WORDS = 4
BITS_PER_WORD = 2


class BloomFilter(NamedTuple):
    table: DataFrame
    blocks: int


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """The bits that a key sets in each word of its block."""
    spread = F.xxhash64(key, F.lit("bits"))
    masks = []
    for word in range(WORDS):
        mask = F.lit(0).cast("long")
        for bit in range(BITS_PER_WORD):
            place = F.shiftrightunsigned(spread, 6 * (BITS_PER_WORD * word + bit)).bitwiseAND(F.lit(63)).cast("int")
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
        masks.append(mask)
    return masks


def bloom_filter(keys: DataFrame, key: str, at_most: int | None = None) -> BloomFilter:
    """The filter of a key column; nulls are left out.

    Its size follows the rows of ``keys``, which are counted (pass stored tables, of which this reads the file
    footers), or ``at_most``, a bound of them.
    """
    rows = keys.count() if at_most is None else at_most
    blocks = max(LEAST_BLOCKS, 1 << (rows // KEYS_PER_BLOCK).bit_length())
    bits = [mask.alias(f"_llm_mask{i}") for i, mask in enumerate(_masks(F.col(key)))]
    table = (
        keys.where(F.col(key).isNotNull())
        .select(_block(F.col(key), blocks).alias("_llm_block"), *bits)
        .groupBy("_llm_block")
        .agg(*(F.bit_or(f"_llm_mask{i}").alias(f"_llm_bits{i}") for i in range(WORDS)))
    )
    return BloomFilter(table, blocks)


def with_possible(df: DataFrame, key: str, of: BloomFilter, name: str) -> DataFrame:
    """Add a boolean column: may the key be among those of the filter? Null keys are not."""
    asked = df.withColumn("_llm_asked", _block(F.col(key), of.blocks))
    table = F.broadcast(of.table) if of.blocks <= BROADCAST_BLOCKS else of.table
    joined = asked.join(table, F.col("_llm_asked") == F.col("_llm_block"), "left")
    held = F.col("_llm_block").isNotNull() & F.col(key).isNotNull()
    for i, mask in enumerate(_masks(F.col(key))):
        held = held & (F.col(f"_llm_bits{i}").bitwiseAND(mask) == mask)
    own = [F.col(c) for c in df.columns if c != name]
    return joined.select(*own, F.coalesce(held, F.lit(False)).alias(name))
