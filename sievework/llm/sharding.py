"""Shard placement by a permutation-filled lookup table.

Every shard derives a permutation of a prime number of slots from its name. Shards take turns, each
claiming the next slot of its own permutation that is still free, until the table is full: shares differ
by one slot at most, and adding or removing a shard moves few keys. The table has a fixed size, set by
``slots``, so it is broadcast and placing a row is one hash and one lookup, without a shuffle.

Null keys are placed as the empty string, and very long ones as a whole; equal keys, and so repeated rows, go to one
shard; an empty input gives no rows. Columns named like the outputs are replaced, other names don't matter.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The table is broadcast, hence a hard bound on its rows.
MAX_SLOTS = 2_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = 65_537) -> list[int]:
    """Index of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, one at least")
    if not is_prime(slots) or slots > MAX_SLOTS or slots < len(shards):
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    start = [_number(f"start:{s}") % slots for s in shards]
    step = [_number(f"step:{s}") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while owner[start[i]] >= 0:
                start[i] = (start[i] + step[i]) % slots
            owner[start[i]] = i
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: 60 bits of its MD5 modulo the table's size."""
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(slots))


def place(df: DataFrame, key: str, shards: list[str], slots: int = 65_537, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with its slot and shard appended; columns of these names are replaced."""
    spark, owner = df.sparkSession, lookup_table(shards, slots)
    at = df.drop(*[c for c in (slot_col, shard_col) if c in df.columns and c != key])
    table = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(owner)], f"`{slot_col}` long, `{shard_col}` string")
    return at.withColumn(slot_col, slot_of(F.col(f"`{key}`"), slots)).join(F.broadcast(table), slot_col).select(
        *[f"`{c}`" for c in at.columns], slot_col, shard_col
    )


def write_shards(
    df: DataFrame, path: str, key: str, shards: list[str], slots: int = 65_537, files_per_shard: int = 1, shard_col: str = "shard"
) -> None:
    """One folder per shard, named by shard_col, which replaces a column of that name; every other column is written as it
    is. Rows are dealt by shard and a salt, so that no shard has to fit one task."""
    fresh = lambda name: name if name not in df.columns else fresh(f"_{name}")
    slot, salt = fresh("slot"), fresh("salt")
    placed = place(df, key, shards, slots, slot, shard_col).withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(max(1, files_per_shard))))
    dealt = placed.repartition(len(shards) * max(1, files_per_shard), shard_col, salt)
    dealt.drop(slot, salt).write.partitionBy(shard_col).parquet(path)
