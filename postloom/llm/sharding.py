"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table (a start and a stride from its name's
digest). Shards take turns claiming the best slot that is still free, heavier shards several a turn, until the table
is full: shares differ by a slot or so, and when a shard comes or goes, few other slots change hands. A row's key is
hashed to a slot, and the table, whose size is fixed by its parameter and not by the data, is broadcast: one lookup a
row and no shuffle, so hot keys, copies and lost executors need no care.

Cases: a null key is placed by the digest of the row's text where there is one, so that rows without a key spread;
rows that repeat a key share a shard; an empty table gives no rows; texts of any length are hashed whole; other columns
are passed through unchanged, but columns named slot and shard give way to the results.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537  # prime; bounds the broadcast
SHARDS = 256


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: dict[str, int], slots: int = SLOTS) -> np.ndarray:
    """The shard, as an index into sorted(shards), that owns each slot; shards maps names to whole weights."""
    if not is_prime(slots) or not shards or len(shards) > slots or min(shards.values()) < 1:
        raise ValueError("a table needs a prime number of slots, no fewer than shards, and weights of 1 or more")
    names = sorted(shards)
    seeds = [hashlib.sha256(x.encode()).digest() for x in names]
    at = [int.from_bytes(s[:8]) % slots for s in seeds]
    stride = [int.from_bytes(s[8:16]) % (slots - 1) + 1 for s in seeds]
    table, left = [-1] * slots, slots
    while True:
        for k, name in enumerate(names):
            for _ in range(shards[name]):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + stride[k]) % slots
                table[at[k]] = k
                left -= 1
                if not left:
                    return np.array(table, np.int32)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def assign_shards(df: DataFrame, key: str, shards: dict[str, int], slots: int = SLOTS, fallback: str | None = None) -> DataFrame:
    """df with slot and shard (a name): the slot of key's hash, or of fallback's where key is null."""
    names = sorted(shards)
    table = df.sparkSession.createDataFrame(
        [(i, names[k]) for i, k in enumerate(fill_table(shards, slots).tolist())], "slot int, shard string")
    slot = slot_of(F.col(key), slots)
    if fallback is not None:
        slot = F.when(F.col(key).isNull(), slot_of(F.col(fallback), slots)).otherwise(slot)
    kept = df.drop("slot", "shard")  # a column of that name in the input gives way
    return kept.withColumn("slot", slot).join(F.broadcast(table), "slot").select(*kept.columns, "slot", "shard")


def shard_names(n: int = SHARDS) -> dict[str, int]:
    return {f"shard-{i:05d}": 1 for i in range(n)}
