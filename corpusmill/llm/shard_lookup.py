"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size:
offset, offset + skip, offset + 2 skip, ... modulo the size. Shards take turns;
at its turn a shard claims its first free slot. A shard with weight w takes w
turns a round. So shares differ by at most a turn, and when a shard leaves, few
slots of the others change. A key goes to the shard in slot hash(key) mod size:
one lookup in a broadcast table whose size is the chosen prime, whatever the data.

A placement depends on the key alone: a key that holds a third of all rows fills
one shard, unless `spread` columns (an id, say) are hashed along with it.

Nulls: a null in the key counts as its own value; every row is placed, repeated rows
in the same shard. Input columns slot and shard are replaced (they may be keys), all
others pass through. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The table's default size: a prime far above the number of shards.
SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """(offset, skip) of a shard's order over the slots."""
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1


def lookup_table(shards: list[str] | dict[str, int], size: int = SIZE) -> np.ndarray:
    """slot -> position of its shard in the sorted list of names."""
    weights = shards if isinstance(shards, dict) else dict.fromkeys(shards, 1)
    names = sorted(weights)
    if not _is_prime(size) or not 0 < sum(weights.values()) <= size or min(weights.values()) < 1:
        raise ValueError("the size must be a prime and at least the sum of the weights, which are positive")
    where = [preference(n, size) for n in names]
    at, skip = [w[0] for w in where], [w[1] for w in where]
    table, free = [-1] * size, size
    while free:
        for i, name in enumerate(names):
            for _ in range(weights[name]):
                slot = at[i]
                while table[slot] >= 0:
                    slot = (slot + skip[i]) % size
                table[slot], at[i] = i, (slot + skip[i]) % size
                free -= 1
                if not free:
                    return np.array(table, np.int32)
    return np.array(table, np.int32)


def slot_of(key: list[str], size: int = SIZE) -> Column:
    """60 bits of the MD5 of the key columns as text, modulo the table's size."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in key])
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % size).cast("int")


def assign_shards(df: DataFrame, shards: list[str] | dict[str, int], key: list[str], spread: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """df plus slot and shard; one row for each row of df, nothing is shuffled."""
    names, table = sorted(shards), lookup_table(shards, size)
    rows = df.sparkSession.createDataFrame([(i, names[s]) for i, s in enumerate(table.tolist())], "__slot int, shard string")
    own = df.withColumn("__own", slot_of([*key, *(spread or [])], size)).drop("slot", "shard").withColumnRenamed("__own", "slot")
    return own.join(F.broadcast(rows), F.col("slot") == F.col("__slot"), "left").drop("__slot")
