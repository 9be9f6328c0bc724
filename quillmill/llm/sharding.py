"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a table of prime size, from two hashes of its name. Shards take turns:
each claims the first slot of its permutation that is still free, until all slots are taken. So shards differ by one
slot at most, and a shard that comes or goes moves little more than its own share. A row's key hashes to a slot, and a
broadcast table of the slots, whose size is a parameter and not that of the data, gives its shard in constant time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A prime, at least a hundred times the number of shards.
TABLE_SIZE = 65_537


def number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The index of the shard that owns each slot."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, one at least, no more than slots")
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime, else a permutation misses slots")
    at = [number(s, "offset") % size for s in shards]
    skip = [number(s, "skip") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    free = size
    while free:
        for k in range(min(len(shards), free)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            owner[at[k]] = k
            free -= 1
    return owner


def assign(df: DataFrame, shards: Sequence[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """Adds slot (int) and shard (string) to every row; columns of these names are replaced.

    Equal keys share a shard; null keys all have the slot of the hash of null. No row moves: placement is a lookup."""
    schema = T.StructType([T.StructField("_slot", T.IntegerType()), T.StructField("shard", T.StringType())])
    table = df.sparkSession.createDataFrame([(k, shards[s]) for k, s in enumerate(fill(shards, size))], schema)
    kept = df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard", "_slot")])
    slots = kept.withColumn("slot", F.pmod(F.xxhash64(F.col(key)), F.lit(size)).cast("int"))
    return slots.join(F.broadcast(table), F.col("slot") == F.col("_slot")).drop("_slot")
