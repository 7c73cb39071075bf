"""Sharding by a permutation-filled lookup table (operator 2).

Every shard has its own preference order over the slots of a table of prime size (offset and
step from two hashes of its name: ``(offset + k * step) mod size`` visits every slot). The
shards take turns; at its turn a shard claims its first free slot. All shards get almost the
same number of slots, and when a shard leaves, few slots move between the others. The table's
size is a parameter, not a function of the data, so it is broadcast; placing a key is one
hash and one array lookup.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prime, more than 100 times the number of shards.
TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def lookup_table(shards, size: int = TABLE_SIZE) -> np.ndarray:
    """slot -> index of its shard in ``shards`` (distinct names, at most ``size``)."""
    shards = list(shards)
    if not _prime(size):
        raise ValueError("the table size must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct names, at least one and at most the table size")
    digest = [hashlib.md5(s.encode()).digest() for s in shards]
    offset = np.array([int.from_bytes(d[:8], "big") % size for d in digest], np.int64)
    step = np.array([int.from_bytes(d[8:], "big") % (size - 1) + 1 for d in digest], np.int64)
    table = np.full(size, -1, np.int32)
    at, free = offset.copy(), size
    while free:
        for i in range(len(shards)):
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + step[i]) % size
            table[slot] = i
            at[i] = (slot + step[i]) % size
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 60 bits of its MD5, modulo the table size (null: like '')."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % size).cast("int")


def placed(rows: DataFrame, key: Column, shards=SHARDS, size: int = TABLE_SIZE, name: str = "shard") -> DataFrame:
    """``rows`` with ``slot`` and the shard's name; existing columns of these names are replaced.

    Rows meet the table in a broadcast join: ``size`` rows of (slot, name), a fixed bound.
    """
    spark = rows.sparkSession
    table = lookup_table(shards, size)
    names = list(shards)
    lookup = spark.createDataFrame([(int(s), names[i]) for s, i in enumerate(table)], "__slot int, __shard string")
    keep = [c for c in rows.columns if c not in ("slot", name)]
    return (rows.withColumn("__at", slot_of(key, size))
            .join(F.broadcast(lookup), F.col("__at") == F.col("__slot"))
            .select(*keep, F.col("__at").alias("slot"), F.col("__shard").alias(name)))


def shard_documents(docs: DataFrame, shards=SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """Per row of ``docs``: doc_id, slot, shard, and shard_without_last, its place once the
    last shard is gone. A null doc_id has one fixed slot; repeated rows share a shard; an
    empty table gives no rows; other columns are ignored.
    """
    ids = docs.select("doc_id")
    now = placed(ids, F.col("doc_id"), shards, size)
    if len(shards) < 2:
        return now.withColumn("shard_without_last", F.lit(None).cast("string"))
    return placed(now, F.col("doc_id"), shards[:-1], size, "shard_without_last").select(
        "doc_id", "slot", "shard", "shard_without_last")
