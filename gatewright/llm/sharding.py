"""Shard placement by a permutation-filled lookup table.

Each shard has a preference order of the slots of a prime-sized table, (offset + i * skip) mod size with offset and
skip from hashes of its name; shards take turns in claiming the first slot of their order that is still free. Slots
are shared evenly to within one, and few of them change owner when a shard comes or goes. The table's size is a
parameter and does not grow with the data, so it is broadcast: a row finds its shard by one lookup of its key's slot.

Defined results: a null key goes where the empty text goes; equal keys share a shard; an empty table gives no rows.
Columns of the input stay; slot and shard replace any of those names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 4099
SHARDS = tuple(f"shard-{i:03d}" for i in range(32))
MAX_SLOTS = 1 << 20


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[str]:
    """The owner of each slot. slots: a prime of at most 2^20 and at least the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must have names, each a different one")
    if not len(shards) <= slots <= MAX_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime from the number of shards to 2^20")
    at = [_hash(s, "offset") % slots for s in shards]
    skip = [_hash(s, "skip") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    owner: list[str | None] = [None] * slots
    left = slots
    while left:
        for i, name in enumerate(shards):
            while owner[at[i]] is not None:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = name
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with its rows' slot and shard."""
    table = df.sparkSession.createDataFrame(list(enumerate(lookup_table(shards, slots))), "slot int, shard string")
    return df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(table), "slot").select(*[f"`{c}`" for c in df.columns if c not in ("slot", "shard")], "slot", "shard")
