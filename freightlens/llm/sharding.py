"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size. The shards
take turns; at its turn a shard claims the first slot in its order that is still free. A document's
hash picks a slot and the slot's owner is its shard: one lookup in a table of fixed size, near-equal
shards, and few moves when a shard comes or goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime, and about a hundred slots for each of 32 shards: shares differ by some percent at most.
TABLE_SIZE = 4099
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def fill(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The owner (position in `shards`) of each slot. `size` is prime, so each shard's steps
    offset + j * skip visit every slot once."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, and from one to the table's size")
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    at = [_number(f"{s}:offset") % size for s in shards]
    skip = [_number(f"{s}:skip") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    for claim in range(size):
        s = claim % len(shards)
        while owner[at[s]] >= 0:
            at[s] = (at[s] + skip[s]) % size
        owner[at[s]] = s
    return owner


def lookup(spark: SparkSession, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """slot, shard: `size` rows whatever the data."""
    return spark.createDataFrame([(slot, shards[s]) for slot, s in enumerate(fill(shards, size))], "slot int, shard string")


def slot_of(key: Column, size: int = TABLE_SIZE, salt: str = "place") -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10)
    return F.pmod(bits.cast("bigint"), F.lit(size)).cast("int")


def place(docs: DataFrame, *, key: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """docs with slot and shard (columns of these names are replaced).

    - null key: as the empty text, so in one fixed shard. Equal keys: the same shard.
    - a hot key fills one shard; place by doc_id, or by several columns joined, where keys are hot.
    - empty table: empty result. Texts are not read.
    The lookup table has `size` rows, so it is sent to all tasks and no document is shuffled.
    """
    kept = [c for c in docs.columns if c not in ("slot", "shard")]
    rows = docs.select(F.struct(*kept).alias("row"), slot_of(F.col(key), size).alias("slot"))
    return rows.join(F.broadcast(lookup(docs.sparkSession, shards, size)), "slot", "left").select(*[F.col("row")[c].alias(c) for c in kept], "slot", "shard")
