"""Sharding through a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size: an offset, then steps of a skip. In
turn, shards claim their best slot that is still free until the table is full. A row's key is digested to a
slot, and the slot's shard is looked up in the broadcast table: constant time a row and no shuffle. Shares differ
by one slot at most, and a shard that goes or comes moves little besides its own slots.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: Prime; the table has so many rows whatever the data, which bounds what is broadcast.
SLOTS = 65_537


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard's order: ``(offset + j * skip) % slots`` for j = 0, 1, ..."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:15], 16) % slots, int(digest[15:30], 16) % (slots - 1) + 1


def fill_table(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> list[int]:
    """Number of the shard (its place in ``shards``) at each slot; a shard of weight w claims w slots a turn."""
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("from one shard to as many as there are slots are needed, all different")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 0 or not sum(weights):
        raise ValueError("a weight of 0 or more for each shard, not all 0")
    state = [list(preference(s, slots)) for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for i, (at, skip) in enumerate(state):
            for _ in range(weights[i]):
                if not left:
                    break
                while table[at] >= 0:
                    at = (at + skip) % slots
                table[at] = i
                left -= 1
            state[i][0] = at
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of the md5 of its text, modulo the table's size; a null key is the text ``''``."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots


def lookup(spark: SparkSession, table: list[int], slot: str, shard: str) -> DataFrame:
    """The table as rows (slot, shard)."""
    text = ",".join(map(str, table))
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias(slot, shard)).select(F.col(slot).cast("long"), F.col(shard).cast("int"))


def assign_shards(rows: DataFrame, key_col: str, shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    """``rows`` with ``slot`` long and ``shard`` int (they replace columns of these names).

    Every row gets a shard: equal keys the same one, null and empty keys that of the empty text, repeated rows
    each their own row. Other columns stay, whatever their names. An empty table gives an empty one. Texts are never read.
    """
    slot, shard = fresh("slot", rows.columns), fresh("shard", rows.columns)
    table = lookup(rows.sparkSession, fill_table(shards, slots, weights), slot, shard)
    others = [c for c in rows.columns if c.lower() not in ("slot", "shard")]
    placed = rows.withColumn(slot, slot_of(F.col(key_col), slots)).join(F.broadcast(table), slot)
    return placed.select(*others, F.col(slot).alias("slot"), F.col(shard).alias("shard"))


def oracle(shards: list[str], slots: int = SLOTS) -> str:
    """DuckDB SQL that places the documents: the table by a recursion over turns would be slow, so it is a list."""
    table = ",".join(map(str, fill_table(shards, slots)))
    return f"""
        WITH placed AS (
            SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) % {slots} AS slot FROM documents
        ), filled AS (
            SELECT unnest(string_split('{table}', ',')) AS shard, generate_subscripts(string_split('{table}', ','), 1) - 1 AS slot
        )
        SELECT p.doc_id, p.slot, CAST(f.shard AS INTEGER) AS shard FROM placed p JOIN filled f USING (slot)"""
