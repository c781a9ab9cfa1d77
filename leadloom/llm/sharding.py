"""Sharding by a permutation-filled lookup table (consistent hashing with a prime-sized table)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest table that is broadcast: entries of about 16 bytes, fixed by the parameter, never by the data.
MAX_SLOTS = 1_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int) -> list[int]:
    """Shard index of each slot: shards take turns, each claiming its most preferred free slot.

    A shard prefers offset, offset + skip, offset + 2 skip ... modulo the prime number of slots, so
    its preferences are a permutation. The work depends on the parameters only.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not _is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    at = [_number(f"{s}#offset") % slots for s in shards]
    skip = [_number(f"{s}#skip") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        k = turn % len(shards)
        while owner[at[k]] >= 0:
            at[k] = (at[k] + skip[k]) % slots
        owner[at[k]] = k
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: the first 32 bits of the MD5 of its text; a null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % F.lit(slots)


def assign_shards(df: DataFrame, key: str, shards: list[str], slots: int = 4099) -> DataFrame:
    """df with `slot` and `shard` added.

    The lookup table has `slots` rows whatever the data are, so it is broadcast; each row finds its
    shard by one hash probe, without a shuffle. Equal keys meet in one shard; when a shard is added
    or removed, few keys besides its own move. Columns of df named slot or shard are replaced; an
    empty df gives an empty result. Names take part in the hash, so they, not their order, decide
    preferences.
    """
    spark = df.sparkSession
    owner = F.split(F.lit(",".join(map(str, fill_table(shards, slots)))), ",")
    names = F.split(F.lit("\n".join(shards)), "\n")
    table = spark.range(1).select(F.posexplode(owner).alias("slot", "k"))
    table = table.select(F.col("slot").cast("long"), F.element_at(names, F.col("k").cast("int") + 1).alias("shard"))
    placed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return placed.join(F.broadcast(table), "slot").select(*[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard")


def oracle(shards: list[str], slots: int) -> str:
    """DuckDB SQL of assign_shards on documents: the table is filled turn by turn in a recursive query."""
    n, rows = len(shards), ", ".join(f"({k}, '{s}')" for k, s in enumerate(shards))

    def number(text: str) -> str:
        return f"(('0x' || left(md5({text}), 8))::BIGINT)"

    offset, skip = number("name || '#offset'"), number("name || '#skip'")
    return f"""
WITH RECURSIVE shards(k, name) AS (VALUES {rows}),
prefs AS (SELECT list({offset} % {slots} ORDER BY k) AS start, list({skip} % {slots - 1} + 1 ORDER BY k) AS skip FROM shards),
fill AS (
  SELECT 0 AS turn, NULL::BIGINT AS slot, list_resize([]::INT[], {slots}, -1) AS owner, start AS nxt, skip FROM prefs
  UNION ALL
  SELECT turn + 1, found, list_concat(owner[:found], [turn % {n}], owner[found + 2:]),
    list_concat(nxt[:turn % {n}], [(found + skip[turn % {n} + 1]) % {slots}], nxt[turn % {n} + 2:]), skip
  FROM (SELECT *, list_filter(list_transform(range({slots}), lambda j: (nxt[turn % {n} + 1] + j * skip[turn % {n} + 1]) % {slots}),
    lambda s: owner[s + 1] = -1)[1] AS found FROM fill WHERE turn < {slots})),
owners AS (SELECT slot, (turn - 1) % {n} AS k FROM fill WHERE turn > 0)
SELECT doc_id, slot, name AS shard
FROM (SELECT doc_id, {number("coalesce(CAST(doc_id AS VARCHAR), '')")} % {slots} AS slot FROM documents) JOIN owners USING (slot) JOIN shards USING (k)
"""
