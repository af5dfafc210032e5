"""Sharding by jump consistent hashing: no ring table, and one more shard only takes rows into itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_total

#: Multiplier of the 64-bit linear congruential generator of the published algorithm.
MULTIPLIER = 2862933555777941757
#: Steps tried first; the jumps of a row outnumber this with a probability below 1e-40.
STEPS = 128
#: (shard, chunk) pairs among which gapless slots are numbered.
CHUNKS = 65_536


def jump_hash(key: str, shards: int) -> Column:
    """The shard from 0 to shards - 1 of the long column named key (null counts as 0).

    The generator's state is unsigned; as decimals it needs no overflowing product:
    (2**64 - 1) * MULTIPLIER has 38 digits.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = "cast(if(v < 0, v + 18446744073709551616BD, v) as decimal(38,0))"
    start = f"named_struct('b', -1L, 'j', 0L, 'k', {state})"
    turned = f"cast((a.k * {MULTIPLIER}BD + 1BD) % 18446744073709551616BD as decimal(38,0))"
    jump = "cast(floor((a.j + 1) * (2147483648D / cast((k div 8589934592BD) + 1 as double))) as bigint)"
    step = f"transform(array({turned}), k -> named_struct('b', a.j, 'j', {jump}, 'k', k))[0]"

    def walk(begin: str, steps: int) -> str:
        return f"aggregate(sequence(1, {steps}), {begin}, (a, i) -> if(a.j >= {shards}, a, {step}))"

    found = "s.b"
    if shards > STEPS:
        found = f"if(s.j >= {shards}, s.b, {walk('s', shards)}.b)"
    once = f"transform(array({walk(start, min(shards, STEPS))}), s -> cast({found} as int))[0]"
    return F.expr(f"transform(array(coalesce(cast(`{key}` as bigint), 0L)), v -> {once})[0]")


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, size (UTF-8 bytes + 1), crc32 of its text, shard, slot and grown_shard.

    law 'key': the id and the number of shards alone decide. slot counts from 0 without gaps inside a
    shard; grown_shard is the shard if there were one shard more. Equal texts with other ids may go to
    other shards. A null id shards as 0; a null text counts as empty; repeated rows share a shard and
    get slots of their own; an empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = rows.withColumns({"shard": jump_hash("doc_id", shards), "grown_shard": jump_hash("doc_id", shards + 1), "__one": F.lit(1).cast("long")})
    chunks = max(1, CHUNKS // shards)
    chunk = F.expr(f"pmod(coalesce(pmod(doc_id, {chunks}), 0) + text_crc32, {chunks})")
    numbered = running_total(placed, ["shard"], chunk, "__one")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("start").alias("slot"), "grown_shard")
