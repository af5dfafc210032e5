"""Exact dedup by deterministic block naming: integer names of blocks, then of pairs of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, settle

#: Characters of a block.
BLOCK = 4096


def _blocks(rows: DataFrame, block: int, route_bits: int) -> DataFrame:
    """(row, n, i, route, block): the i-th of the n blocks of a text; the empty text is one empty block."""
    cut = rows.select("row", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)).alias("cut"))
    cut = cut.withColumn("cut", F.when(F.size("cut") == 0, F.array(F.lit(""))).otherwise(F.col("cut")))
    rows = cut.select("row", F.size("cut").alias("n"), F.posexplode("cut").alias("i", "block"))
    route = F.xxhash64("block")
    return rows.withColumn("route", route if route_bits >= 64 else F.pmod(route, F.lit(1 << route_bits).cast("long")))


def _named(distinct: DataFrame, order: list[str], name: Column) -> DataFrame:
    """Integer names of distinct rows: the position in a sorted hash partition, unique over all of them."""
    return distinct.sortWithinPartitions(*order).withColumn("name", name)


def identities(rows: DataFrame, block: int = BLOCK, route_bits: int = 64) -> DataFrame:
    """(row, level, name) for rows (row, text) that are the same whenever they are read; texts are equal
    exactly if they agree in (level, name).

    Every block of every text is sorted among the distinct blocks and gets an integer name; then
    adjacent names are paired and the distinct pairs named, level by level, until a text has one name.
    A block's hash only routes it to its name: where two different blocks share a hash, both are named
    and met by their full content instead, so the identity is free of collisions.
    """
    cut = _blocks(rows, block, route_bits)
    up, down = F.monotonically_increasing_id(), -2 - F.monotonically_increasing_id()
    names = settle(_named(cut.select("route", "block").distinct(), ["route", "block"], up).select("route", "name"))
    clash = names.groupBy("route").count().filter("count > 1").select("route")
    if clash.isEmpty():
        level = cut.select("row", "n", "i", "route").join(names, "route").drop("route")
    else:
        plain = cut.join(clash, "route", "left_anti").select("row", "n", "i", "route").join(names, "route").drop("route")
        odd = cut.join(clash, "route", "left_semi")
        full = settle(_named(odd.select("block").distinct(), ["block"], down))
        level = plain.unionByName(odd.select("row", "n", "i", "block").join(full, "block").drop("block"))
    level, depth, done = settle(level), 0, []
    while True:
        done.append(level.filter("n = 1").select("row", F.lit(depth).alias("level"), "name"))
        rest = level.filter("n > 1")
        if rest.isEmpty():
            break
        side = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
        none = F.lit(-1).cast("long")  # the last name of an odd row stands alone
        pairs = rest.groupBy("row", F.expr("cast((n + 1) div 2 as int)").alias("n"), F.expr("cast(i div 2 as int)").alias("i")).agg(
            side(0).alias("left"), F.coalesce(side(1), none).alias("right")
        )
        named = settle(_named(pairs.select("left", "right").distinct(), ["left", "right"], up))
        level, depth = settle(pairs.join(named, ["left", "right"]).select("row", "n", "i", "name")), depth + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _grouped(rows: DataFrame, block: int, route_bits: int, *more: Column) -> DataFrame:
    """(row, doc_id, *more, keep_id, keep_row, group_size) of numbered rows. Of the rows that have the largest id in
    their group, that with the least of the last of `more`, then with the least number, stays."""
    known = rows.select("row", "doc_id", *more).join(settle(identities(rows, block, route_bits)), "row")
    last = known.columns[len(more) + 1]
    order = F.struct(F.bitwise_not("doc_id").alias("i"), F.col(last).alias("t"), F.col("row").alias("r"))
    first = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), order)), F.min(order))
    groups = known.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), first["r"].alias("keep_row"), F.count(F.lit(1)).alias("group_size"))
    return known.join(settle(groups), ["level", "name"]).drop("level", "name")  # settled: both sides are dealt anew, and a hot group can be split


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, route_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without any change; null counts as empty. Of equal texts the row
    with the largest doc_id stays. A null id is less than any other: it stays, and keep_id is null,
    only in a group without ids. Of rows repeated with the same id and text one stays; rows that only share an
    id are told apart by numbers of their own. An empty table gives no rows; other columns are not read.
    """
    rows = _grouped(numbered(docs, id_col, text_col), block, route_bits, F.sha2("text", 256).alias("text_sha256"))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of docs that stay, with all their columns; see exact_groups.

    Rows repeated with the same id and text may differ in other columns; the first in their order stays. Other
    columns may have any names.
    """
    kinds = [kind for _, kind in docs.dtypes]
    rest = F.to_json(F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in (id_col, text_col)]))
    held = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if kinds[k] != "void" and (c != text_col or kinds[k] != "string")]
    rows = numbered(docs, id_col, text_col, F.col(f"`{text_col}`").isNull().alias("none"), rest.alias("rest"), *held)
    stay = _grouped(rows.select("row", "doc_id", "text", "rest"), block, 64, F.col("rest")).filter("row = keep_row").select("row")

    def back(k: int, name: str) -> Column:
        if kinds[k] == "void":
            return F.lit(None).alias(name)
        return (F.when(~F.col("none"), F.col("text")) if name == text_col and kinds[k] == "string" else F.col(f"c{k}")).alias(name)

    return rows.join(stay, "row", "left_semi").select(*[back(k, c) for k, c in enumerate(docs.columns)])
