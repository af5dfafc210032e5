"""Mixing sources to target weights over fixed-length blocks of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, beside, locate, row_key, running_total, settle

#: Words of a block; blocks (slots) of an output shard; weights by source, repeating; most uses of a word.
BLOCK, SHARD_SLOTS, WEIGHTS, CAP = 64, 4096, (5, 2, 1), 3
#: Chunks in which a source's documents are numbered; buckets for looking up a source by its share.
CHUNKS, BUCKETS = 4096, 4096
ROUNDS = 4
#: Output shards of which one task adds up the slots of a source.
SHARD_CHUNK = 256


def _columns(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[Column, Column, list[Column]]:
    text, source = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{source_col}`").cast("string")
    return text, source, row_key(id_col, text, source)


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text, source, key = _columns(docs, id_col, text_col, source_col)
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    size = F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+")))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *key, source.alias("source"), size.cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.0, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """One row per source: number s (by code point, null last), source_size, target in words, blocks and quota.

    Targets share `share` of all words by weight; a target stops at cap times its source's size, and
    the excess is shared again among the others by weight until none is above. That is one water
    level: sorted by cap / weight, the capped sources are a prefix. quota is the target in blocks.
    One row per source meets in one task: sources are names of corpora, not as many as documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.col("s") % len(weights)]
    ranked = ranked.withColumn("w", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    ratio = F.col("most") / F.col("w")
    order = everything.orderBy(ratio, "s")
    here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
    ranked = ranked.withColumn("below", F.sum("most").over(here) - F.col("most")).withColumn("open", F.sum("w").over(everything) - F.sum("w").over(here) + F.col("w"))
    level = (F.col("total") - F.col("below")) / F.col("open")
    ranked = ranked.withColumn("level", F.when(ratio >= level, level))
    ranked = ranked.withColumn("first", F.min(F.when(F.col("level").isNotNull(), F.struct(ratio.alias("at"), "s", "level"))).over(everything))
    target = F.least(F.col("most"), F.coalesce(F.col("first.level") * F.col("w"), F.col("most")))
    blocks = F.expr(f"(source_size + {block - 1}) div {block}")
    out = ranked.select("s", "source", "source_size", target.alias("target"), blocks.alias("blocks"))
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")
    return out.withColumn("quota", F.least(quota, F.col("blocks") * cap))


def permuted(index: Column, size: Column, key: list[Column]) -> Column:
    """A keyed pseudorandom permutation of [0, size): an alternating Feistel network over a grid of
    a x b >= size cells; an index that lands outside walks on, at most as often as there are cells outside."""
    a = F.ceil(F.sqrt(size.cast("double"))).cast("long")
    grid = F.struct(a.alias("a"), F.ceil(size / a).cast("long").alias("b"), size.alias("n"))

    def once(x: Column, g: Column) -> Column:
        state = F.array(F.struct(F.floor(x / g["b"]).cast("long").alias("l"), (x % g["b"]).alias("r")))
        for k in range(ROUNDS):
            noise = lambda v, k=k: F.xxhash64(*key, F.lit(k), v)
            if k % 2 == 0:
                state = F.transform(state, lambda t: F.struct(F.pmod(t["l"] + F.pmod(noise(t["r"]), g["a"]), g["a"]).alias("l"), t["r"].alias("r")))
            else:
                state = F.transform(state, lambda t: F.struct(t["l"].alias("l"), F.pmod(t["r"] + F.pmod(noise(t["l"]), g["b"]), g["b"]).alias("r")))
        return F.transform(state, lambda t: t["l"] * g["b"] + t["r"])[0]

    def walk(g: Column) -> Column:
        out = lambda x: F.when(x < g["n"], x).otherwise(
            F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(g["a"] * g["b"] - g["n"], F.lit(1))), x, lambda y, _: F.when(y < g["n"], y).otherwise(once(y, g)))
        )
        return F.transform(F.array(once(index, g)), out)[0]

    return F.transform(F.array(grid), walk)[0]


def mix_plan(targets: DataFrame, slots: int, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(shard, s, q, block): the blocks that each output shard takes; q counts the slots of a source.

    Each slot of a shard draws its source with the quotas as probabilities, so the counts of a shard
    are multinomial. Slots beyond a source's quota then pass, in order, to the sources that were
    drawn too seldom, so the totals are the quotas. Slot q of a source takes block perm(q mod blocks)
    of pass q div blocks, a new permutation each pass: no block is used twice before all are used once.
    """
    live = targets.filter("quota > 0")
    by = Window.partitionBy(F.lit(0)).orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = live.select("s", "quota", "blocks", F.sum("quota").over(by).alias("last")).withColumn("first", F.col("last") - F.col("quota"))
    width = max(1, slots // BUCKETS)
    spark = targets.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), slots // 1_000_000)
    drawn = spark.range(0, slots, 1, parts).select(F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(slots)).alias("u"))
    counts = locate(drawn, "u", shares.select("s", "first", "last"), "first", "last", width).groupBy("shard", "s").agg(F.count(F.lit(1)).alias("c"))
    counts = settle(counts)
    starts = running_total(counts, ["s"], F.expr(f"cast(shard div {SHARD_CHUNK} as int)"), "c")
    had = live.select("s", "quota", "blocks").join(counts.groupBy("s").agg(F.sum("c").alias("had")), "s", "left").select("s", "quota", "blocks", F.coalesce("had", F.lit(0)).alias("had"))
    over = lambda amount: F.sum(amount).over(by)
    extra, lack = F.greatest(F.col("had") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("had"), F.lit(0))
    moves = had.select("s", "quota", "blocks", "had", (over(extra) - extra).alias("extra_before"), (over(lack) - lack).alias("lack_first"), over(lack).alias("lack_last"))
    # joined while a (shard, source) is one row: what has unfolded looks to a planner as small as what it unfolds from, and would be
    # broadcast. Then dealt out into a fixed number of tasks: adaptive execution would merge so few rows, and they unfold into all slots
    held = starts.join(moves.select("s", "quota", "blocks", "extra_before"), "s").withColumn("end", F.col("start") + F.col("c")).repartition(parts, "shard", "s")
    fits = held.filter("start < quota").select("shard", "s", "blocks", F.explode(F.sequence(F.col("start"), F.least("end", "quota") - 1)).alias("q"))
    # few: about as many as the root of all slots
    shift = F.col("extra_before") - F.col("quota")
    freed = held.filter("end > quota").select("shard", F.explode(F.sequence(F.greatest("start", "quota") + shift, F.col("end") - 1 + shift)).alias("e"))
    takers = moves.select("s", "blocks", "had", "lack_first", "lack_last")
    moved = locate(freed, "e", takers, "lack_first", "lack_last", max(1, slots // BUCKETS)).select("shard", "s", "blocks", (F.col("had") + F.col("e") - F.col("lack_first")).alias("q"))
    slotted = fits.unionByName(moved)
    at = permuted(F.expr("q % blocks"), F.col("blocks"), [F.lit(seed), F.col("s"), F.expr("q div blocks")])
    return slotted.select("shard", "s", "q", at.alias("block"))


def _pieces(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple, share: float, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their targets, and how often the mix takes each piece of a document that lies in one block."""
    sizes = settle(_sizes(docs, id_col, text_col, source_col))
    targets = settle(source_targets(sizes, weights, share, CAP, block))
    slots = targets.agg(F.sum("quota")).first()[0] or 0
    keyed = sizes.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    keyed = keyed.select("doc_id", "k1", "k2", "size", "s", "source_size", "target")
    chunk = F.pmod(F.xxhash64("k1", "k2"), F.lit(CHUNKS)).cast("int")
    spans = settle(running_total(keyed, ["s"], chunk, "size"))
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    cut = spans.filter("size > 0").select("k1", "k2", "s", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    cut = cut.select(
        "k1", "k2", "s", "start", "block", F.greatest(F.col("block") * block - F.col("start"), F.lit(0)).alias("from_word"),
        F.least((F.col("block") + 1) * block - F.col("start"), F.col("size")).alias("to_word"),
    )
    if not slots:
        uses = cut.select("s", "block").limit(0).withColumn("times", F.lit(0).cast("long"))
    else:
        uses = mix_plan(targets, slots, block, SHARD_SLOTS, seed).groupBy("s", "block").agg(F.count(F.lit(1)).alias("times"))
    return spans, cut.join(uses, ["s", "block"])


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = 1.0, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted).

    A source's words are laid out document after document and packed into blocks of `block` words; the
    last block of a source may be shorter. Sources are ordered by code point, null (a source of its
    own) last. A null or empty text has size 0 and is taken 0 times. Rows repeated with the same id,
    text and source lie side by side as documents of their own. An empty table gives no rows.
    """
    spans, pieces = _pieces(docs, id_col, text_col, source_col, weights, share, block, seed)
    words = pieces.groupBy("s", "start", "k1", "k2").agg(F.sum((F.col("to_word") - F.col("from_word")) * F.col("times")).alias("taken"))
    met = spans.join(words, ["s", "start", "k1", "k2"], "left")
    return met.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = 1.0, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """docs as the mix takes them: copy k of a document holds the words of its pieces taken k times or more.

    Columns stay as they are but for the text, which is cut at word limits where only a part is taken;
    an n_chars column follows the text. A document of which nothing is taken has no row. Of rows
    repeated with the same id, text and source, any one lends its other columns to all; these may have any
    names. An empty table, or one without words, gives no rows.
    """
    _, pieces = _pieces(docs, id_col, text_col, source_col, weights, share, block, seed)
    copies = pieces.select("s", "start", "k1", "k2", "from_word", "to_word", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("__copy"))
    spans = copies.groupBy("s", "start", "k1", "k2", "__copy").agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("__spans"))
    # rows repeated with one key have a start each: they take turns
    turn = Window.partitionBy("k1", "k2", "__copy").orderBy("start")
    k1, k2, taken, listed, made = beside(docs, "k1", "k2", "spans", "words", "made")
    spans = spans.withColumn("turn", F.row_number().over(turn))
    key = _columns(docs, id_col, text_col, source_col)[2]
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(key, (k1, k2))])
    if not spans.filter("turn > 1").isEmpty():
        keyed = keyed.dropDuplicates([k1, k2])
    met = keyed.join(spans.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("__spans").alias(taken)), [k1, k2])
    met = met.withColumn(listed, F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)))
    whole = F.aggregate(taken, F.lit(0).cast("long"), lambda n, p: n + p["to_word"] - p["from_word"]) == F.size(listed)
    part = F.array_join(F.flatten(F.transform(taken, lambda p: F.slice(F.col(listed), p["from_word"].cast("int") + 1, (p["to_word"] - p["from_word"]).cast("int")))), "")
    met = met.withColumn(made, F.when(whole, F.col(f"`{text_col}`")).otherwise(part))
    columns = {text_col: F.col(made), "n_chars": F.length(made).cast("long")}
    return met.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns])
