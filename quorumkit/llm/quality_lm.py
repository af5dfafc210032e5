"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of bytes, trained on trusted text."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import arrow_rows, beside, row_key, settle

#: Bytes of an n-gram; an n-gram is the integer of its bytes, so contexts and suffixes are shifts and masks.
ORDER = 5
#: Documents with ids in one range of so many are scored together, unless they have more bytes than MOST_BYTES; bytes of
#: text that are worked on at once.
BLOCK, MOST_BYTES, STEP = 4096, 48_000_000, 2_000_000
#: Rows of an Arrow batch of texts.
ARROW_ROWS = 512
#: What goes through shuffles is packed well: they take the most disk.
ZSTD = pa.Codec("zstd", compression_level=9)
#: Most n-grams that a task holds before it hands them on.
MOST_GRAMS = 4_000_000
#: The quantile of trusted documents' ratings, by language, above which a document is rejected.
QUANTILE = 0.995
#: Roles of trusted documents: the model is trained on some, the thresholds are set by the others.
TRAIN, HELD, HELD_OUT_OF = 1, 2, 5
#: A language's quantile is drawn to that of all languages as by so many documents.
DRAWN = 30
#: The least quartile range of a language's logarithms of ratings.
LEAST_SPREAD = 0.01
#: Discounts where they can't be estimated.
FALLBACK = (0.5, 1.0, 1.5)
#: Bytes of usual text that every document is given before it is rated.
PRIOR_BYTES = 200
#: Most trusted ids that are broadcast (8 bytes each); beyond, they are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def gram_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of each text, text after text, and the texts' lengths. A text begins after zero bytes."""
    pad = b"\0" * (ORDER - 1)
    data = np.frombuffer(pad + pad.join(texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = data[ORDER - 1 :].astype(np.uint64)
    for k in range(1, ORDER):
        codes |= data[ORDER - 1 - k : data.size - k].astype(np.uint64) << np.uint64(8 * k)
    inside = np.ones(codes.size, bool)
    gaps = np.cumsum(lengths + ORDER - 1)[:-1] - (ORDER - 1)
    inside[(gaps[:, None] + np.arange(ORDER - 1)[None, :]).ravel()] = False
    return codes[inside], lengths


def pack(codes: np.ndarray) -> bytes:
    """Ascending integers as compressed differences."""
    raw = np.diff(codes.astype(np.int64), prepend=0).tobytes()
    return len(raw).to_bytes(8, "little") + ZSTD.compress(raw, asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    return np.cumsum(np.frombuffer(ZSTD.decompress(blob[8:], n, asbytes=True), np.int64)) if n else np.zeros(0, np.int64)


def _sum_by(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if codes.size else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if codes.size else counts


def _cuts(sizes: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `step` bytes."""
    at = 0
    while at < len(sizes):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), step)))
        yield at, min(end, len(sizes))
        at = end


def _text_runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch that lie in one block and have about STEP bytes."""
    blocks = batch.column("block").to_numpy(zero_copy_only=False)
    for block in np.unique(blocks):
        own = batch.take(pa.array(np.flatnonzero(blocks == block))) if blocks[0] != blocks[-1] or (blocks != block).any() else batch
        sizes = np.asarray(pa.compute.binary_length(own.column("text")), dtype=np.int64)
        for lo, hi in _cuts(sizes, STEP):
            yield int(block), own.slice(lo, hi - lo)


def _bytes_of(part: pa.RecordBatch) -> list[bytes]:
    return part.column("text").cast(pa.binary()).to_pylist()


def _gather(shards: int):
    """Rows (kind, shard, block, blob, counts): the distinct n-grams of each block (kind 1), and n-grams of
    trusted text with their counts (kind 0), dealt into shards by value."""

    def rows(kind: int, block: int | None, codes: np.ndarray, counts: np.ndarray | None) -> dict[str, list]:
        out: dict[str, list] = {"kind": [], "shard": [], "block": [], "blob": [], "counts": []}
        shard = codes.astype(np.int64) % shards
        order = np.argsort(shard, kind="stable")  # codes stay ascending inside a shard
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(ends)):
            at = order[ends[s] : ends[s + 1]]
            values = {"kind": kind, "shard": int(s), "block": block, "blob": pack(codes[at]), "counts": None if counts is None else counts[at].astype("<i8").tobytes()}
            for k, v in values.items():
                out[k].append(v)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        sums = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sums
            for r in (*(rows(1, b, c, None) for b, c in blocks.items()), rows(0, None, *sums)):
                yield pa.RecordBatch.from_pydict(r, schema=pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("blob", pa.binary()), ("counts", pa.binary())]))
            blocks.clear()
            sums = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        for batch in batches:
            for block, part in _text_runs(batch):
                codes, lengths = gram_codes(_bytes_of(part))
                trusted = np.repeat(np.asarray(part.column("role")) == TRAIN, lengths)
                found, n = np.unique(codes[trusted], return_counts=True)
                sums = _sum_by(np.concatenate((sums[0], found)), np.concatenate((sums[1], n)))
                codes = np.unique(codes)
                blocks[block] = np.union1d(blocks[block], codes) if block in blocks else codes
            if sum(c.size for c in blocks.values()) + sums[0].size > MOST_GRAMS:
                yield from flush()
        yield from flush()

    return run


def _distinct_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of all blocks, once each; all rows of a shard are in this partition."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist()):
            codes = unpack(blob)
            held[shard] = np.union1d(held[shard], codes) if shard in held else codes
    for codes in held.values():
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64())], names=["code"])


def _summed_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for shard, blob, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "blob", "counts"))):
            codes, n = unpack(blob), np.frombuffer(counts, "<i8")
            if shard in held:
                codes, n = _sum_by(np.concatenate((held[shard][0], codes)), np.concatenate((held[shard][1], n)))
            held[shard] = codes, n
    for codes, n in held.values():
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "c"])


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The log probabilities of each block's n-grams. Rows are sorted by shard; the model's come first."""
    shard, codes, logs = None, [], []
    table: tuple[np.ndarray, np.ndarray] | None = None
    for batch in batches:
        keys, kinds = np.asarray(batch.column("shard")), np.asarray(batch.column("kind"))
        change = np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(keys)]):
            part = batch.slice(lo, hi - lo)
            if keys[lo] != shard:
                shard, codes, logs, table = keys[lo], [], [], None
            if kinds[lo] == 0:
                codes.append(np.asarray(part.column("code")))
                logs.append(np.asarray(part.column("logp")))
                continue
            if table is None:
                order = np.argsort(np.concatenate(codes))
                table = np.concatenate(codes)[order], np.concatenate(logs)[order].astype("<f4")
                if not np.isfinite(table[1]).all():
                    raise ValueError("an n-gram has no probability")
            blobs = part.column("blob").to_pylist()
            found = [table[1][np.searchsorted(table[0], unpack(b))].tobytes() for b in blobs]
            yield pa.RecordBatch.from_arrays([part.column("block"), pa.array(blobs, pa.binary()), pa.array(found, pa.binary())], names=["block", "blob", "logs"])


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a block as packed Arrow messages."""
    for batch in batches:
        for block, part in _text_runs(batch):
            sink = pa.BufferOutputStream()
            part = pa.RecordBatch.from_struct_array(part.select([n for n in part.schema.names if n != "block"]).to_struct_array().take(pa.array(np.arange(part.num_rows))))
            with pa.ipc.new_stream(sink, part.schema) as w:
                w.write_batch(part)
            raw = sink.getvalue()
            blob = raw.size.to_bytes(8, "little") + ZSTD.compress(raw, asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([blob], pa.binary())], names=["block", "blob"])


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their bytes and negative log probability. Rows are sorted by block; its n-grams come first."""
    block, codes, logs = None, [], []
    table: tuple[np.ndarray, np.ndarray] | None = None
    for batch in batches:
        for b, kind, blob, found in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "blob", "logs"))):
            if b != block:
                block, codes, logs, table = b, [], [], None
            if kind == 0:
                codes.append(unpack(blob))
                logs.append(np.frombuffer(found, "<f4"))
                continue
            if table is None and codes:
                keys, first = np.unique(np.concatenate(codes), return_index=True)
                table = keys, np.concatenate(logs)[first].astype(np.float64)
            part = pa.ipc.open_stream(ZSTD.decompress(blob[8:], int.from_bytes(blob[:8], "little"))).read_next_batch()
            grams, lengths = gram_codes(_bytes_of(part))
            total = np.zeros(len(lengths))
            if grams.size:
                each = np.concatenate(([0.0], np.cumsum(table[1][np.searchsorted(table[0], grams.astype(np.int64))])))
                ends = np.cumsum(lengths)
                total = each[ends - lengths] - each[ends]
            meta = [part.column(c) for c in ("doc_id", "k1", "k2", "lang", "role")]
            yield pa.RecordBatch.from_arrays([*meta, pa.array(lengths), pa.array(total)], names=["doc_id", "k1", "k2", "lang", "role", "n_bytes", "nll"])


def _low(order: int) -> Column:
    return F.lit((1 << (8 * order)) - 1).cast("long")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the numbers of n-grams with counts 1 to 4.

    Where these numbers don't fall as they do in open text (short n-grams of much text are all seen
    often), the estimates leave their range; FALLBACK stands for them, so that no n-gram has probability 0.
    """
    if min(n1, n2, n3, n4) < 1:
        return FALLBACK
    y = n1 / (n1 + 2 * n2)
    found = tuple(k - (k + 1) * y * b / a for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
    return found if all(0 < d < k for k, d in enumerate(found, 1)) else FALLBACK


def kneser_ney(grams: DataFrame, asked: DataFrame) -> DataFrame:
    """(code, logp): the log probability of the last byte of each asked n-gram (code, distinct) after the others.

    grams: (code, c), the counted n-grams of the highest order. Lower orders count in how many different
    n-grams of the next order they end. At each order an n-gram's discounted share is joined with its
    context's weight and with the probability of its suffix; the lowest order is interpolated with an
    equal share of 256 bytes. Tables meet by equality of n-grams, contexts and suffixes only.
    """
    orders = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = settle(orders[k + 1].groupBy(F.col("code").bitwiseAND(_low(k)).alias("code")).agg(F.count(F.lit(1)).alias("c")))
    stats = None
    for k, g in orders.items():
        row = g.agg(F.lit(k).alias("k"), *[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)], F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n"))
        stats = row if stats is None else stats.unionByName(row)
    known = {r["k"]: r for r in stats.collect()}  # five rows
    questions = {ORDER: asked}
    for k in range(ORDER - 1, 0, -1):
        questions[k] = questions[k + 1].select(F.col("code").bitwiseAND(_low(k)).alias("code")).distinct()
    below = None
    for k in range(1, ORDER + 1):
        r = known[k]
        d = discounts(r["n1"], r["n2"], r["n3"], r["n4"])
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        g = orders[k].withColumn("d", cut)
        if k == 1:
            freed = (d[0] * r["n1"] + d[1] * r["n2"] + d[2] * (r["n"] - r["n1"] - r["n2"])) / r["total"] if r["total"] else 1.0
            share = g.select("code", ((F.col("c") - F.col("d")) / F.lit(float(r["total"] or 1))).alias("a"))
            p = questions[1].join(share, "code", "left").select("code", (F.coalesce("a", F.lit(0.0)) + freed / 256).alias("p"))
        else:
            g = g.withColumn("context", F.shiftright("code", 8))
            contexts = g.groupBy("context").agg(F.sum("c").alias("all"), F.sum("d").alias("freed"))
            share = g.join(contexts, "context").select("code", ((F.col("c") - F.col("d")) / F.col("all")).alias("a"))
            weights = contexts.select("context", (F.col("freed") / F.col("all")).alias("w"))
            q = questions[k].select("code", F.shiftright("code", 8).alias("context"), F.col("code").bitwiseAND(_low(k - 1)).alias("suffix"))
            q = q.join(share, "code", "left").join(weights, "context", "left").join(below.select(F.col("code").alias("suffix"), F.col("p").alias("q")), "suffix")
            p = q.select("code", (F.coalesce("a", F.lit(0.0)) + F.coalesce("w", F.lit(1.0)) * F.col("q")).alias("p"))
        below = settle(p)
    return below.select("code", F.log("p").alias("logp"))


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, k1, k2, lang, role, n_bytes, nll) for each row of docs; trusted: (doc_id, role), those with
    role TRAIN to train on."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    spread = -1 - F.pmod(F.xxhash64(text), F.lit(1024))
    span = F.coalesce(F.expr(f"cast(`{id_col}` as long) div {BLOCK}"), spread)
    sizes = settle(docs.groupBy(span.alias("span")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text).cast("long")).alias("bytes")))
    n, few = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], trusted.count() <= BROADCAST_IDS
    shards = 64 * max(1, ceil(n / 262_144)) + 3
    # a range of ids with much text is several blocks, by the rows' hash
    large = settle(sizes.filter(F.col("bytes") > MOST_BYTES).select("span", F.ceil(F.col("bytes") / MOST_BYTES).alias("cut")))
    cut = F.lit(0).cast("long")
    if many := large.count():
        ours, share = beside(docs, "span", "cut")
        large = large.select(F.col("span").alias(ours), F.col("cut").alias(share))
        docs = docs.withColumn(ours, span).join(F.broadcast(large) if many <= BROADCAST_IDS // 10 else large, ours, "left")
        cut = F.coalesce(F.pmod(F.xxhash64(F.col(f"`{id_col}`"), text), F.col(share)), F.lit(0))
    block = F.xxhash64(span, cut).alias("block")
    rows = docs.select(block, F.col(f"`{id_col}`").cast("long").alias("doc_id"), *row_key(id_col, text), F.col(f"`{lang_col}`").cast("string").alias("lang"), text.alias("text"))
    rows = rows.join(F.broadcast(trusted) if few else trusted, "doc_id", "left").withColumn("role", F.coalesce("role", F.lit(0)))
    found = settle(rows.select("block", "role", "text").mapInArrow(_gather(shards), "kind int, shard int, block long, blob binary, counts binary"))
    counts = found.filter("kind = 0").select("shard", "blob", "counts").repartition("shard").mapInArrow(_summed_codes, "code long, c long")
    asked = found.filter("kind = 1").select("shard", "blob").repartition("shard").mapInArrow(_distinct_codes, "code long")
    model = kneser_ney(settle(counts), settle(asked))
    none = lambda kind: F.lit(None).cast(kind)
    table = model.select((F.col("code") % shards).cast("int").alias("shard"), F.lit(0).alias("kind"), none("long").alias("block"), "code", "logp", none("binary").alias("blob"))
    wanted = found.filter("kind = 1").select("shard", "kind", "block", none("long").alias("code"), none("double").alias("logp"), "blob")
    logs = table.unionByName(wanted).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_looked_up, "block long, blob binary, logs binary")
    texts = rows.mapInArrow(_payloads, "block long, blob binary")
    both = logs.select("block", F.lit(0).alias("kind"), "blob", "logs").unionByName(texts.select("block", F.lit(1).alias("kind"), "blob", none("binary").alias("logs")))
    scored = both.repartition("block").sortWithinPartitions("block", "kind")
    return scored.mapInArrow(_scored, "doc_id long, k1 long, k2 long, lang string, role int, n_bytes long, nll double")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(doc_id, role) of the ids whose labels all say 1: one in HELD_OUT_OF is held out, the others are to train on."""
    role = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT_OF)) == 0, HELD).otherwise(TRAIN)
    known = labels.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull())
    return known.groupBy(F.col(f"`{id_col}`").cast("long").alias("doc_id")).agg(F.min(f"`{label_col}`").alias("least")).filter("least = 1").select("doc_id", role.alias("role"))


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, quantile: float) -> DataFrame:
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        scored = settle(perplexities(docs, trusted_ids(labels), id_col, text_col, lang_col))
    known = scored.filter((F.col("role") == HELD) & (F.col("n_bytes") > 0))
    usual = F.sum("nll") / F.sum("n_bytes")
    overall = known.agg(usual).first()[0]
    means = settle(known.groupBy("lang").agg(usual.alias("usual"))).withColumnRenamed("lang", "__lang")
    same = F.col("lang").eqNullSafe(F.col("__lang"))
    met = scored.join(means, same, "left").drop("__lang").withColumn("usual", F.coalesce("usual", F.lit(overall).cast("double"), F.lit(0.0)))
    met = met.withColumn("perplexity", F.when(F.col("n_bytes") > 0, F.exp(F.col("nll") / F.col("n_bytes"))))
    rating = F.exp((F.col("nll") + PRIOR_BYTES * F.col("usual")) / (F.col("n_bytes") + PRIOR_BYTES))
    met = met.withColumn("rating", F.when(F.col("n_bytes") > 0, rating))
    met = met.withColumn("__log", F.log("rating"))
    seen = met.filter((F.col("role") != TRAIN) & F.col("rating").isNotNull())
    low, centre, high = (F.percentile_approx("__log", F.lit(q), F.lit(10_000)) for q in (0.25, 0.5, 0.75))
    spread = seen.select("lang", "__log").distinct().groupBy("lang").agg(centre.alias("centre"), F.greatest(high - low, F.lit(LEAST_SPREAD)).alias("spread"))
    centres = settle(spread).withColumnRenamed("lang", "__lang")
    above = seen.filter(F.col("role") == HELD).join(centres, same).select("lang", ((F.col("__log") - F.col("centre")) / F.col("spread")).alias("above"))
    at = F.percentile_approx("above", F.lit(quantile), F.lit(10_000))
    own = settle(above.groupBy("lang").agg(at.alias("own"), F.count(F.lit(1)).alias("held")))
    pooled = F.lit(above.agg(at).first()[0]).cast("double")
    held = F.coalesce("held", F.lit(0))
    drawn = (F.coalesce(held * F.col("own"), F.lit(0.0)) + DRAWN * pooled) / (held + DRAWN)
    limits = centres.join(own, same, "left").select("__lang", F.exp(F.col("centre") + F.col("spread") * drawn).alias("threshold"))
    out = met.join(settle(limits), same, "left").drop("__lang", "__log")
    return out.withColumn("kept", F.coalesce(F.col("rating") <= F.col("threshold"), F.lit(True)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """One row per document: doc_id, lang, n_bytes, perplexity (of a byte), rating, threshold, kept.

    Trusted are the documents that `labels` (doc_id, quality) calls good. The model is trained on four of
    five of them, whole; the others, which it hasn't seen, set the thresholds. The rating is the
    perplexity as it would be after PRIOR_BYTES more bytes of usual text of the language, so that a few
    odd words don't condemn a short text. The model knows some languages better than others, so the logarithms
    of ratings are compared with their median in the language, in quartile ranges, both of its different ratings
    but of those trained on. The threshold is as many quartile ranges above the median as the given quantile of the
    held-out trusted documents is: the language's own quantile, drawn to that of all languages as by DRAWN
    documents. That is one rule for languages with many, few and no trusted documents (null is a language).
    A document rated above its threshold is not kept. A null or empty text has no rating and is kept, as
    are all documents if nothing that is trusted is held out. Repeated rows each have a row; an empty table
    gives none; other columns are not read.
    """
    return _judged(docs, labels, id_col, text_col, lang_col, quantile).select("doc_id", "lang", "n_bytes", "perplexity", "rating", "threshold", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """The rows of docs that `classify` keeps, with all their columns, which may have any names; repeated rows stay or go together. An empty table gives none."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    k1, k2, l = names = beside(docs, "k1", "k2", "l")
    out = _judged(docs, labels, id_col, text_col, lang_col, quantile).filter(~F.col("kept"))
    gone = out.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.coalesce("lang", F.lit("")).alias(l)).distinct()
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(row_key(id_col, text), names)], F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias(l))
    return keyed.join(gone, names, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
