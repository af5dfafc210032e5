"""SimHash near-dedup: fingerprints of word shingles, pivot distance tables, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import arrow_rows, row_key, settle
from .components import components

#: Words of a shingle, seed of its hash, most differing bits of a link.
SHINGLE, SEED, RADIUS = 4, 42, 4
#: Reference fingerprints of the pivot table, taken in groups of GROUP.
N_PIVOTS, GROUP = 32, 8
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, 7) for i in range(N_PIVOTS)], dtype=np.uint64)
#: Rows of an Arrow batch of texts.
ARROW_ROWS = 1000
#: Shingles counted at once; buckets up to SMALL rows compare all their pairs; beyond HOT they are split.
STEP, SMALL, HOT = 1 << 16, 64, 200_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def _bit_counts(hashes: list[int], owner: np.ndarray, owners: int) -> np.ndarray:
    """How many of each owner's hashes have each bit set, from a histogram of their bytes."""
    lanes = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    at = lanes.astype(np.int64) + (np.arange(8, dtype=np.int64) * 256 + owner[:, None] * 2048)
    histogram = np.bincount(at.ravel(), minlength=owners * 2048).reshape(owners, 8, 256)
    return (histogram @ _BITS).reshape(owners, 64)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    lanes = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
    histogram = np.bincount((lanes + np.arange(8) * 256).ravel(), minlength=2048).reshape(8, 256)
    return (histogram @ _BITS).ravel()


def fingerprint_texts(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprints (uint64) of UTF-8 texts: a bit is set if over half of the shingles' hashes have it."""
    counts, totals = np.zeros((len(texts), 64)), np.zeros(len(texts))
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    runs: list[tuple[int, int]] = []

    def flush() -> None:
        if hashes:
            who = np.array([d for d, _ in runs])
            sums = _bit_counts(hashes, np.repeat(np.arange(len(runs)), [n for _, n in runs]), len(runs))
            np.add.at(counts, who, sums)
            hashes.clear()
            runs.clear()

    for d, text in enumerate(texts):
        words = text.lower().split()  # of bytes: A-Z only, and exactly the six ASCII white spaces
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate(([0], ends[:-1] + 1))
        n = max(1, len(words) - shingle + 1)
        totals[d] = n
        lows, highs = begins[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
        for at in range(0, n, STEP):
            part = [digest(joined[i:j], SEED) for i, j in zip(lows[at : at + STEP], highs[at : at + STEP])]
            hashes.extend(part)
            runs.append((d, len(part)))
            if len(hashes) >= STEP:
                flush()
    flush()
    return np.packbits(counts * 2 > totals[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text").cast(pa.binary())
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            prints = fingerprint_texts(text.slice(at, 1000).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("k1"), part.column("k2"), pa.array(prints)], names=["doc_id", "k1", "k2", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, fp): a fingerprint, as a signed long, for each row; k1 and k2 stand for id and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text), text.alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, k1 long, k2 long, fp long")


def _settled_prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        return settle(fingerprints(docs, id_col, text_col))


def band_masks(bands: int, radius: int = RADIUS) -> list[int]:
    """Masks of all choices of bands - radius out of `bands` bands: two fingerprints at most `radius`
    bits apart agree under one of them at least."""
    cuts = [round(64 * i / bands) for i in range(bands + 1)]
    parts = [((1 << cuts[i + 1]) - 1) & ~((1 << cuts[i]) - 1) for i in range(bands)]
    return [sum(chosen) for chosen in combinations(parts, bands - radius)]


def best_bands(n: int, radius: int = RADIUS) -> int:
    """The number of bands for n fingerprints at which rows to sort and chance pairs to test cost least."""

    def cost(bands: int) -> float:
        tables = comb(bands, radius)
        return tables * (n + 0.05 * n * n / 2 ** (64 * (bands - radius) / bands + 1))

    return min(range(radius + 1, radius + 7), key=cost)


def _near(i: np.ndarray, j: np.ndarray, prints: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """The positions of pairs (i, j) within the radius: pairs whose pivot distances differ by more than
    the radius in any coordinate are discarded, survivors are verified bit by bit."""
    left = np.arange(max(i.size, j.size))
    for at in range(0, table.shape[1], GROUP):
        x = table[i if i.size == 1 else i[left], at : at + GROUP]
        y = table[j[left], at : at + GROUP]
        left = left[np.abs(x - y).max(axis=1) <= radius]
        if not left.size:
            return left
    x = prints[i if i.size == 1 else i[left]]
    return left[np.bitwise_count(x ^ prints[j[left]]) <= radius]


def _linked(prints: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links among fingerprints with equal group numbers (ascending).

    Small groups give all their links. A large group is searched from a first fingerprint outward, and
    what was reached is compared no more: it gives a tree for each of its components.
    """
    table = np.bitwise_count(prints[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    length = np.diff(np.append(begin, group.size))
    behind = np.repeat(begin + length, length) - np.arange(group.size) - 1  # rows after this one in its group
    behind = np.where(np.repeat(length, length) > SMALL, 0, behind)
    a, b = [], []
    for shift in range(1, SMALL):
        i = np.flatnonzero(behind >= shift)
        if not i.size:
            break
        near = _near(i, i + shift, prints, table, radius)
        a.append(i[near])
        b.append(i[near] + shift)
    for lo, n in zip(begin[length > SMALL], length[length > SMALL]):
        rest = np.arange(lo, lo + n)
        while rest.size > 1:
            reached, rest = [rest[0]], rest[1:]
            while reached and rest.size:
                x = reached.pop()
                near = _near(np.array([x]), rest, prints, table, radius)
                if near.size:
                    a.append(np.full(near.size, x))
                    b.append(rest[near])
                    reached.extend(rest[near])
                    rest = np.delete(rest, near)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links in buckets; the rows of a partition are sorted by bucket, and a bucket may span batches."""
    kept: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        change = np.any(rows[1:, :-1] != rows[:-1, :-1], axis=1)
        group = np.concatenate(([0], np.cumsum(change)))
        prints = np.ascontiguousarray(rows[:, -1]).view(np.uint64)
        a, b = _linked(prints, group)
        pairs = np.unique(np.stack([rows[a, -1], rows[b, -1]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        if not len(rows):
            continue
        last = np.flatnonzero(np.any(rows[:, :-1] != rows[-1, :-1], axis=1))
        cut = last[-1] + 1 if last.size else 0
        if cut or (kept and np.any(kept[-1][-1, :-1] != rows[-1, :-1])):
            yield links(np.concatenate([*kept, rows[:cut]]))
            kept = []
        kept.append(rows[cut:])
    if kept:
        yield links(np.concatenate(kept))


def near_links(prints: DataFrame, n: int, bands: int | None = None, hot: int = HOT) -> DataFrame:
    """(a, b): links that join all of the n distinct fingerprints (column fp) at most RADIUS bits apart.

    A pivot table alone would have to meet every pair, so fingerprints first meet where they agree in
    all but RADIUS of their bands, in every such choice of bands: no link is missed. Inside a bucket
    the pivot distances discard pairs. A bucket of more than `hot` rows is dealt out in slices, and
    each two slices meet.
    """
    masks = band_masks(bands or best_bands(n))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select(F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)])).alias("k"), "fp")
    keyed = keyed.select("k.t", "k.bits", "fp")
    crowds = keyed.groupBy("t", "bits").count().filter(F.col("count") > hot).select("t", "bits", F.ceil(F.col("count") / hot).alias("slices"))
    crowds = settle(crowds)
    zero = F.lit(0).cast("long")
    if crowds.isEmpty():
        rows = keyed.select("t", "bits", zero.alias("x"), zero.alias("y"), "fp")
    else:
        met = keyed.join(crowds, ["t", "bits"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)).cast("long"))
        met = met.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("slices"))).withColumn("other", F.explode(F.sequence(zero, F.col("slices") - 1)))
        rows = met.select("t", "bits", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    key = ["t", "bits", "x", "y"]
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(n * len(masks) / 4_000_000))
    return rows.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(_link_batches, "a long, b long")


def _labelled(prints: DataFrame) -> DataFrame:
    """The settled rows of fingerprints with the label of their component, one of its fingerprints."""
    distinct = settle(prints.select("fp").distinct())
    labels = components(near_links(distinct, distinct.count()))
    named = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", F.coalesce("label", "fp").alias("label"))
    return prints.join(settle(named), "fp")  # settled: then a hot fingerprint's rows can be split


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Documents are linked when their fingerprints differ in RADIUS bits or fewer. A null text counts as
    empty, and an empty one has fingerprint 0 and links like any other. Repeated rows each have a row.
    A null id is never the smallest; a component without ids has a null component_id. An empty table
    gives no rows; other columns are not read.
    """
    prints = _settled_prints(docs, id_col, text_col)
    rows = _labelled(prints)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("own"))
    label = rows.select("fp", "label").distinct()
    ids = label.join(first, "fp").groupBy("label").agg(F.min("own").alias("component_id"))
    return rows.join(settle(ids), "label").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
