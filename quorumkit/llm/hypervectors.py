"""Languages by hyperdimensional profiles: permuted letter vectors are bound into n-grams and bundled; cosines decide.

Every letter has a random vector of -1 and 1. The vector of n letters in a row is the product of theirs, each turned
by its place; a profile is the sum of the vectors of all n-grams. Counts, profiles and prototypes are whole numbers
that doubles hold exactly, so results don't depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import arrow_rows, settle

#: Numbers of a vector, letters of an n-gram, and the seed of letters' vectors.
SIZE, LETTERS, SEED = 2048, 3, 11
#: Texts of a step hold so many bytes, and are at most so many.
STEP_CHARS, STEP_ROWS = 1_000_000, 256
#: Texts are summed together while (text, n-gram) cells are at most so many times the n-grams that occur.
SPARSE = 8
#: n-grams whose vectors are made at once.
GRAMS = 8192
#: Languages that a task compares at once; more are compared block by block.
BLOCK = 256
#: Languages whose sums a task holds; more go out as several parts.
HELD = 256
#: The sum of a text's weights (a little less, as they are whole numbers), and the largest number of a prototype.
WEIGHT, PEAK = 1 << 28, 1 << 15
UNKNOWN = "und"
ARROW_ROWS = 2000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def symbols(text: str) -> np.ndarray:
    """Code points of the text's letters in lower case, one space between words, before the first and after the last; none without letters."""
    points = np.frombuffer(unicodedata.normalize("NFC", text.lower()).encode("utf-32-le"), "<u4")
    letter = letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    kept = letter | np.concatenate(([False], letter[:-1]))
    out = np.where(letter, points, 32)[kept]
    return np.concatenate(([32], out, [] if out[-1] == 32 else [32])).astype(np.int64)


@lru_cache(maxsize=8192)
def letter_vector(point: int) -> np.ndarray:
    """-1 and 1, from the bits of splitmix64 of the letter's own counter."""
    with np.errstate(over="ignore"):
        x = np.uint64(SEED) + np.uint64(0x9E3779B97F4A7C15) * (np.uint64(point * (SIZE // 64) + 1) + np.arange(SIZE // 64, dtype=np.uint64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (np.unpackbits(x.astype("<u8").view(np.uint8), bitorder="little").view(np.int8) * 2 - 1).astype(np.int8)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The vectors of n-grams (rows of code points): each letter's, turned by the letters that follow it, multiplied."""
    points, which = np.unique(grams, return_inverse=True)
    which = which.reshape(grams.shape)
    table = np.stack([letter_vector(int(p)) for p in points])
    out = table[which[:, -1]]
    for k in range(1, grams.shape[1]):
        out *= np.roll(table, k, axis=1)[which[:, -1 - k]]
    return out


class Counts:
    """n-grams of several texts: which (rows of code points), and, of each place in a text, its text and n-gram."""

    def __init__(self, texts: list[str], n: int = LETTERS) -> None:
        found = [symbols(t) for t in texts]
        self.sizes = np.array([max(0, s.size - n + 1) for s in found], np.int64)
        every = np.concatenate([np.zeros(0, np.int64), *(s for s in found if s.size >= n)])
        points, small = _ranked(every, 0x110000)
        base, size = max(1, points.size), max(0, every.size - n + 1)
        key = np.zeros(size, np.int64)
        for k in range(n):
            key = key * base + small[k : k + size]
        inside = np.ones(size, bool)  # but for those that reach from one text into the next
        ends = np.cumsum(np.array([s.size for s in found if s.size >= n], np.int64))[:-1]
        for k in range(1, n):
            inside[ends - k] = False
        codes, self.gram = _ranked(key[inside], base**n)
        self.text = np.repeat(np.arange(len(texts)), self.sizes)
        self.grams = np.stack([points[codes // base ** (n - 1 - k) % base] for k in range(n)], axis=1) if codes.size else np.zeros((0, n), np.int64)

    def bundles(self, row: np.ndarray, rows: int, weight: np.ndarray | None, kind: type) -> np.ndarray:
        """Sums of n-gram vectors by row; `weight` says how much each place counts (None: 1)."""
        out = np.zeros((rows, SIZE), np.float64)
        for lo in range(0, len(self.grams), GRAMS):
            vectors = gram_vectors(self.grams[lo : lo + GRAMS]).astype(kind)
            part = slice(None) if len(vectors) == len(self.grams) else (self.gram >= lo) & (self.gram < lo + GRAMS)
            counts = np.bincount(row[part] * len(vectors) + self.gram[part] - lo, None if weight is None else weight[part], rows * len(vectors))
            out += counts.reshape(rows, len(vectors)).astype(kind) @ vectors
        return out


def _ranked(values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The different values, which are below `end`, in order, and the place of each value among them."""
    if end > 1 << 22:
        return np.unique(values, return_inverse=True)
    there = np.zeros(end, bool)
    there[values] = True
    found = np.flatnonzero(there)
    rank = np.zeros(end, np.int64)
    rank[found] = np.arange(found.size)
    return found, rank[values]


def profiles(texts: list[str]) -> np.ndarray:
    """One row per text: the sum of its n-grams' vectors. Texts that share few n-grams are summed in smaller parts."""
    counts = Counts(texts)
    if len(texts) > 1 and len(texts) * len(counts.grams) > SPARSE * counts.text.size:
        half = len(texts) // 2
        return np.concatenate((profiles(texts[:half]), profiles(texts[half:])))
    exact = counts.sizes.max(initial=0) < 1 << 24  # whole numbers that single precision holds
    return counts.bundles(counts.text, len(texts), None, np.float32 if exact else np.float64)


def _steps(column: pa.Array) -> Iterator[slice]:
    """Slices of a column of texts that hold STEP_CHARS bytes or one text, and STEP_ROWS rows, at most."""
    sizes = np.diff(np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]) if len(column) else []
    at, held = 0, 0
    for k, size in enumerate(sizes):
        if k > at and (held + size > STEP_CHARS or k - at == STEP_ROWS):
            yield slice(at, k)
            at, held = k, 0
        held += int(size)
    if len(column) > at:
        yield slice(at, len(column))


def _taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts with languages, each language's sum of bundles; a text weighs as much as any other."""
    sums: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.int64()))], names=["lang", "v"])

    for batch in batches:
        for at in _steps(batch.column("text")):
            part = batch.slice(at.start, at.stop - at.start)
            counts = Counts(part.column("text").to_pylist())
            names, row = np.unique(np.array(part.column("lang").to_pylist(), object), return_inverse=True)
            weight = (WEIGHT // np.maximum(1, counts.sizes)).astype(np.float64)[counts.text]
            made = counts.bundles(row[counts.text], names.size, weight, np.float64).astype(np.int64)
            for name, v in zip(names, made):
                sums[name] = sums[name] + v if name in sums else v
            if len(sums) > HELD:
                yield out()
                sums.clear()
    if sums:
        yield out()


def prototypes(texts: DataFrame) -> DataFrame:
    """(lang, v), settled: the bundle of each language of texts (lang, text), drawn to numbers of at most PEAK.

    Tasks send their own sums, which are added number by number: no language's texts or sums meet in one task. A
    language without a letter in its texts has no row.
    """
    ship(texts.sparkSession)
    parts = texts.mapInArrow(_taught, "lang string, v array<long>")
    each = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    whole = each.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("v"))
    peak = F.array_max(F.transform("v", F.abs))
    return settle(whole.filter(peak > 0).select("lang", F.transform("v", lambda x: F.round(x * F.lit(float(PEAK)) / peak).cast("int")).alias("v")))


def _compared(names: list[str], vectors: np.ndarray):
    """Texts with the best cosine so far (lang, cosine), against more languages; of equal ones the first by name stands."""
    size = np.sqrt((vectors**2).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in _steps(batch.column("text")):
                part = batch.slice(at.start, at.stop - at.start)
                profile = profiles(part.column("text").to_pylist())
                own = np.sqrt((profile**2).sum(axis=1))
                with np.errstate(invalid="ignore", divide="ignore"):
                    cosine = np.where(own[:, None] > 0, profile @ vectors.T / (own[:, None] * size), -2.0)
                best = cosine.argmax(axis=1)
                top = cosine[np.arange(len(best)), best]
                lang, score = part.column("lang").to_pylist(), np.array(part.column("cosine").to_pylist(), np.float64)
                better = top > score
                lang = [names[b] if won else old for b, won, old in zip(best.tolist(), better.tolist(), lang)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text"), pa.array(lang, pa.string()), pa.array(np.where(better, top, score), pa.float64())], names=["doc_id", "text", "lang", "cosine"]
                )

    return run


def identify(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (cosine with that language's prototype, 0 if it is below).

    known: (lang, v) as prototypes() gives them. Whole texts are read. A text that is null or has no letter is 'und'
    with score 0.0, and so is every text if there are no prototypes; of equally near languages the first by name is
    taken. Repeated rows each have a row, null ids too; an empty table gives no rows; other columns are not read.
    A block of languages is what goes to the tasks; more languages than that are compared block after block.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.lit(UNKNOWN).alias("lang"), F.lit(-1.5).alias("cosine"))
    for lo in range(0, known.count(), block):
        some = known.orderBy("lang").offset(lo).limit(block).collect()
        rows = rows.mapInArrow(_compared([r["lang"] for r in some], np.array([r["v"] for r in some], np.float64)), "doc_id long, text string, lang string, cosine double")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "cosine"))
    return rows.select("doc_id", F.col("lang").alias("lang_pred"), score.alias("score"))


def fold(id_col: str):
    """crc32 of the id as text, mod 4; null for a null id."""
    return F.crc32(F.col(f"`{id_col}`").cast("long").cast("string").cast("binary")) % 4


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held: int = 2, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of the id as text mod 4 is `held`), lang_pred, score; see identify().

    Prototypes are learned from all documents that aren't held out and have an id, a language and a letter; a text's
    n-grams weigh as much together as any other's. A null id isn't held out and teaches nothing.
    """
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
        taught = docs.filter((fold(id_col) != held) & F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), text.alias("text"))
        known = prototypes(taught)
    out = identify(docs, known, id_col, text_col, block)
    return out.select("doc_id", F.coalesce(fold("doc_id") == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
