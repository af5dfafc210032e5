"""Stretches of words that repeat with a period, found lag by lag on bit planes, and texts without the repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: A run has at least LEAST words and at least TIMES periods.
LEAST, TIMES = 6, 4
#: Texts of more words look at a few places of each lag first, and leave out lags that can't have a run.
SIEVE_FROM = 4096
#: Rows of an Arrow batch that are unpacked at once.
STEP_ROWS = 64


def planes_of(ids: np.ndarray) -> list[int]:
    """Bit i of the k-th big integer is bit k of the id of word i."""
    bits = int(ids.max()).bit_length() if ids.size else 0
    return [int.from_bytes(np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(bits)]


def stretches(planes: list[int], n: int, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of the maximal stretches of at least `least` places at which word i and word i + lag are the same."""
    differ = 0
    for plane in planes:
        differ |= plane ^ (plane >> lag)
    alike, have = (1 << (n - lag)) - 1 & ~differ, 1
    while alike and have < least:  # bit i stays if places i to i + have - 1 are alike
        step = min(have, least - have)
        alike &= alike >> step
        have += step
    if not alike:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.unpackbits(np.frombuffer(alike.to_bytes((n - lag + 7) // 8, "little"), np.uint8), bitorder="little")
    edges = np.flatnonzero(np.diff(bits.view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2] - edges[::2] + least - 1


def _possible(ids: np.ndarray, until: np.ndarray, lag: int) -> bool:
    """Whether a run of smallest period `lag` can be there.

    It has its word at four multiples of the lag in a row, and, at any distance from the first of them, the same word
    three times. If those multiples lie in a run of a smaller period (`until` says where runs that hold a word end),
    the two would share so many words that the smaller period held for both.
    """
    word = ids[::lag]
    same = word[1:] == word[:-1]
    at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * lag
    at = at[until[at] <= at + 3 * lag]
    for far in (lag // 2, lag // 4, 3 * lag // 4):
        if not at.size:
            return False
        at = at[at + 2 * lag + far < ids.size]
        at = at[(ids[at + far] == ids[at + lag + far]) & (ids[at + far] == ids[at + 2 * lag + far])]
    return at.size > 0


def runs_of(ids: np.ndarray, sieve_from: int = SIEVE_FROM) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period.

    Lags go up, so that a stretch that also repeats with a smaller period has been found with that one before.
    """
    n, planes, found = ids.size, planes_of(ids), {}
    until = np.zeros(n, np.int64)
    for lag in range(1, n // TIMES + 1):
        if n > sieve_from and not _possible(ids, until, lag):
            continue
        for begin, length in zip(*(x.tolist() for x in stretches(planes, n, lag, max(LEAST - lag, (TIMES - 1) * lag)))):
            end = begin + length + lag
            if found.setdefault((begin, end), lag) == lag:
                np.maximum(until[begin:end], end, out=until[begin:end])
    return sorted((begin, end - begin, lag) for (begin, end), lag in found.items())


def collapsed(text: bytes) -> tuple[list[tuple[int, int, int]], bytes]:
    """The runs of a UTF-8 text, and its words joined by one space without those that a run holds after its first period."""
    words = text.split()  # of bytes: exactly the six ASCII white spaces
    number: dict[bytes, int] = {}
    runs = runs_of(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return runs, b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep).tolist()])


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, runs (array of start, length, period), text (without repeats).

    Words are separated by ASCII white space and numbered from 0. A run is a stretch of words with smallest period q
    and at least max(6, 4 q) words, which neither neighbour extends; runs are in the order of start, then period. A
    word goes if some run holds it after that run's first q words; the others are joined by one space. A text that is
    null, empty or white space has no runs and an empty text. Repeated rows each have a row, null ids too; an empty
    table gives no rows; other columns are not read. A text is one task's work: nearly linear in its words, whatever its length.
    """
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                made = [collapsed(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
                runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs, _ in made], kind)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), runs, pa.array([t for _, t in made], pa.binary()).cast(pa.string())], names=["doc_id", "runs", "text"])

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string")
