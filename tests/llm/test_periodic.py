"""Periodic runs against a plain search for them, and the query against the plain search over whole documents."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from quorumkit.llm import periodic, queries

from ..conftest import SF


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    """Every stretch that no neighbour extends, lag by lag and word by word; of each the smallest period."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and not any(all(w[k] == w[k + r] for k in range(s, e - r)) for r in range(1, q)):
                out.append((s, e - s, q))
            i = j
    return sorted(out)


pieces = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 9)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(pieces)
@example([([0], 9)])
@example([([0, 1], 4), ([0], 6)])
@example([([0, 0, 1], 4), ([0, 0], 4)])
def test_runs(parts):
    w = [x for piece, times in parts for x in piece * times]
    want = plain_runs(w)
    for sieve in (0, 10**9):  # every lag sieved, none
        assert periodic.runs_of(np.array(w, np.int64), sieve) == want


def test_short_and_equal_words():
    for n in range(12):
        assert periodic.runs_of(np.zeros(n, np.int64)) == ([(0, n, 1)] if n >= 6 else [])


def test_long_texts():
    assert periodic.runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    block = np.random.default_rng(1).permutation(20_000)
    got = periodic.runs_of(np.concatenate((block[:5], np.tile(block, 5), block[:7])))
    assert got == [(5, 100_007, 20_000)]


def test_collapsed():
    assert periodic.collapsed(b" a\tb a b\na b a b  c") == ([(0, 8, 2)], b"a b c")
    assert periodic.collapsed("é x y".encode()) == ([], "é x y".encode())


def test_odd_rows(spark):
    rows = [(1, "x " * 9, "a"), (1, "x " * 9, "a"), (None, "x y", None), (2, None, None), (3, "", "b"), (4, " \n\t", "b"), (5, "w " * 30_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(periodic.collapse_runs(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, [tuple(x) for x in r.runs], r.text) for r in got] == [
        (1, [(0, 9, 1)], "x"), (1, [(0, 9, 1)], "x"), (2, [], ""), (3, [], ""), (4, [], ""), (5, [(0, 30_000, 1)], "w"), (None, [], "x y"),
    ]
    assert periodic.collapse_runs(docs.filter("false")).count() == 0


def expected(doc_id, text) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


NAMES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.fixture
def folder(spark, tmp_path):
    """Documents of the small tables up to a length that the plain search can read, with odd rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 8000").select("doc_id", "text")
    loops = [i for i in range(2000, 4000) if zlib.crc32(str(i).encode()) % 10 == 0]
    odd = [(loops[k], t) for k, t in enumerate(("", " \n", "one", "a b", None, "a a a a a a a b", "x\x0by\x0c z " * 40))] + [(-5, "é è é è é è é è"), (5000, "a b c d " * 9)]
    docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_query_by_plain_search(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in queries.op12_periodic_runs(spark, folder).collect()}
    assert got.keys() == docs.keys() and sum(g[0] > 0 for g in got.values()) > 10
    for i, text in docs.items():
        assert got[i] == expected(i, text), i


def test_query_types(spark):
    kinds = dict(queries.op12_periodic_runs(spark, SF).dtypes)
    assert [kinds[c] for c in NAMES] == ["bigint"] * 5 + ["string"] * 2
