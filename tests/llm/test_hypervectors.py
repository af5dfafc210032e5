"""Language profiles against profiles summed n-gram by n-gram, and predictions on documents that were held out."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quorumkit.llm import hypervectors as H
from quorumkit.llm import queries

from ..conftest import SF

DOCS = "doc_id long, text string, lang string, score string"


def plain_grams(text: str) -> Counter:
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line = f" {' '.join(words)} " if words else ""
    return Counter(line[i : i + 3] for i in range(len(line) - 2))


def plain_profile(text: str) -> np.ndarray:
    out = np.zeros(H.SIZE)
    for g, n in plain_grams(text).items():
        a, b, c = (H.letter_vector(ord(x)).astype(int) for x in g)
        out += n * (np.roll(a, 2) * np.roll(b, 1) * c)
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcé漢字Ж .\n7"), max_size=30), min_size=1, max_size=6))
def test_profiles(texts):
    got = H.profiles(texts)
    assert got.shape == (len(texts), H.SIZE)
    for row, t in zip(got, texts):
        assert np.array_equal(row, plain_profile(t))


def test_profiles_in_parts(monkeypatch):
    texts = ["abcd efgh", "漢字仮名", "", "жизнь и судьба", "abcd"]
    whole = H.profiles(texts)
    monkeypatch.setattr(H, "SPARSE", 0)
    assert np.array_equal(H.profiles(texts), whole)
    monkeypatch.setattr(H, "GRAMS", 3)
    assert np.array_equal(H.profiles(texts), whole)
    assert np.array_equal(H.profiles(texts)[:1], H.profiles(texts[:1]))


def test_letter_vectors_are_nearly_orthogonal():
    v = np.stack([H.letter_vector(ord(c)).astype(float) for c in "abcdefghijklmnop éü漢"])
    assert set(np.unique(v)) == {-1.0, 1.0}
    assert np.abs(v @ v.T / H.SIZE - np.eye(len(v))).max() < 0.1


def test_order_matters():
    a, b = H.profiles(["abc cab", "cba bac"])
    assert a @ b / np.sqrt((a @ a) * (b @ b)) < 0.3


def test_odd_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    free = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(free[k], "the cat and the dog " * 5, "en", "x") for k in range(4)] + [(free[k], "le chat et le chien " * 5, "fr", "x") for k in range(4, 8)]
    rows += [(free[8], "123 !?", "zz", None), (free[9], "the", None, None), (None, "the cat", "yy", None), (held[0], "the dog", "xx", None)]
    rows += [(held[1], None, "en", None), (held[2], "", None, None), (held[3], "42", "fr", None), (held[4], "Le CHIEN " * 20_000, None, None), (held[4], "Le CHIEN", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = defaultdict(list)
    for r in H.identify_languages(docs).collect():
        got[r.doc_id].append((r.held_out, r.lang_pred))
        assert 0 <= r.score <= 1 and (r.lang_pred != "und" or r.score == 0)
    assert sum(map(len, got.values())) == len(rows)
    assert got[free[0]] == [(False, "en")] and got[free[5]] == [(False, "fr")] and got[free[9]] == [(False, "en")]
    assert got[held[0]] == [(True, "en")] and got[held[4]] == [(True, "fr")] * 2 and got[None] == [(False, "en")]
    assert [got[i] for i in (held[1], held[2], held[3], free[8])] == [[(True, "und")]] * 3 + [[(False, "und")]]
    blocks = sorted(H.identify_languages(docs, block=1).collect(), key=str)
    assert blocks == sorted(H.identify_languages(docs).collect(), key=str)
    assert H.identify_languages(docs.filter("false")).count() == 0
    none = H.identify_languages(docs.filter("lang IS NULL")).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


def test_equal_languages_go_to_the_first_name(spark):
    free = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(free[0], "same text", "b", ""), (free[1], "same text", "a", ""), (free[2], "same text", "c", "")], DOCS)
    assert {r.lang_pred for r in H.identify_languages(docs).collect()} == {"a"}
    assert {r.lang_pred for r in H.identify_languages(docs, block=1).collect()} == {"a"}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_query_by_plain_profiles(spark, docs):
    sums = defaultdict(lambda: np.zeros(H.SIZE))
    for i, d in docs.items():
        grams = plain_grams(d.text or "")
        if zlib.crc32(str(i).encode()) % 4 != 2 and d.lang is not None and grams:
            sums[d.lang] += plain_profile(d.text) * (H.WEIGHT // sum(grams.values()))
    made = {k: np.rint(v * H.PEAK / np.abs(v).max()) for k, v in sums.items()}
    for r in queries.op11_language_vectors(spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        own = plain_profile(docs[r.doc_id].text)
        near = {k: own @ v / np.sqrt((own @ own) * (v @ v)) for k, v in made.items()}
        best = max(sorted(near), key=near.get)
        assert r.lang_pred == best and r.score == pytest.approx(max(0, near[best]))


def test_query_on_held_out_documents(spark, docs):
    got = [r for r in queries.op11_language_vectors(spark, SF).collect() if r.held_out and docs[r.doc_id].lang and re.search(r"\w", docs[r.doc_id].text)]
    assert len(got) > 30 and np.mean([r.lang_pred == docs[r.doc_id].lang for r in got]) >= 0.98


def test_same_result_however_rows_are_dealt(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(H.identify_languages(rows.repartition(7)).collect()) == sorted(H.identify_languages(rows.coalesce(1)).collect())
