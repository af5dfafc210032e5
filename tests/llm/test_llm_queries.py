"""The queries of the corpus operators against SQL or brute force over the small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quorumkit.llm import queries
from quorumkit.llm.mixing import BLOCK

from ..conftest import SF, same_as_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    same_as_sql(spark, duck, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_op3(spark, docs):
    got = queries.op3_toxicity_trees(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_op3_learns(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in queries.op3_toxicity_trees(spark, folder).collect() if r.held_out and r.doc_id in labels]
    ones, zeros = ([r.score for r in held if labels[r.doc_id] == k] for k in (1, 0))
    area = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    hit = sum(s >= 0.5 for s in ones) / len(ones)
    assert area > 0.98 and hit > 0.85 and sum(s >= 0.5 for s in zeros) / len(zeros) < 0.01


def test_op4(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    got = queries.op4_sentencepiece(spark, SF).collect()
    assert len(got) == len(docs) and all(r.agrees for r in got)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in got:
        ids = library.encode(docs[r.doc_id].text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_op5(spark, docs, labels):
    got = queries.op5_quality_lm(spark, "/root/testdata/sf0.01").collect()
    known = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    good, bad = ([r.kept for r in got if known.get(r.doc_id) == k] for k in (1, 0))
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.2
    assert all(r.perplexity is None or 1 <= r.perplexity < 1e5 for r in got)


def test_op6(spark, docs):
    got = {r.doc_id: r for r in queries.op6_pii_feistel(spark, SF).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert (r.n_replaced == 0) == (r.text == docs[i].text)
        for s in r.spans:
            assert r.text[s.start : s.end] and s.kind in r.kinds
    found = {m for d in docs.values() for m in re.findall(r"[\w.]+@[\w.]*\w|\+1 \(\d{3}\) 555-\d{4}", d.text)}
    assert found and not any(m in r.text for m in found for r in got.values())


def simhash(text: str) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    count = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(parts))


def test_op7(spark, docs):
    got = {r.doc_id: r for r in queries.op7_simhash_pivots(spark, SF).collect()}
    prints = {i: simhash(d.text) for i, d in docs.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    label = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for i in docs:
            least = min(label[j] for j in docs if (prints[i] ^ prints[j]).bit_count() <= 4)
            changed, label[i] = changed or least < label[i], min(label[i], least)
    assert {i: r.component_id for i, r in got.items()} == label


def test_op8(spark, docs):
    got = queries.op8_mix_sources(spark, SF).collect()
    size = {i: len(WORD.findall(d.text)) for i, d in docs.items()}
    per = Counter()
    for i, d in docs.items():
        per[d.source] += size[i]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(per))}
    capped, target = set(), {}
    while True:
        rest, open_ = sum(per.values()) - sum(3 * per[s] for s in capped), sum(weight[s] for s in per if s not in capped)
        target = {s: 3 * per[s] if s in capped else rest * weight[s] / open_ for s in per}
        more = {s for s in per if s not in capped and target[s] > 3 * per[s]}
        if not more:
            break
        capped |= more
    taken = Counter()
    for r in got:
        s = docs[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], per[s]) and 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(target[s])
        taken[s] += r.taken
    # a quota is rounded to whole blocks, and a source's last block may be shorter than the others
    assert len(got) == len(docs) and all(abs(taken[s] - target[s]) <= 1.5 * BLOCK for s in per)
    assert sorted(got) == sorted(queries.op8_mix_sources(spark, SF).collect())


def jump(key: int, n: int) -> int:
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_op9(spark, docs):
    slots = defaultdict(list)
    for r in queries.op9_shard_jump(spark, SF).collect():
        data = docs[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 16), jump(r.doc_id, 17)) and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == len(docs)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
