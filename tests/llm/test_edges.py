"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import math
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorumkit.llm import common, components, exact_dedup, line_dedup, maxscore, mixing, pii, piece_codec, quality_lm, queries, sharding, simhash, similar, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, name long, shard int, taken long, fingerprint string, k1 long, text_sha256 string"
LONG = "word " * 60_000


def docs_of(spark, rows):
    """Rows of (doc_id, text, source), with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), None, 7, 3, 9, "x", 1, "y") for i, t, s in rows], SCHEMA)


ROWS = [(1, "a b c", "s"), (1, "a b c", "s"), (2, "a b c", None), (None, "a b c", "s"), (None, None, None), (3, None, "s"), (4, "", "t"), (5, " \n\t", "t"), (6, LONG, "t"), (7, "é\n漢字 x", "u"), (-8, "a b c d", "u")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def test_exact_groups(odd, none):
    got = exact_dedup.exact_groups(odd).collect()
    assert len(got) == len(ROWS) and exact_dedup.exact_groups(none).count() == 0
    same = [r for r in got if r.group_size == 4]
    assert len(same) == 4 and {r.keep_id for r in same} == {2} and sum(r.kept for r in same) == 1
    empty = [r for r in got if r.group_size == 3]
    assert {r.doc_id for r in empty} == {None, 3, 4} and {r.keep_id for r in empty} == {4}
    assert sum(r.kept for r in got) == len({t or "" for _, t, _ in ROWS})
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len({t or "" for _, t, _ in ROWS})
    assert exact_dedup.keep_one(none).count() == 0


def test_keep_one_of_repeated_rows(spark):
    rows = docs_of(spark, [(1, "x", "b"), (1, "x", "a"), (1, "x", "a"), (0, "x", "c"), (2, "y", "d")])
    assert sorted((r.doc_id, r.source) for r in exact_dedup.keep_one(rows).collect()) == [(1, "a"), (2, "d")]


@pytest.mark.parametrize("bits", [1, 64])
def test_identities_without_collisions(spark, bits):
    texts = ["", "a", "ab", "abab", "ababab", "abababab", "aabb", "abb", "ba" * 9, "ab" * 9, "ab" * 9, "a" * 37, "a" * 38, "漢字" * 5]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = exact_dedup.exact_groups(docs, block=2, route_bits=bits).collect()
    assert {r.doc_id: r.keep_id for r in got} == {i: max(j for j, u in enumerate(texts) if u == t) for i, t in enumerate(texts)}


def test_dedup_lines(spark, odd, none):
    out = line_dedup.dedup_lines(odd)
    assert out.count() == len(ROWS) and line_dedup.dedup_lines(none).count() == 0
    assert set(odd.columns) < set(out.columns)
    texts = ["1\n2\n3\n4", "0\n1 \n\n2\n3\n9", "2\n3\n4\n1\n2\n3", "x\nx\nx\nx\nx", "1\n2", "1\n2\n3\n4"]
    rows = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: (r.text, [(s.first, s.last) for s in r.removed_spans]) for r in line_dedup.dedup_lines(rows).collect()}
    assert got == {0: ("1\n2\n3\n4", []), 1: ("0\n\n9", [(1, 1), (3, 4)]), 2: ("", [(0, 5)]), 3: ("x", [(1, 4)]), 4: ("1\n2", []), 5: ("", [(0, 3)])}
    twice = line_dedup.dedup_lines(docs_of(spark, [(1, "1\n2\n3", "s")] * 3 + [(2, "1\n2\n3", "s")])).collect()
    assert Counter((r.doc_id, r.text) for r in twice) == {(1, "1\n2\n3"): 3, (2, ""): 1}


def test_sharding(spark, odd, none):
    got = sharding.shard_rows(odd).collect()
    assert len(got) == len(ROWS) and sharding.shard_rows(none).count() == 0
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {r.shard for r in got if r.doc_id == 1} == {sharding.shard_rows(docs_of(spark, [(1, "z", "s")])).first().shard}
    many = spark.range(-500, 500).select(F.col("id"), sharding.jump_hash("id", 1000).alias("a"), sharding.jump_hash("id", 1001).alias("b")).collect()
    from .test_llm_queries import jump

    assert all((r.a, r.b) == (jump(r.id, 1000), jump(r.id, 1001)) for r in many)
    with pytest.raises(ValueError):
        sharding.jump_hash("id", 0)


def test_mixing(spark, odd, none):
    got = mixing.mix_report(odd, block=2).collect()
    assert len(got) == len(ROWS) and mixing.mix_report(none).count() == 0
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    again = mixing.mix_report(odd, block=2).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(got, key=key) == sorted(again, key=key)
    only = mixing.mix_report(docs_of(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert {(r.taken, r.target, r["size"]) for r in only} == {(0, 0.0, 0)}
    out = mixing.mix_documents(odd, block=2)
    assert out.columns == odd.columns
    words = sum(len(r.text.split()) for r in out.collect())
    assert words == sum(r.taken for r in got)
    assert mixing.mix_documents(none).count() == 0


def test_slots_of_the_mix_meet_no_join(spark):
    """A (shard, source) unfolds after it is joined: unfolded slots look as small to a planner as it, and would be broadcast."""
    targets = spark.createDataFrame([(0, "a", 64 * 9000, 64 * 9500.0, 9000, 9500), (1, "b", 64 * 500, 64 * 1500.0, 500, 1500)], "s int, source string, source_size long, target double, blocks long, quota long")
    plan = mixing.mix_plan(targets, 11_000)
    joins = []

    def walk(node):
        if node.nodeName() == "Join":
            joins.append(node.treeString())
        for k in range(node.children().length()):
            walk(node.children().apply(k))

    walk(plan._jdf.queryExecution().optimizedPlan())
    assert joins and not any(re.search(r"Generate explode.*\[q#", x) for x in joins)
    slots = plan.collect()
    assert len(slots) == len({(r.s, r.q) for r in slots}) == 11_000 and max(r.shard for r in slots) == 10_999 // mixing.SHARD_SLOTS
    for s, blocks, quota in ((0, 9000, 9500), (1, 500, 1500)):
        own = [r.block for r in slots if r.s == s]
        assert len(own) == quota and Counter(Counter(own).values()).keys() <= {quota // blocks, -(-quota // blocks)} and len(set(own)) == blocks


def test_mixing_caps_small_sources(spark):
    rows = docs_of(spark, [(0, "w " * 10, "a"), *[(i, "w " * 500, "b") for i in range(1, 5)], (9, "w " * 300, None)])
    got = mixing.mix_report(rows, block=4).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert target[10] == 30 and sum(target.values()) == pytest.approx(2310)
    assert all(abs(taken[s] - t) <= 4 for s, t in target.items())


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 97, 1000])
def test_permutation(spark, n):
    rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), [F.lit(1), F.lit("s")]).alias("p"))
    assert sorted(r.p for r in rows.collect()) == list(range(n))


def test_running_total(spark):
    rows = spark.createDataFrame([("a", i % 7, 1 + i % 3) for i in range(50)] + [("b", 1, 5)] * 4, "g string, x int, w int")
    got = common.running_total(rows, ["g"], F.col("x") % 3, "w").collect()
    for g in "ab":
        spans = sorted((r.start, r.start + r.w) for r in got if r.g == g)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_near_groups(spark, odd, none):
    got = simhash.near_groups(odd).collect()
    assert len(got) == len(ROWS) and simhash.near_groups(none).count() == 0
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {None, 3, 4, 5} and {r.component_id for r in zero} == {3}
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    kept = similar.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len({r.component_id for r in similar.similar_groups(odd).collect()})
    alone = simhash.near_groups(docs_of(spark, [(None, "q w e", "s")])).first()
    assert alone.component_id is None


@pytest.mark.parametrize("bands", [5, 6, 8])
@pytest.mark.parametrize("hot", [40, 10**6])
def test_links_lose_nothing(spark, bands, hot):
    rng = np.random.default_rng(bands)
    centre = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (3, 300), dtype=np.uint64)
    dense = centre[0] ^ flips[0] ^ flips[1] ^ flips[2]
    pairs = centre ^ flips[0][:30] ^ flips[1][:30]
    prints = np.unique(np.concatenate([centre, dense, pairs]))
    table = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    links = simhash.near_links(table, len(prints), bands=bands, hot=hot)
    label = {r.node: r.label for r in components.components(links).collect()}
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    want = np.arange(len(prints))
    while True:
        new = np.array([want[row].min() for row in near])
        if (new == want).all():
            break
        want = new
    signed = prints.view(np.int64).tolist()
    groups = [label.get(s, s) for s in signed]
    assert len(set(zip(groups, want))) == len(set(groups)) == len(set(want))


def test_near_copies_stay_linear():
    centre = np.uint64(xxhash.xxh64_intdigest(b"c"))
    prints = np.unique(centre ^ (np.uint64(1) << np.arange(64, dtype=np.uint64)))
    many = np.unique((prints[:, None] ^ prints[None, :] ^ centre).ravel())
    a, b = simhash._linked(many, np.zeros(len(many), np.int64))
    assert len(a) == len(many) - 1


@pytest.mark.parametrize("at_once", [0, components.AT_ONCE])
def test_components_of_paths_and_stars(spark, at_once):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long"), at_once).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


VECTORS = "vec_id long, embedding array<float>, score string, rank int"


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "x", 1) for i in range(60)]
    rows += [(60, None, "x", 1), (61, [1.0, None], "x", 1), (62, [float("nan")] * 6, "x", 1), (63, [float("inf")] * 6, "x", 1), (64, [], "x", 1), (65, [2.0], "x", 1)]
    rows += [(i, rows[0][1], "x", 1) for i in range(70, 120)] + [(None, rows[1][1], "x", 1)]
    table = spark.createDataFrame(rows, VECTORS)
    ask = table.filter("vec_id % 10 = 0")
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {}
    for i, v in good:
        if i is not None and i % 10 == 0:
            best = sorted((-dot(v, w), -1 if j is None else j) for j, w in good if j != i)[:5]
            want[i] = [(None if j < 0 else j, -s) for s, j in best]
    for shard in (maxscore.SHARD, 7):
        got = {}
        for r in maxscore.top_k(table, ask, 5, shard=shard).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == want
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert maxscore.top_k(few, few, 20).count() == 6
    assert maxscore.top_k(few.limit(0), few.limit(0), 20).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_postings_are_exact(seed):
    rng = np.random.default_rng(seed)
    m, d, k = int(rng.integers(1, 400)), int(rng.integers(1, 20)), int(rng.integers(1, 25))
    rows = rng.integers(-9, 10, (m, d)) * int(rng.choice([1, 1, 1000, 10**6]))
    ids, queries_ = rng.permutation(m), rng.integers(-9, 10, (5, d))
    for q, (found, scores) in zip(range(5), maxscore.Postings(ids, rows).search(queries_, ids[:5] if m >= 5 else np.full(5, -1), k)):
        full, ok = rows @ queries_[q], ids != (ids[q] if m >= 5 else -1)
        order = np.lexsort((ids[ok], -full[ok]))[:k]
        assert found.tolist() == ids[ok][order].tolist() and scores.tolist() == full[ok][order].tolist()


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1), (2, None, None), (-8, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(odd, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert {r.score for r in toxicity.score_toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(none, labels).count() == 0


def test_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = toxicity.fit(x, y)
    fresh = rng.normal(size=(1000, 4))
    want = (fresh[:, 0] > 0.3) ^ (fresh[:, 1] > 0)
    score = model.score(fresh)
    assert ((score >= 0.5) == want).mean() > 0.95
    order = np.argsort(model.raw(fresh))
    assert (np.diff(score[order]) >= -1e-12).all()


def isotonic(values, weights) -> np.ndarray:
    """The value at i is the largest, over beginnings up to i, of the least mean up to any end from i on."""
    v, w = np.array(values, float), np.array(weights, float)
    mean = lambda a, b: float((v[a:b] * w[a:b]).sum() / w[a:b].sum())
    return np.array([max(min(mean(a, b + 1) for b in range(i, v.size)) for a in range(i + 1)) for i in range(v.size)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=1, max_size=30))
@example([0] * 9 + [1, 1, 0, 1])
@example([0, 1])
@example([1, 0])
def test_pooling_by_brute_force(labels):
    """Pools are those of equal isotonic values; drawn to the prior by their sizes, they are put in order once more."""
    y = np.array(labels, float)
    model = toxicity.Trees().calibrate(np.arange(y.size, dtype=float), y)
    plain = np.round(isotonic(y, np.ones(y.size)), 9)
    values, sizes = np.unique(plain, return_counts=True)
    drawn = (values * sizes + toxicity.PRIOR * y.mean()) / (sizes + toxicity.PRIOR)
    want = np.repeat(isotonic(drawn, sizes + toxicity.PRIOR), sizes)
    assert np.allclose(np.unique(np.round(want, 9)), model.ys) and (np.diff(model.ys) > 0).all()
    got = [model.ys[np.flatnonzero(np.round(np.unique(np.round(want, 9)), 9) == round(w, 9))[0]] for w in want]
    assert np.allclose(got, want)
    for x, value in zip(model.xs, model.ys):
        assert x == pytest.approx(np.flatnonzero(np.isclose(want, value)).mean())


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6))
def test_a_split_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 12, (80, 3)).astype(float), rng.integers(0, 2, 80).astype(float)
    p = min(max(y.mean(), 1e-4), 1 - 1e-4)
    g, h = y - p, np.full(80, p * (1 - p))

    def gain(left):
        parts = [g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left)]
        return sum(parts) - g.sum() ** 2 / (h.sum() + 1)

    cuts = [(f, t) for f in range(3) for t in np.unique(x[:, f]) if toxicity.LEAF <= (x[:, f] <= t).sum() <= 80 - toxicity.LEAF]
    best = max((gain(x[:, f] <= t) for f, t in cuts), default=0.0)
    splits, leaves = toxicity.Trees().fit(x, y).trees[0]
    (f, t) = splits[0][0]
    left = x[:, f] <= t
    assert best < 1e-8 or math.isclose(gain(left), best, rel_tol=1e-9)
    node = np.zeros(80, int)
    for level in splits:
        node = 2 * node + np.array([x[i, level[node[i]][0]] > level[node[i]][1] for i in range(80)])
    for k in np.unique(node):
        assert math.isclose(leaves[k], toxicity.RATE * g[node == k].sum() / (h[node == k].sum() + 1), abs_tol=1e-12)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["idiot", "You", "IDIOT", "fool!", "a-b", "x.y", "aaaa", "7", "#", "?!", "hello", "you_", " ", "\n"]), max_size=25).map(" ".join))
def test_features_by_brute_force(text):
    got = dict(zip(toxicity.FEATURES, toxicity.Featurizer().one(text)))
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    whole = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    insults, address = [w for w in whole if w in toxicity.INSULTS], [w for w in whole if w in toxicity.PRONOUNS]
    letters = [c for c in text if c.isalpha()]
    want = {
        "insults": len(insults), "insult_kinds": len(set(insults)), "insult_density": len(insults) / n, "learned": 0, "learned_density": 0,
        "address_density": len(address) / n, "upper_share": sum(map(str.isupper, letters)) / max(1, len(letters)),
        "caps_words": sum(map(str.isupper, words)) / n, "marks": sum(c in "!?" for c in text) / n, "other_marks": text.count("#") / size + text.count("_") / size,
        "elongated": sum(len(set(text[i : i + 4])) == 1 and not text[i].isspace() for i in range(len(text) - 3)) / size,
        "inner_marks": sum(text[i].isalpha() and text[i + 2].isalpha() and not text[i + 1].isalpha() and not text[i + 1].isspace() for i in range(len(text) - 2)) / n,
        "digits": sum(map(str.isdigit, text)) / size, "repeated": 1 - len(set(words)) / n, "log_words": math.log(1 + len(words)),
    }
    for name, value in want.items():
        assert math.isclose(got[name], value, abs_tol=1e-9), name


def test_disguised_words():
    make = toxicity.Featurizer(["zork*"])
    at = dict(zip(toxicity.FEATURES, make.one("You IDIOT! m0ron s.t.u.p.i.d zorkling")))
    assert (at["insults"], at["learned"], at["near"]) == (1, 1, 2 if at["near"] == 2 else 1) and at["disguised"] == 2
    assert make.one("") and make.one("!" * 10_000)


@pytest.fixture(scope="module")
def codec():
    return piece_codec.codec(queries.tokenizer_path())


def test_codec_on_odd_rows(spark, odd, none):
    got = piece_codec.encode_decode(odd, queries.tokenizer_path()).collect()
    assert len(got) == len(ROWS) and all(r.agrees for r in got)
    assert sorted(r.decoded for r in got) == sorted(t or "" for _, t, _ in ROWS)
    assert piece_codec.encode_decode(none, queries.tokenizer_path()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abcdet hing▁\n .,<>0xé漢🙂"), st.characters(blacklist_categories=["Cs"])), max_size=80), min_size=1, max_size=4))
def test_codec_is_the_library(texts):
    codec = piece_codec.codec(queries.tokenizer_path())
    ids, counts = codec.encode(texts)
    right = codec.library.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == right
    assert codec.decode(ids, counts) == codec.library.decode(right)


@pytest.mark.parametrize("text", ["a" * 3000, "the" * 2000, " " * 700, "ab" * 200 + " x", "\n" * 50, "漢" * 600])
def test_codec_heap(codec, text):
    ids, counts = codec.encode([text, "tail"])
    assert ids.tolist() == [i for t in (text, "tail") for i in codec.library.encode(t)] and counts.sum() == len(ids)


@pytest.mark.parametrize("at", range(9))
def test_every_text_is_checked(codec, at):
    class Wrong(piece_codec.PieceCodec):
        def __init__(self):
            self.__dict__.update(codec.__dict__)

        def encode(self, texts):
            ids, counts = super().encode(texts)
            ids[counts[:at].sum()] += 1
            return ids, counts

    texts = [f"text {k}" for k in range(9)]
    ids, ends, decoded, agrees = piece_codec.checked(Wrong(), texts)
    assert [x.tolist() for x in np.split(ids, ends[1:-1])] == codec.library.encode(texts) and decoded == texts
    assert agrees == [k != at for k in range(9)]


def test_stretches_with_one_mark(codec, monkeypatch):
    """Stretches whose marks collide are told apart by their characters."""
    texts = ["the cat sat", "cat the sat the", "a b c", "é漢🙂 the", "", "sat"]
    monkeypatch.setattr(codec, "memo", {})
    monkeypatch.setattr(codec, "_marks", lambda points, cuts, sizes: np.zeros(cuts.size, np.uint64))
    ids, counts = codec.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == codec.library.encode(texts)


def plain_limits(rows, quantile: float) -> dict:
    """Thresholds by language, from ratings (lang, role, rating), with whole sorted lists."""
    at = lambda values, q: sorted(values)[max(0, math.ceil(q * len(values)) - 1)]
    logs: dict = {}
    for lang, role, rating in rows:
        if role != quality_lm.TRAIN and rating is not None:
            logs.setdefault(lang, []).append((role, math.log(rating)))
    centre, low, high = ({g: at({x for _, x in v}, q) for g, v in logs.items()} for q in (0.5, 0.25, 0.75))
    spread = {g: max(high[g] - low[g], quality_lm.LEAST_SPREAD) for g in logs}
    above = {g: [(x - centre[g]) / spread[g] for role, x in v if role == quality_lm.HELD] for g, v in logs.items()}
    every = [x for v in above.values() for x in v]
    if not every:
        return {}
    pooled, k = at(every, quantile), quality_lm.DRAWN
    return {g: math.exp(centre[g] + spread[g] * ((len(v) * at(v, quantile) if v else 0) + k * pooled) / (len(v) + k)) for g, v in above.items()}


@pytest.mark.parametrize("quantile", [0.5, 0.9, 0.995])
def test_thresholds_by_brute_force(spark, quantile):
    """Languages with many, few and no trusted documents, and one that is null, by one rule."""
    rng = np.random.default_rng(3)
    words = {g: [f"{g or 'x'}{k}w" for k in range(40)] for g in ("aa", "bb", "cc", None)}
    rows = [(k, " ".join(rng.choice(words[g], int(rng.integers(5, 60)))), g) for k, g in enumerate(["aa"] * 120 + ["bb"] * 20 + ["cc"] * 15 + [None] * 9)]
    rows += [(500, "zz 9 ## " * 30, "aa"), (501, "", "aa"), (502, None, "dd"), (503, "only one", "ee")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(0, 140)] + [(500, 0)], "doc_id long, quality int")
    got = quality_lm._judged(docs, labels, "doc_id", "text", "lang", quantile).collect()
    limits = plain_limits([(r.lang, r.role, r.rating) for r in got], quantile)
    assert {r.lang for r in got if r.role == quality_lm.HELD} == {"aa", "bb"} and set(limits) == {"aa", "bb", "cc", None, "ee"}
    usual = {g: sum(r.nll for r in own) / sum(r.n_bytes for r in own) for g in ("aa", "bb") if (own := [r for r in got if r.role == quality_lm.HELD and r.lang == g])}
    held = [r for r in got if r.role == quality_lm.HELD]
    overall = sum(r.nll for r in held) / sum(r.n_bytes for r in held)
    for r in got:
        if not r.n_bytes:
            assert r.rating is None and r.kept
            continue
        assert r.rating == pytest.approx(math.exp((r.nll + quality_lm.PRIOR_BYTES * usual.get(r.lang, overall)) / (r.n_bytes + quality_lm.PRIOR_BYTES)))
        assert r.threshold == pytest.approx(limits[r.lang]) and r.kept == (r.rating <= r.threshold)


def brute_kn(grams: Counter, asked: bytes) -> float:
    """The interpolated modified Kneser-Ney probability of the last byte, from the definition."""
    orders = {quality_lm.ORDER: grams}
    for k in range(quality_lm.ORDER - 1, 0, -1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])

    def p(g: bytes) -> float:
        if not g:
            return 1 / 256
        counts = orders[len(g)]
        of = Counter(counts.values())
        d = quality_lm.discounts(of[1], of[2], of[3], of[4])
        cut = lambda c: d[min(c, 3) - 1]
        same = [c for x, c in counts.items() if x[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        c = counts.get(g, 0)
        return ((c - cut(c)) if c else 0) / sum(same) + sum(map(cut, same)) / sum(same) * p(g[1:])

    return p(asked)


def test_kneser_ney(spark):
    n = quality_lm.ORDER
    text = b"\0" * (n - 1) + b"the theatre thaws then the thin other hath the moth"
    grams = Counter(text[i : i + n] for i in range(len(text) - n + 1))
    asked = [*grams, b"zzzzz", b"the z", b"xthe ", b"\0\0\0\0q"]
    code = lambda g: int.from_bytes(g, "big")
    model = quality_lm.kneser_ney(
        spark.createDataFrame([(code(g), c) for g, c in grams.items()], "code long, c long"), spark.createDataFrame([(code(g),) for g in asked], "code long")
    )
    got = {r.code: math.exp(r.logp) for r in model.collect()}
    assert got == pytest.approx({code(g): brute_kn(grams, g) for g in asked}, rel=1e-9)
    every = [code(b"the " + bytes([b])) for b in range(256)]
    total = quality_lm.kneser_ney(spark.createDataFrame([(code(g), c) for g, c in grams.items()], "code long, c long"), spark.createDataFrame([(c,) for c in every], "code long"))
    assert sum(math.exp(r.logp) for r in total.collect()) == pytest.approx(1)


def test_perplexity(spark):
    texts = {1: "the theatre", 2: "then other", 3: "Z!", 4: ""}
    docs = docs_of(spark, [(i, t, "s") for i, t in texts.items()])
    trusted = spark.createDataFrame([(1, quality_lm.TRAIN), (2, quality_lm.HELD)], "doc_id long, role int")
    n = quality_lm.ORDER
    cut = lambda t: [(b"\0" * (n - 1) + t.encode())[i : i + n] for i in range(len(t))]
    grams = Counter(cut(texts[1]))
    for r in quality_lm.perplexities(docs, trusted).collect():
        assert r.n_bytes == len(texts[r.doc_id])
        assert r.nll == pytest.approx(-sum(math.log(brute_kn(grams, g)) for g in cut(texts[r.doc_id])), rel=1e-5)


def test_blocks_with_much_text(spark, odd, monkeypatch):
    trusted = spark.createDataFrame([(1, quality_lm.TRAIN), (2, quality_lm.HELD)], "doc_id long, role int")
    rates = lambda: sorted((r.k1, r.k2, r.n_bytes, r.nll) for r in quality_lm.perplexities(odd, trusted).collect())
    before = rates()
    monkeypatch.setattr(quality_lm, "MOST_BYTES", 10)
    assert rates() == before and len(before) == len(ROWS)


@pytest.mark.parametrize("counts", [(0, 0, 0, 0), (1, 0, 5, 2), (5, 100, 1, 1), (100, 50, 30, 20), (1, 2, 30, 40)])
def test_discounts_leave_every_probability_positive(counts):
    assert all(0 < d <= k for k, d in enumerate(quality_lm.discounts(*counts), 1))


def test_quality_edges(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (6, 1), (None, 1), (7, None)], "doc_id long, quality int")
    got = quality_lm.classify(odd, labels).collect()
    assert len(got) == len(ROWS) and all(r.kept for r in got if not r.n_bytes)
    assert all(r.kept for r in quality_lm.classify(odd, labels.limit(0)).collect())
    assert quality_lm.classify(none, labels).count() == 0
    kept = quality_lm.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)


@pytest.mark.parametrize("n", [8, 80])
@pytest.mark.parametrize("lang", ["fi", None])
def test_a_rare_clean_language_stays(spark, n, lang):
    rng = np.random.default_rng(3)
    words = {"en": "the of and to in is that for it was on are as with his they at be this have from".split(), lang: "olla ja ei se että joka hän mutta niin kuin voida minä saada tulla pitää tämä vuosi".split()}
    text = lambda l: " ".join(rng.choice(words[l], rng.integers(20, 200)))
    rows = [(i, text("en"), "en") for i in range(300)] + [(1000 + i, text(lang), lang) for i in range(n)]
    rows += [(2000, "".join(map(chr, rng.integers(0x2500, 0x2600, 4000))), lang)]
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality_lm.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    assert all(got[1000 + i] for i in range(n))
    assert not got[2000]  # junk of a language with one clean document or many


def test_pack():
    codes = np.array([0, 1, 5, 2**39, 2**40 - 1])
    assert quality_lm.unpack(quality_lm.pack(codes)).tolist() == codes.tolist() and quality_lm.unpack(quality_lm.pack(codes[:0])).size == 0


def test_pii(spark, odd, none):
    rows = docs_of(spark, [(1, "to a.b@x.org, 4111 1111 1111 1111", "s"), (2, "4111-1111-1111-1111 and 4111111111111112", "s"), (3, None, "s"), (4, "", "s")])
    got = {r.doc_id: r for r in pii.pseudonymize(rows, b"k").collect()}
    card = lambda t: "".join(c for c in t.split("x.org")[-1].split(" and ")[0] if c.isdigit())
    assert card(got[1].text) == card(got[2].text) != "4111111111111111" and got[2].text.endswith("4111111111111112")
    assert got[3].text is None and got[4].text == "" and "@x.org" in got[1].text and "a.b@" not in got[1].text
    back = {r.doc_id: r.text for r in pii.pseudonymize(spark.createDataFrame([(i, r.text) for i, r in got.items()], "doc_id long, text string"), b"k", inverse=True).collect()}
    assert back == {r.doc_id: r.text for r in rows.collect()}
    assert pii.pseudonymize(odd, b"k").count() == len(ROWS) and pii.pseudonymize(none, b"k").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 10**12), st.data())
def test_feistel(n, data):
    x = data.draw(st.integers(0, n - 1))
    f = pii.Feistel(b"key")
    y = f.permute(x, n, "t")
    assert 0 <= y < n and f.permute(y, n, "t", inverse=True) == x


@pytest.mark.parametrize(
    "text", ["GB82 WEST 1234 5698 7654 32", "123-45-6789", "10.0.0.1", "1999-12-31", "31.12.1999", "12/31/1999", "31/12/1999", "+1 (212) 555-0187", "212-555-0187", "4539148803436467"]
)
def test_formats(text):
    there, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", inverse=True)
    new, spans = there.replace(f"x {text}.")
    assert len(spans) == 1 and new != f"x {text}." and back.replace(new)[0] == f"x {text}."


@pytest.mark.parametrize("text", ["GB83 WEST 1234 5698 7654 32", "000-45-6789", "300.0.0.1", "1999-13-31", "30.02.1999", "4539148803436468", "1234567", "no@host", "3.14", "v1.2.3.4.5"])
def test_left_alone(text):
    assert pii.Pseudonyms(b"k").replace(f"x {text} y") == (f"x {text} y", [])


CARD, OTHER_CARD, DE = "4111 1111 1111 1111", "4111111111111111", "DE89 3704 0044 0532 0130 00"


@pytest.mark.parametrize(
    "value, text",
    [(v, t) for v, ts in {
        CARD: ["{} 12/27", "{} 123", "{} 2 times", "7 {} 2 times", "12 {}", "no {}-12"],
        OTHER_CARD: ["{} 123", "{} 12/27", "5 {}"],
        DE: ["{} BIC COBADEFF", "{} EUR 500", "IBAN {} AND MORE WORDS"],
        "+49 30 12345678": ["{}", "call {}, please"], "+44 (0)20 7946 0958": ["{}"], "+33 1 23 45 67 89": ["tel. {}."], "+493012345678": ["{}"],
    }.items() for t in ts],
)
@pytest.mark.parametrize("key", [b"%d" % i for i in range(20)])
def test_numbers_beside_others(value, text, key):
    there, back = pii.Pseudonyms(key), pii.Pseudonyms(key, inverse=True)
    before = f"x {text.format(value)} y"
    new, spans = there.replace(before)
    at = before.index(value)
    assert value not in new and any(s["start"] <= at and s["end"] >= at + len(value) for s in spans)
    assert back.replace(new)[0] == before


def _cards(text):
    """Every valid card number, by trying each beginning and each end."""
    for a in range(len(text)):
        if not text[a].isdigit() or re.search(r"[\w+-]$|\d\.$", text[:a]):
            continue
        for b in range(a + 13, min(len(text), a + 37) + 1):
            value = text[a:b]
            digits = re.sub(r"\D", "", value)
            if not re.fullmatch(r"\d([ -]?\d)*", value) or not 13 <= len(digits) <= 19 or re.match(r"\w|-\w", text[b:]):
                continue
            total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
            if total % 10 == 0 and len(set(digits)) > 1:
                yield a, b


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111111111111111", "378282246310005", "5500-0000-0000-0004", "12", "7", "2026", "word", "No.", "x-", "-", ","]), max_size=8), st.sampled_from([" ", "", ", "]))
def test_cards_by_brute_force(parts, gap):
    """No valid number stays whole in clear: each meets one that was replaced."""
    text = gap.join(parts)
    new, spans = pii.Pseudonyms(b"k" * 16).replace(text)
    if len(new) == len(text):
        assert all(any(a < s["end"] and s["start"] < b for s in spans) for a, b in _cards(text))


def test_whole_local_parts_and_dates():
    one, back = pii.Pseudonyms(b"k" * 16), pii.Pseudonyms(b"k" * 16, True)
    for text in ("john.o'neil@x.com", "ab" * 100 + "@x.com", "иван.łuk@x.ru", "a@b.com@c.com", "am 3.4.2001 und 03.04.2001", "12/31/1999"):
        new, spans = one.replace(text)
        assert back.replace(new)[0] == text and [len(w) for w in new.split()] == [len(w) for w in text.split()]
        for s in spans:
            own = [(x, y) for x, y in zip(text[s["start"] : s["end"]], new[s["start"] : s["end"]]) if x.isalnum()]
            assert any(x != y for x, y in own)
    assert one.replace("john.o'neil@x.com")[1][0]["start"] == 0
    text = ", ".join(f"name{i}@x.com" for i in range(20_000))
    began = time.process_time()
    new, spans = one.replace(text)
    assert len(spans) == 20_000 and time.process_time() - began < 10
