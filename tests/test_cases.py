"""Hand-computed cases, properties, readers, writers and the stream."""

from __future__ import annotations

import ast
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorumkit.functions import code as C
from quorumkit.functions import codebleu
from quorumkit.functions import generated as G
from quorumkit.functions import literals as L
from quorumkit.functions import text as T
from quorumkit.operators import clusters, entropy, evaluate, functional, registry, selection, similarity, traces
from quorumkit.plans import runs
from quorumkit.sources import readers, writers
from quorumkit.streaming import rounds


def samples_of(spark, rows, schema="qid string, pos int, cluster int, logprob double, score double"):
    return spark.createDataFrame(rows, schema)


def test_entropies_by_hand(spark):
    rows = [("a", 0, 0, -1.0, 1.0), ("a", 1, 0, -1.2, 0.0), ("a", 2, 1, -3.0, 0.5), ("b", 0, 0, None, 0.0), ("b", 1, 1, None, 0.0), ("c", 0, 0, -1.0, 0.0), ("c", 1, 0, -2.0, 0.0), ("d", 0, 0, -2000.0, 0.0), ("d", 1, 1, -1000.0, 0.0)]
    got = {r.qid: r for r in entropy.entropies(samples_of(spark, rows)).collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert (a.PE_MC, a.PE_Rao, a.SE, a.DSE) == pytest.approx((1.7333333333, 0.8922265943, 0.2517161490, 0.6365141681), abs=1e-9)
    assert b.PE_MC is None and b.PE_Rao is None and b.SE is None and b.DSE == pytest.approx(math.log(2), abs=1e-9)
    assert c.DSE == pytest.approx(-1e-10, abs=1e-12) and c.DSE != 0
    assert d.SE == 0 and d.PE_Rao == 0
    assert entropy.entropies(samples_of(spark, [])).count() == 0


def test_components_and_leaders_of_a_path(spark):
    samples = samples_of(spark, [("a", i, None, None, None) for i in range(3)])
    links = spark.createDataFrame([("a", 0, 2), ("a", 1, 2)], "qid string, a int, b int")
    ids = lambda df: [r.cluster for r in df.orderBy("pos").collect()]
    assert ids(clusters.components(samples, links)) == [0, 0, 0]
    assert ids(clusters.propagate(samples, links)) == [0, 0, 0]
    assert ids(clusters.leaders(samples, links)) == [0, 1, 1]
    with pytest.raises(ValueError):
        clusters.cluster(samples, links, "bfs")


def brute(n, links, directed):
    near = {i: set() for i in range(n)}
    for a, b in links:
        near[a].add(b)
        if not directed:
            near[b].add(a)
    ids, k = {}, 0
    for i in range(n):
        if i not in ids:
            stack = [i]
            ids[i] = k
            while stack:
                for y in near[stack.pop()]:
                    if y not in ids:
                        ids[y] = k
                        stack.append(y)
            k += 1
    return [ids[i] for i in range(n)]


def brute_leaders(n, links):
    near = {(a, b) for a, b in links} | {(b, a) for a, b in links}
    ids, lead = [-1] * n, []
    for i in range(n):
        if not any((k, i) in near for k in lead):
            lead.append(i)
    for c, k in enumerate(lead):
        ids[k] = c
        for j in range(k + 1, n):
            if j not in lead and (k, j) in near:
                ids[j] = c
    return ids


def test_components_and_leaders_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    graphs = {}
    for q in range(60):
        n = rng.randint(1, 9)
        graphs[f"q{q}"] = n, [(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < 0.18]
    samples = spark.createDataFrame([(q, i) for q, (n, _) in graphs.items() for i in range(n)], "qid string, pos int")
    links = spark.createDataFrame([(q, a, b) for q, (_, ls) in graphs.items() for a, b in ls], "qid string, a int, b int")

    def got(df):
        out = {}
        for r in df.orderBy("pos").collect():
            out.setdefault(r.qid, []).append(r.cluster)
        return out

    assert got(clusters.components(samples, links)) == {q: brute(n, ls, False) for q, (n, ls) in graphs.items()}
    assert got(clusters.components(samples, links, limit=3)) == {q: brute(n, ls, False) for q, (n, ls) in graphs.items()}
    assert got(clusters.components(samples, links, directed=True)) == {q: brute(n, ls, True) for q, (n, ls) in graphs.items()}
    assert got(clusters.components(samples, links, directed=True, limit=3)) == {q: brute(n, ls, True) for q, (n, ls) in graphs.items()}
    want = {q: brute_leaders(n, ls) for q, (n, ls) in graphs.items()}
    for limit in (3, clusters.ARRAY_LIMIT):
        assert got(clusters.leaders(samples, links, limit=limit)) == want
    assert got(clusters.lead_by_rounds(samples, links, block=1)) == want
    monkeypatch.setattr(clusters, "MOST_LINKS", 1)
    assert got(clusters.lead_by_rounds(samples, links, block=4)) == want
    assert clusters.lead_by_rounds(samples.limit(0), links).count() == 0


def test_a_large_question(spark):
    rng = random.Random(4)
    n, pairs = 5000, [(rng.randrange(5000), rng.randrange(5000)) for _ in range(3000)]
    samples = spark.createDataFrame([("q", i) for i in range(n)], "qid string, pos int")
    links = spark.createDataFrame([("q", a, b) for a, b in pairs], "qid string, a int, b int")
    ids = lambda rows: [r.cluster for r in rows.orderBy("pos").collect()]
    ends = [np.array(x) for x in zip(*pairs)]
    assert ids(clusters.components(samples, links)) == clusters._reached(n, *ends, False)
    assert ids(clusters.components(samples, links, directed=True)) == clusters._reached(n, *ends, True)
    assert ids(clusters.leaders(samples, links)) == clusters._led(n, *ends)


def test_leaders_of_a_long_path(spark, monkeypatch):
    """Every link hangs on the one before it; the rounds are few all the same."""
    n, calls, grouped = 5000, [], clusters._grouped
    monkeypatch.setattr(clusters, "_grouped", lambda *a: calls.append(1) or grouped(*a))
    samples = spark.range(n).selectExpr("'q' AS qid", "CAST(id AS int) AS pos")
    links = spark.range(n - 1).selectExpr("'q' AS qid", "CAST(id AS int) AS a", "CAST(id + 1 AS int) AS b")
    ids = [r.cluster for r in clusters.lead_by_rounds(samples, links).orderBy("pos").collect()]
    assert ids == [k // 2 for k in range(n)] and len(calls) == 3


def test_ids_by_key_both_ways(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), k, rng.choice(["x", "y", "z", None]), rng.choice([1, None])) for k in range(200)]
    samples = spark.createDataFrame(rows, "qid string, pos int, k string, l int")
    by = lambda limit: sorted(map(str, clusters.by_key(samples, ["k", "l"], limit=limit).select(*samples.columns, "cluster").collect()))
    assert by(clusters.WINDOW_LIMIT) == by(0)
    some = samples.withColumn("ok", F.when(F.col("pos") % 3 > 0, F.col("pos") % 3 == 1))
    part = lambda limit: sorted(map(str, clusters.by_key(some, ["k", "l"], limit=limit, where="ok").select(*some.columns, "cluster").collect()))
    alone = clusters.by_key(some.filter("ok"), ["k", "l"]).select(*some.columns, "cluster").unionByName(some.filter("ok IS NOT TRUE").withColumn("cluster", F.lit(None).cast("int")))
    assert part(clusters.WINDOW_LIMIT) == part(0) == sorted(map(str, alone.collect()))
    assert clusters.by_key(samples.limit(0), ["k"]).count() == 0
    first = {}
    for r in clusters.by_key(samples, ["k", "l"]).orderBy("pos").collect():
        own = first.setdefault(r.qid, {})
        assert own.setdefault((r.k, r.l), len(own)) == r.cluster


def test_largest_cluster_tie(spark):
    rows = samples_of(spark, [("a", i, c, None, s) for i, (c, s) in enumerate([(0, 0.1), (1, 1.0), (1, 0.2), (0, 0.3)])])
    assert clusters.largest(rows).first().cluster == 0
    got = evaluate.question_scores(rows).first()
    assert (got.pass_at_n, got.pass_at_cluster, got.max_score) == (1, 0, 1.0)
    assert got.cluster_avg_score == pytest.approx(0.2)


def test_outputs(spark):
    samples = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)], "qid string, pos int")
    outputs = spark.createDataFrame([("a", 0, 0, "a"), ("a", 1, 0, "b"), ("a", 2, 0, "a"), ("b", 0, 0, "Error: x"), ("b", 1, 0, "x")], "qid string, pos int, test int, output string")
    got = functional.by_outputs(samples, outputs).orderBy("qid", "pos").collect()
    assert [r.cluster for r in got] == [0, 1, 0, 0, 1]
    assert functional.pick_tests(outputs.select("qid", "test").distinct(), 5).count() == 2


def test_entailment_rules(spark):
    rows = spark.createDataFrame([(2, 2), (2, 1), (1, 1), (0, 2), (2, 0)], "x int, y int")
    got = rows.select(similarity.entails(F.col("x"), F.col("y")).alias("s"), similarity.entails(F.col("x"), F.col("y"), False).alias("r")).collect()
    assert [(r.s, r.r) for r in got] == [(True, True), (False, True), (False, False), (False, False), (False, False)]
    with pytest.raises(ValueError):
        similarity.entailment_score(F.col("x"), "other")


def test_roc_by_hand(spark):
    rows = spark.createDataFrame([("a", y, e) for y, e in zip([1, 1, 0, 1, 0], [0.0, 0.2, 0.5, 0.5, 0.9])] + [("one", 1, 0.1), ("one", 1, 0.2), ("flat", 1, 0.5), ("flat", 0, 0.5)], "g string, y int, entropy double")
    area = {r.g: r.auroc for r in evaluate.auroc(rows, ["g"]).collect()}
    assert area == pytest.approx({"a": 0.9166666667, "one": 0.0, "flat": 0.5})
    points = evaluate.roc_points(rows, ["g"])
    got = sorted((r.fpr, r.tpr) for r in points.filter("g = 'a'").collect())
    assert np.allclose(got, [(0, 0), (0, 1 / 3), (0, 2 / 3), (0.5, 1), (1, 1)])
    f, t = evaluate.fpr_at_tpr(points, ["g"]).filter("g = 'a'").first(), evaluate.tpr_at_fpr(points, ["g"]).filter("g = 'a'").first()
    assert (f.fpr_at_80, f.fpr_at_90, t.tpr_at_5, t.tpr_at_10) == pytest.approx((0.4, 0.7, 0.7, 0.7333333333))
    one = evaluate.fpr_at_tpr(points, ["g"]).filter("g = 'one'").first()
    assert one.fpr_at_80 == pytest.approx(0.8)


def test_evaluate_matches_its_parts(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([("m", "x", f"d{i % 2}", int(rng.random() < 0.5), int(rng.random() < 0.5), *[rng.choice([None, 0.1, 0.2, rng.random()]) for _ in range(4)]) for i in range(200)], "model string, method string, difficulty string, pass_at_n int, pass_at_cluster int, PE_MC double, PE_Rao double, SE double, DSE double")
    got = {(r.difficulty, r.metric, r.entropy_type): r for r in evaluate.evaluate(rows).collect()}
    flat = evaluate.with_overall(evaluate.long_form(rows, ["model", "method", "difficulty"], ["pass_at_n", "pass_at_cluster"]))
    group = ["difficulty", "metric", "entropy_type"]
    points = evaluate.roc_points(flat, group)
    for part in (evaluate.fpr_at_tpr(points, group), evaluate.tpr_at_fpr(points, group), evaluate.auroc(flat, group)):
        for r in part.collect():
            whole = got[r.difficulty, r.metric, r.entropy_type]
            assert all(whole[c] == pytest.approx(r[c]) for c in part.columns if c not in group)
    assert evaluate.chart_rows(evaluate.evaluate(rows)).filter("chart = 'roc'").filter("auroc < 0.6").count() == 0


def test_pearson_by_hand(spark):
    data = {"n4": ([0, 0.5, 1, 1.5], [1, 0.8, 0.9, 0.1]), "n3": ([0, 0.5, 1], [1, 0.2, 0.4]), "flat": ([1.0, 1.0, 1.0], [0, 1, 2]), "single": ([1], [1])}
    rows = spark.createDataFrame([(g, float(x), float(y)) for g, (xs, ys) in data.items() for x, y in zip(xs, ys)], "g string, x double, y double")
    got = {r.g: (r.correlation, r.p_value) for r in evaluate.with_p_value(evaluate.pearson(rows, ["g"], "x", "y")).collect()}
    assert got["n4"] == pytest.approx((-0.8221921916, 0.1778078084), abs=1e-9)
    assert got["n3"] == pytest.approx((-0.7205766921, 0.4877542916), abs=1e-9)
    assert got["flat"] == got["single"] == (0.0, 1.0)


@settings(max_examples=100, deadline=None)
@given(st.floats(-0.999, 0.999))
def test_p_value_closed_forms(r):
    p3, p4 = evaluate.p_value(np.array([r, r]), np.array([3, 4]))
    assert p3 == pytest.approx(1 - 2 / math.pi * math.asin(abs(r)), abs=1e-9)
    assert p4 == pytest.approx(1 - abs(r), abs=1e-9)


def test_positional_pairs_as_lists(spark):
    rows = spark.createDataFrame([("g", i, y, e) for i, (y, e) in enumerate([(1, None), (0, 0.3), (1, 0.1)])], "g string, k int, y int, e double")
    assert [(r.y, r.e) for r in evaluate.positional(rows, ["g"], "k", "y", "e").orderBy("e").collect()] == [(0, 0.1), (1, 0.3)]


def test_backfill(spark):
    schema = f"question_id string, debug_trace {readers.TRACE}, is_passed_public boolean, passed boolean, score double"
    rows = spark.createDataFrame([("a", [("x", 1, 1, -1.0, None), ("y", 1, 1, None, None)], True, True, None), ("b", [], True, True, 1.0)], schema)
    got = traces.final_samples(rows).collect()
    assert [(r.code, r.logprob, r.norm_logprob, r.score) for r in got] == [("y", -1.0, None, 0.0)]
    assert traces.final_samples(rows, missing=0.0).first().norm_logprob == 0.0
    first = traces.first_last(rows).first()
    assert (first.first_code, first.last_code, first.first_passed, first.last_passed) == ("x", "y", False, True)


def cascade_of(spark, rows):
    samples = spark.createDataFrame(rows, "qid string, layer int, pos int, model string, is_passed_public boolean, cluster int, passed boolean, score double, logprob double")
    config = [{"layer": k, "alpha": 1.0, "beta": 1.0, "threshold": 0.5} for k in range(2)]
    layers, chosen = runs.cascade_run(samples, config)
    return {(r.qid, r.layer): r for r in layers.collect()}, {r.qid: r for r in chosen.collect()}


def test_cascade_by_hand(spark):
    stop = [("s", 0, 0, "m0", True, 0, True, 1.0, -1.0), ("s", 0, 1, "m1", True, 0, True, 1.0, -1.0), ("s", 0, 2, "m0", True, 1, False, 0.0, -1.0), ("s", 0, 3, "m0", False, None, False, 0.0, -1.0)]
    empty_last = [("e", 0, 0, "m0", True, 0, True, 1.0, -1.0), ("e", 1, 0, "m0", False, None, True, 1.0, -1.0)]
    layers, chosen = cascade_of(spark, stop + empty_last)
    assert layers["s", 0].decision == "stop" and chosen["s"].final_layer == 0 and chosen["s"].final_score == 1.0
    assert layers["e", 0].decision == "continue" and layers["e", 1].decision == "skip_no_samples"
    assert math.isinf(layers["e", 1].score) and layers["e", 1].public_fail_rate == 1.0
    assert (chosen["e"].final_layer, chosen["e"].source, chosen["e"].final_score) == (-1, "", 0.0)
    assert len(chosen["s"].layer_details) == 1 and len(chosen["e"].layer_details) == 2


def test_selection_methods(spark):
    rows = spark.createDataFrame([("a", 0, 0, False, 0.2, "m/0"), ("a", 1, 1, True, 1.0, "m/1"), ("a", 2, 1, True, 1.0, "m/2")], "qid string, pos int, cluster int, first_passed boolean, score double, source string")
    vote = selection.select("major_voting", rows).first()
    assert (vote.passed, vote.num_clusters, vote.largest_cluster_size) == (True, 2, 2)
    assert selection.select("pass_at_n_oneshot", rows).first().num_passed == 2
    assert selection.vanilla(rows, seed=3).first() == selection.vanilla(rows, seed=3).first()
    both = selection.with_all(spark.createDataFrame([("a",), ("z",)], "qid string"), selection.vanilla(rows)).orderBy("qid").collect()
    assert (both[1].passed, both[1].score, both[1].source) == (False, 0.0, "none")
    with pytest.raises(ValueError):
        selection.select("best", rows)


def test_registry(spark):
    assert {"embed", "bleu", "nlg_deberta", "nlg_llm", "symbolic", "functional", "functional_vanilla"} <= set(registry.available_methods())
    with pytest.raises(ValueError):
        registry.method_info("none")
    samples = spark.createDataFrame([("a", 0, "x y z"), ("a", 1, "x y z"), ("a", 2, "q")], "qid string, pos int, code string")
    assert [r.cluster for r in registry.cluster_samples(samples, "ngrams").orderBy("pos").collect()] == [0, 0, 1]
    verdicts = spark.createDataFrame([("a", 0, 1, 2), ("a", 1, 0, 1), ("a", 0, 2, 2), ("a", 2, 0, 2), ("a", 1, 2, 0), ("a", 2, 1, 0)], "qid string, a int, b int, verdict int")
    assert [r.cluster for r in registry.cluster_samples(samples, "nlg_llm", verdicts=verdicts).orderBy("pos").collect()] == [0, 1, 0]
    assert [r.cluster for r in registry.cluster_samples(samples, "nlg_llm", verdicts=verdicts, strict=False).orderBy("pos").collect()] == [0, 0, 0]
    with pytest.raises(ValueError):
        registry.cluster_samples(samples.drop("pos"), "bleu")


def test_faulty_questions(spark):
    samples = spark.createDataFrame([("a", 0, "x"), ("a", 1, "x"), ("b", 0, None), ("b", 1, "y"), ("c", 0, "z")], "qid string, pos int, code string")
    samples = samples.withColumns({"first_passed": F.lit(True), "source": F.lit("m")})
    metadata = spark.createDataFrame([("a", "p", True), ("b", "p", False), ("c", "p", None)], "task_id string, prompt string, is_stdin boolean")
    found, errors = registry.cluster_sound(samples, "ngrams", metadata)
    assert [(r.qid, r.cluster) for r in found.collect()] == [("a", 0), ("a", 0)]
    rows = selection.answers("vanilla", found, spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "qid string"), errors).orderBy("qid").collect()
    assert [(r.passed, r.score, r.source, r.error) for r in rows] == [
        (True, 1.0, "m", None), (False, 0.0, "none", "a sample has no code"), (False, 0.0, "none", "the question has no metadata"), (False, 0.0, "none", None),
    ]
    assert selection.answers("vanilla", found, samples.select("qid")).filter("error IS NOT NULL").isEmpty()
    assert registry.faults(samples.limit(0), metadata).isEmpty()
    for bad in (metadata.drop("prompt"), metadata.withColumn("is_stdin", F.lit("no"))):
        with pytest.raises(ValueError):
            registry.faults(samples, bad)


def test_areas_with_outliers(spark):
    rows = [("m", float(k % 997) if k else math.inf, k % 3 == 0) for k in range(5000)]
    table = spark.createDataFrame(rows, "model string, entropy double, y boolean")
    met = evaluate.auroc(table.withColumn("y", F.col("y").cast("int")), ["model"]).first()
    wins = sum((n > p) + (n == p) / 2 for _, p, y in rows if y for _, n, z in rows if not z)
    positives = sum(y for _, _, y in rows)
    assert met.auroc == pytest.approx(wins / (positives * (5000 - positives)), abs=1e-9) and met.num_samples == 5000


def test_command_line(spark, tmp_path):
    from quorumkit.__main__ import main

    step = F.struct(F.lit("print(1)").alias("code"), F.lit(1).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"), F.lit(-1.0).alias("logprob"), F.lit(-1.0).alias("norm_logprob"))
    rows = spark.range(24).select(
        (F.col("id") % 4).cast("string").alias("question_id"), F.array(step).alias("debug_trace"), F.lit(True).alias("is_passed_public"), (F.col("id") % 4 > 1).alias("passed"),
        (F.col("id") % 4 > 1).cast("double").alias("score"), F.lit("easy").alias("difficulty"), F.when(F.col("id") < 12, "m").otherwise("n").alias("model"), F.expr("cast(id div 4 % 3 as int)").alias("round_id"),
    )
    writers.write_rounds(rows, f"{tmp_path}/rounds")
    main(["entropy", f"{tmp_path}/rounds", f"{tmp_path}/results", "--methods", "equality", "--options", '{"equality": {"key": ["code"]}}', "--rounds-used", "0,2"], spark)
    found = readers.results(spark, f"{tmp_path}/results").collect()
    assert len(found) == 8 and {(r.num_samples, r.num_clusters, r.method) for r in found} == {(2, 1, "equality")}
    main(["evaluate", f"{tmp_path}/results", f"{tmp_path}/reports"], spark)
    assert {r.auroc for r in spark.read.json(f"{tmp_path}/reports/evaluation").collect()} == {0.5}
    assert spark.read.json(f"{tmp_path}/reports/operating_points").count() > 0
    with pytest.raises(SystemExit):
        main(["entropy", "a", "b", "--methods", "none"], spark)


def test_code_bleu(spark):
    f = "def f(a, b):\n    total = a + b\n    for i in range(total):\n        total = total - i\n    return total\n"
    assert codebleu.code_bleu(f, f) == pytest.approx(1.0)
    assert codebleu.code_bleu(f, f.replace("total", "s")) > codebleu.code_bleu(f, "print('x')") >= 0
    assert codebleu.both_ways(f, "print(1)") == codebleu.both_ways("print(1)", f) and codebleu.both_ways(f, None) == 0.0
    a, b = "a b c d e".split(), "a b c d x".split()
    assert codebleu.ngram_match(a, b) == pytest.approx((4 / 5 * 3 / 4 * 2 / 3 * 1 / 2) ** 0.25)
    assert codebleu.ngram_match(a, b[:4]) == pytest.approx(math.exp(1 - 5 / 4))
    assert codebleu.code_bleu("", "") == 0.0
    samples = spark.createDataFrame([("q", 0, f), ("q", 1, f + "\n"), ("q", 2, "print(1)")], "qid string, pos int, code string")
    assert [r.cluster for r in registry.cluster_samples(samples, "bleu").orderBy("pos").collect()] == [0, 0, 1]


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "code"),
    [("a\n```python\nx = 1\n```\n```python\ny\n```", "x = 1"), ("```js\nabc\n```", "abc"), ("t <code> q </code>", "q"), ("  plain \n", "plain"), ("", ""), ("```python\n```", "")],
)
def test_code_block(spark, raw, code):
    assert one(spark, T.code_block(F.col("t")), t=raw) == code


@pytest.mark.parametrize(("raw", "code"), [("a ```python x``` b ```y```", "x"), ("```a``` b ```c```", "a``` b ```c"), ("```open", "```open"), ("```python open", "```python open"), (" t ", "t")])
def test_first_fence(spark, raw, code):
    assert one(spark, T.first_fence(F.col("t")), t=raw) == code


@pytest.mark.parametrize(("raw", "value"), [("[1, 'x']", "[1, 'x']"), ('{"a": [1, 2]}', {"a": [1, 2]}), (" 12 ", 12), ("-007", -7), ("1e3", 1000.0), (".5", 0.5), ("'abc'", "abc"), ('a"b', 'a"b'), ("", "")])
def test_values(spark, raw, value):
    assert json.loads(one(spark, T.value_json(F.col("t")), t=raw)) == value


def test_test_texts(spark):
    assert one(spark, T.functional_inputs(F.col("t")), t="n = 1, s = 'x'") == ["1", '"x"']
    assert one(spark, T.functional_inputs(F.col("t")), t="1\n\n [2] \n") == ["1", "[2]"]
    assert one(spark, T.functional_inputs(F.col("t")), t="a=[1,2]") == ['"[1"']  # lists are split at their commas
    assert one(spark, T.stdin_output(F.col("t")), t=" 3 4 -\n") == "3 4"
    assert one(spark, T.signature_name(F.col("t")), t="def  go (a)") == "go"
    assert one(spark, T.code_type(F.col("t")), t="x = input()") == "stdin"
    assert one(spark, T.file_name(F.col("t")), t="a/b\\c") == "a_b_c"
    assert one(spark, T.alias(F.col("t"), {"s": "vendor/small"}), t="s") == "vendor/small"
    assert one(spark, T.alias(F.col("t"), {"s": "vendor/small"}), t="z") == "z"


CODE = "import os\n\nclass A:\n    def inner(self, x):\n        return 1\n\ndef outer(a, b=2, *c):\n    return outer(a)\n\nasync def skip():\n    pass\n"


def test_syntax_trees():
    assert C.function_name(CODE) == "outer" and C.function_signature(CODE) == "outer(a, b)"
    assert C.function_name("def (") is None and C.function_signature("x = 1") is None
    assert C.function_definitions(CODE).startswith("def outer") and "class" not in C.function_definitions(CODE)
    assert C.function_definitions("x = 1") == "x = 1"
    renamed = C.rename_function(CODE, "outer", "fun1")
    assert "def fun1(a" in renamed and "return fun1(a)" in renamed and ast.parse(renamed)
    program = C.check_program("def f(x):\n    return f(x)", "def g(y):\n    return y")
    made: dict = {}
    exec(program, made)  # a program of these tests' own
    assert not made["agree"](1) and "def left(x)" in program and "def right(y)" in program
    exec(C.check_program("def f(x):\n    return 1 / x", "def h(x):\n    return x\n\ndef g(y):\n    return h(y)"), made)
    assert made["agree"](1) and not made["agree"](2) and not made["agree"](0)
    exec(C.check_program("def f(x):\n    return 1 / x", "def g(x):\n    return x ** -1"), made)
    assert made["agree"](0) and made["agree"](4) and made["agree"]("a")
    assert C.check_program("x", "def g(): pass") is None


@pytest.mark.parametrize(("text", "value"), [("10**9+7", 1000000007), ("7 % 4", 3), ("2 - 5", -3), ("-2**2 * 3", -12), ("9**99999", "9**99999"), ("1/0", None), ("f(1)", None), ("2**-1", 0.5)])
def test_arithmetic(text, value):
    assert L.tolerant(text) == (None if value is None else (value,))


def test_parse_tests():
    stdin = lambda t, **k: G.parse_tests(t, True, **k)
    assert stdin('```json\n[{"input": "1 2", "output": "3"}]\n```') == [{"input": "1 2\n", "output": "3\n", "testtype": "stdin"}]
    assert stdin("[{'input': '1', 'output': ''}]") == [{"input": "1\n", "output": "", "testtype": "stdin"}]
    assert stdin("Input: 1\nOutput: 2\nInput: 3\nOutput: 4") == [{"input": "1\n", "output": "2\n", "testtype": "stdin"}, {"input": "3\n", "output": "4\n", "testtype": "stdin"}]
    assert stdin('[{"input": "1"}]', output_needed=True) == []
    assert stdin("[{broken]") == [] and stdin(None) == [] and stdin("") == []
    plain = lambda t, **k: G.parse_tests(t, False, **k)
    assert plain('[{"input": 10**9, "output": 1}]') == [{"input": 10**9, "output": 1, "testtype": "functional"}]
    assert [t["input"] for t in plain('{"input": [1], "output": 2} {"input": [3], "output": 4}')] == [[1], [3]]
    assert [t["input"] for t in plain("{'input': [1]}\nnoise\n{\"input\": 2}")] == [[1], 2]


def test_nested_and_mixed():
    plain = lambda t, **k: G.parse_tests(t, False, **k)
    text = 'Here: {"input": {"a": {"b": [1, {"c": "}"}]}}, "output": {"d": {}}}\n{\'input\': (1, None), \'output\': True,} and {"input": [2**3, 7/2, 1+2*3], "output": -5 % 3}'
    assert [(t["input"], t["output"]) for t in plain(text)] == [({"a": {"b": [1, {"c": "}"}]}}, {"d": {}}), ([1, None], True), ([8, 3.5, 7], 1)]
    assert plain('[{"input": 2**999999, "output": 1}]')[0]["input"] == "2**999999"
    assert plain('{"input": 1/0, "output": 1}') == [] and plain("{" * 5000) == [] and plain("[" * 5000 + "]" * 5000) == []
    assert plain("[{'input': 1}]", fix_quotes=False) == [] and len(plain('[{"input": 10**2}]', fix_quotes=False)) == 1


def test_quotes():
    assert json.loads(L.as_json("{'a': \"it's\", 'b': (1, None)}")) == {"a": "it's", "b": [1, None]}
    assert json.loads(L.as_json("{'a': true}")) == {"a": True}
    assert L.as_json("{'a'") is None


TRACE = [{"code": "x", "prompt_tokens": 1, "completion_tokens": 1, "logprob": -1.0, "norm_logprob": -0.1}]


@pytest.fixture()
def saved(tmp_path):
    for model in ("m0", "m1"):
        for k in range(3):
            folder = tmp_path / "rounds" / "easy" / model
            folder.mkdir(parents=True, exist_ok=True)
            rows = [{"question_id": f"q{i}", "debug_trace": [{**TRACE[0], "code": f"c{(i + k) % 2}"}], "is_passed_public": i != 1, "passed": i == 0, "score": float(i == 0)} for i in range(3)]
            (folder / f"round_{k}.json{'l' if k else ''}").write_text("\n".join(map(json.dumps, rows)) + "\n\nno json\n")
    return tmp_path


CONFIG = {"layers_count": 2, "layers": [{"layer_idx": k, "samples": {"m0": [0, 1], "m1": [k]}, "alpha": 0.5, "beta": 0.5, "threshold": 0.5} for k in range(2)]}


def test_readers(spark, saved):
    rows = readers.rounds(spark, str(saved / "rounds"))
    assert rows.count() == 18 and {(r.difficulty, r.model) for r in rows.select("difficulty", "model").distinct().collect()} == {("easy", "m0"), ("easy", "m1")}
    assert [r.qid for r in readers.question_ids(rows).collect()] == ["q0", "q1", "q2"]
    one_model = readers.model_samples(rows.filter("model = 'm0'"), [2, 0]).filter("qid = 'q0'").orderBy("pos").collect()
    assert [(r.pos, r.round_id) for r in one_model] == [(0, 2), (1, 0)]
    assert readers.ensemble_samples(rows, ["m0", "m1"], [0, 1]).count() == 6
    with pytest.raises(ValueError):
        readers.ensemble_samples(rows, ["m0"], [0, 1])
    assert readers.padded_ensemble(["a", "b"], [1, 2, 3]) == ["a", "b", "b"] and readers.parse_rounds("0, 5,") == [0, 5]
    layers = readers.layer_samples(rows, CONFIG)
    assert layers.groupBy("layer").count().orderBy("layer").collect()[0]["count"] == 9
    assert {r.source for r in layers.filter("qid = 'q0' AND layer = 1").collect()} == {"m0/round_0", "m0/round_1", "m1/round_1"}
    assert readers.baseline_samples(rows, CONFIG).count() == 9
    named = clusters.by_key(layers.filter("is_passed_public").withColumn("g", F.struct("qid", "layer")), ["code"], "g").select("qid", "layer", "pos", "cluster")
    full = layers.join(named, ["qid", "layer", "pos"], "left")
    _, chosen = runs.cascade_run(full, readers.config_rows(CONFIG))
    out = writers.cascade_rows(chosen, full).collect()
    assert len(out) == 3 and all(r.layers for r in out)


def test_config(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(CONFIG, indent=1))
    assert readers.config(spark, str(path))["layers"][1]["samples"] == CONFIG["layers"][1]["samples"]
    for broken in ({"layers": []}, {**CONFIG, "layers_count": 3}, {"layers_count": 1, "layers": [{"layer_idx": 0}]}):
        with pytest.raises(ValueError):
            readers.check_config(broken)


def test_metadata_cache_and_problems(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"task_id": "a", "prompt": "old", "is_stdin": False}, {"task_id": "a", "prompt": "new", "is_stdin": True}]))
    assert [(r.prompt, r.is_stdin) for r in readers.questions(spark, str(tmp_path / "q.json")).collect()] == [("new", True)]
    test = [{"input": "1", "output": "2", "testtype": "stdin"}]
    lines = [{"task_id": "a", "is_stdin": True, "generated_tests": test}, {"question_id": "b", "is_stdin": True, "generated_tests": test}, {"task_id": "a", "is_stdin": True, "generated_tests": test * 2}, {"task_id": "c", "generated_tests": []}, {"task_id": "", "generated_tests": test}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)))
    cache = readers.test_cache(spark, str(tmp_path / "t.jsonl"))
    assert {(r.task_id, len(r.generated_tests)) for r in cache.collect()} == {("a", 2), ("b", 1)}
    fresh = spark.createDataFrame([("a", True, [("1", "2", "stdin"), ("9", "", "stdin")]), ("n", False, [("9", "", "stdin")] * 2)], "task_id string, is_stdin boolean, generated_tests array<struct<input:string,output:string,testtype:string>>")
    assert {(r.task_id, len(r.generated_tests)) for r in writers.upsert_tests(cache, fresh).collect()} == {("a", 3), ("b", 1), ("n", 2)}
    import base64
    import zlib

    private = base64.b64encode(zlib.compress(json.dumps(json.dumps(test)).encode())).decode()
    problem = {"question_id": "p", "question_content": "?", "starter_code": "", "difficulty": "easy", "contest_date": "2024-01-01T00:00:00", "public_test_cases": json.dumps(test), "private_test_cases": private}
    (tmp_path / "p.jsonl").write_text(json.dumps(problem))
    rows = readers.problems(spark, str(tmp_path / "p.jsonl"), "easy", "2024-01-01", "2024-01-01")
    example = readers.examples(rows).first()
    assert example.is_stdin and len(example.test) == 1 and len(example.public_tests) == 1
    assert readers.with_both_tests(readers.examples(rows)).count() == 1 and readers.tests_of(readers.examples(rows)).count() == 1
    assert readers.decode_private("gASV") == "[]" and readers.decode_private(None) == "[]"
    large = json.dumps([{"input": "x" * 300_000_000}])
    assert len(readers.decode_private(base64.b64encode(zlib.compress(large.encode(), 1)).decode())) == len(large)


def test_runs_and_results(spark, tmp_path):
    rng = random.Random(1)
    samples = spark.createDataFrame([(f"q{q}", p, rng.choice("ab"), -rng.random(), -rng.random(), float(rng.random() < 0.4)) for q in range(12) for p in range(5)], "qid string, pos int, ckey string, logprob double, norm_logprob double, score double")
    rows = runs.entropy_run(samples, "equality").selectExpr("*", "'easy' AS difficulty", "'m' AS model", "'equality' AS method")
    writers.write_results(rows, str(tmp_path / "r"))
    folder = tmp_path / "tree" / "easy" / "m" / "equality"
    folder.mkdir(parents=True)
    lines = [p.read_text() for p in (tmp_path / "r").glob("*/*/*/part-*.json")]
    (folder / "result.jsonl").write_text("\n\nbroken\n" + "".join(lines))
    back = readers.results(spark, str(tmp_path / "r"))
    assert sorted(map(str, back.collect())) == sorted(map(str, readers.results(spark, str(tmp_path / "tree")).select(back.columns).collect()))
    assert back.count() == 12
    areas, correlations = runs.evaluation_run(back)
    assert areas.count() == 16 and correlations.filter("p_value BETWEEN 0 AND 1").count() == correlations.count() == 32
    points = writers.operating_rows(areas)
    assert points.count() == 4 * areas.count() and points.filter("point = 'fpr_at_80'").agg(F.sum("value")).first() == areas.agg(F.sum("fpr_at_80")).first()
    writers.write_sorted(writers.evaluation_rows(areas), str(tmp_path / "e"))
    assert len(list((tmp_path / "e").glob("part-*"))) == 1


def test_appended_tests_write_what_changes(spark, tmp_path):
    """1 % of the keys: that many lines and few bytes more; nothing when repeated; compaction leaves the same cache in fewer lines."""
    at, kind = str(tmp_path / "cache"), "task_id string, is_stdin boolean, generated_tests array<struct<input:string,output:string,testtype:string>>"
    made = lambda ids, *inputs: spark.createDataFrame([(f"t{i}", i % 2 == 0, [(x, "", "stdin") for x in inputs]) for i in ids], kind)
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "cache").rglob("*.json"))
    read = lambda: {(r.task_id, r.is_stdin): [t.input for t in r.generated_tests] for r in readers.test_cache(spark, at).collect()}
    want = {(f"t{i}", i % 2 == 0): ["a", "b"] for i in range(2000)}
    writers.append_tests(spark, made(range(2000), "a", "b"), at)
    first = size()
    assert read() == want
    for inputs in (("b", "c"), ("c", "b"), ("d", "d")):
        before = size()
        writers.append_tests(spark, made(range(0, 2000, 100), *inputs), at)
        assert size() - before < first / 25 and (size() == before) == (inputs == ("c", "b"))
    want |= {(f"t{i}", True): ["a", "b", "c", "d", "d"] for i in range(0, 2000, 100)}
    odd = spark.createDataFrame([(None, True, [("x", "", "stdin")]), ("", True, [("x", "", "stdin")]), ("e", True, []), ("n", None, [("x", "", "stdin")]), ("n", False, [("y", "", "stdin")])], kind)
    writers.append_tests(spark, odd, at)
    writers.append_tests(spark, odd.limit(0), at)
    want[("n", False)] = ["y"]
    assert read() == want
    lines = lambda: readers.cache_lines(spark, at).count()
    assert lines() == 2041
    writers.compact_tests(spark, at, 2.0)
    assert lines() == 2041
    writers.compact_tests(spark, at, 1.0)
    assert lines() == 2001 and read() == want
    writers.append_tests(spark, made([0], "z"), at)
    assert read() == want | {("t0", True): [*want[("t0", True)], "z"]}


def test_stream_state_over_a_restart(spark, tmp_path):
    """Against the definition over all samples so far: digests that come again, new ones, no code, questions that stay away."""
    rng, source, seen = random.Random(11), tmp_path / "source", {}
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, questions in enumerate((["a", "b"], ["a", "c"], ["a", "b"])):
            lines = []
            for q in questions:
                codes = [rng.choice([None, *"uvwxyz"][: 3 + 2 * k]) for _ in range(rng.randint(1, 60))]
                seen[q] = seen.get(q, []) + codes
                lines += [json.dumps({"question_id": q, "debug_trace": [{"code": c, "logprob": -1.0}], "is_passed_public": True, "passed": True, "score": 1.0}) for c in codes]
            source.mkdir(exist_ok=True)
            (source / f"round_{k}.jsonl").write_text("\n".join(lines))
            got = {}
            stream = rounds.running_entropy(rounds.read_rounds(spark, str(source)))
            write = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
            write.foreachBatch(lambda batch, _: got.update({r.qid: (r.num_samples, r.num_clusters, r.DSE) for r in batch.collect()})).start().awaitTermination()  # noqa: B023
            assert set(got) == set(questions)
            for q, (samples, clusters, entropy) in got.items():
                counts = Counter(seen[q])
                brute = -sum(n / samples * math.log(n / samples + 1e-10) for n in counts.values())
                assert (samples, clusters) == (len(seen[q]), len(counts)) and abs(entropy - brute) < 1e-9
    finally:
        spark.conf.unset(key)


def test_stream(spark, saved):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = rounds.running_entropy(rounds.read_rounds(spark, str(saved / "rounds"), 2))
    query = stream.writeStream.format("memory").queryName("entropy").outputMode("update").option("checkpointLocation", str(saved / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = spark.table("entropy").groupBy("qid").agg(F.max("num_samples").alias("n"), F.max_by("DSE", "num_samples").alias("d")).collect()
    assert {r.qid: r.n for r in last} == {"q0": 6, "q1": 6, "q2": 6}
    assert all(0 < r.d < math.log(2) + 1e-9 for r in last)


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=60))
def test_parsers_never_fail(text):
    assert isinstance(G.parse_tests(text, True), list) and isinstance(G.parse_tests(text, False), list)
    L.as_json(text)
    C.function_name(text)


def brute_entropies(rows) -> dict:
    """The four measures of each question from their definitions, in exact shifts."""
    out = {}
    for q in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == q]
        lps = [lp for _, _, lp in own if lp is not None]
        sizes = Counter(c for _, c, _ in own)
        dse = -sum(n / len(own) * math.log(n / len(own) + 1e-10) for n in sizes.values())
        if not lps:
            out[q] = (None, None, None, dse)
            continue
        top = max(lps)
        e = [math.exp(x - top) for x in lps]
        z = sum(e)
        by = Counter()
        for _, c, lp in own:
            if lp is not None:
                by[c] += math.exp(lp - top)
        se = -sum(v / z * math.log(v / z) for v in by.values() if v > 0)
        out[q] = (-sum(lps) / len(lps), math.log(z) - sum(x * (lp - top) for x, lp in zip(e, lps)) / z, se, dse)
    return out


def entropy_rows(seed: int) -> list:
    rng = np.random.default_rng(seed)
    rows = [(int(q), int(c), None if rng.random() < 0.1 else float(-rng.exponential(s))) for q, c, s in zip(rng.integers(0, 12, 600), rng.integers(0, 9, 600), rng.choice([0.5, 20, 900], 600))]
    return rows + [(50, 0, None), (50, 1, None), (51, 0, -1000.0), (51, 1, -1001.0), (52, 3, -5000.0), (53, 0, 0.0), (53, 1, -32.0), (53, 1, -64.0), (None, 0, -1.0), (None, 1, -2.0)]


def near(got, want) -> bool:
    return all((a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-8) for a, b in zip(got, want))


def test_entropies_by_brute_force(spark):
    rows = entropy_rows(3)
    want = brute_entropies(rows)
    got = {r.qid: r for r in entropy.entropies(spark.createDataFrame(rows, "qid int, cluster int, logprob double")).collect()}
    assert got.keys() == want.keys()
    for q, r in got.items():
        assert near((r.PE_MC, r.PE_Rao, r.SE, r.DSE), want[q]), q


def test_parts_of_samples_add_up(spark):
    """However samples are dealt to parts, and whatever order parts are added in, the measures are those of all samples."""
    rows = entropy_rows(4)
    df = spark.createDataFrame([(k % 5, *r) for k, r in enumerate(rows)], "part int, qid int, cluster int, logprob double")
    parts = [entropy.entropy_parts(df.filter(F.col("part") == k)) for k in range(5)]
    two = entropy.add_parts(parts[3].unionByName(parts[1]))
    every = entropy.add_parts(two.unionByName(parts[0]).unionByName(parts[4]).unionByName(parts[2]))
    want = brute_entropies(rows)
    for r in entropy.entropies_of_parts(every).collect():
        assert near((r.PE_MC, r.PE_Rao, r.SE, r.DSE), want[r.qid])


def test_no_window_over_samples(spark):
    """Samples are counted before they are shuffled by question, and nothing sorts a question's samples."""
    df = spark.range(1000).selectExpr("id % 3 AS qid", "id % 50 AS cluster", "-CAST(id AS double) / 100 AS logprob")
    plan = entropy.entropies(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert "Window" not in entropy.discrete_entropy(df)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    """Six rounds of three models and two difficulties in both layouts; names have what patterns and paths treat apart."""
    base = tmp_path_factory.mktemp("tree")
    step = F.struct(F.lit("c").alias("code"), F.lit(1).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"), F.lit(-1.0).alias("logprob"), F.lit(-1.0).alias("norm_logprob"))
    model = F.element_at(F.array(F.lit("7"), F.lit("a+b [x]"), F.lit("m=*%?")), (F.col("id") % 3 + 1).cast("int"))
    rows = spark.range(72).select(
        F.col("id").cast("string").alias("question_id"), F.array(step).alias("debug_trace"), F.lit(True).alias("is_passed_public"), F.lit(True).alias("passed"), F.lit(1.0).alias("score"),
        F.when(F.col("id") % 2 == 0, "easy").otherwise("hard").alias("difficulty"), model.alias("model"), F.expr("cast(id div 6 % 6 as int)").alias("round_id"),
    )
    writers.write_rounds(rows.repartition(1), f"{base}/deep")
    for r in rows.select("difficulty", "model", "round_id").distinct().collect():
        folder = base / "flat" / r.difficulty / r.model
        folder.mkdir(parents=True, exist_ok=True)
        own = rows.filter((F.col("difficulty") == r.difficulty) & (F.col("model") == r.model) & (F.col("round_id") == r.round_id))
        (folder / f"round_{r.round_id}.jsonl").write_text("\n".join(x.value for x in own.select(F.to_json(F.struct(*writers.ROUND_COLUMNS)).alias("value")).collect()))
    return base, sorted(map(tuple, rows.select("question_id", "difficulty", "model", "round_id").collect()))


@pytest.mark.parametrize("layout", ["flat", "deep"])
@pytest.mark.parametrize(
    ("difficulty", "model", "wanted", "files"),
    [("*", "*", None, 36), ("easy", "*", None, 18), ("*", "a+b [x]", None, 12), ("*", "*", [(None, 1), (None, 4), (None, 4), (None, 99)], 12), ("*", "*", [("m=*%?", 5), ("7", 0)], 4),
     ("hard", "*", [("a+b [x]", 2)], 1), ("*", "7", [(None, 3)], 2), ("*", "7", [("a+b [x]", 3)], 0), ("none", "*", None, 0), ("*", "*", [], 0)],
)
def test_only_wanted_rounds_are_read(spark, tree, layout, difficulty, model, wanted, files):
    base, rows = tree
    found = readers.rounds(spark, f"{base}/{layout}", difficulty, model, wanted)
    assert len(found.inputFiles()) == files
    kept = [r for r in rows if difficulty in ("*", r[1]) and model in ("*", r[2]) and (wanted is None or any(m in (None, r[2]) and k == r[3] for m, k in wanted))]
    assert sorted(map(tuple, found.select("question_id", "difficulty", "model", "round_id").collect())) == kept


def test_filters_prune_written_rounds(spark, tree):
    found = readers.rounds(spark, f"{tree[0]}/deep").filter("round_id IN (1, 2) AND model = '7'")
    assert found.count() == 8
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [round_id" in plan.replace("isnotnull(model", "round_id") and "round_id#" in plan.split("PartitionFilters")[1].split("]")[0]


def test_results_of_one_method_are_read(spark, tmp_path):
    rows = spark.range(8).selectExpr("CAST(id AS STRING) AS problem_id", "CAST(id % 2 AS STRING) AS difficulty", "'m/n' AS model", "CASE WHEN id < 4 THEN 'a' ELSE 'b c' END AS method", "1.0D AS DSE")
    writers.write_results(rows, f"{tmp_path}/r", {"x": 1})
    assert readers.results(spark, f"{tmp_path}/r").count() == 8
    some = readers.results(spark, f"{tmp_path}/r", "1", "m/n", "b c")
    assert sorted((r.problem_id, r.difficulty, r.model, r.method) for r in some.collect()) == [("5", "1", "m/n", "b c"), ("7", "1", "m/n", "b c")]
    assert len(some.inputFiles()) < len(readers.results(spark, f"{tmp_path}/r").inputFiles())
    assert readers.results(spark, f"{tmp_path}/r", method="none").count() == 0


def plain_areas(rows) -> dict:
    """Areas by counting pairs."""
    out = {}
    for g in {r[0] for r in rows}:
        own = [(e, y) for h, e, y in rows if h == g]
        p, n = [e for e, y in own if y], [e for e, y in own if not y]
        out[g] = (sum((b > a) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n)) if p and n else 0.0, len(own))
    return out


SPREADS = {
    "outliers": lambda r, n: np.where(r.random(n) < 0.02, r.choice([1e300, -1e300, 1e-300, math.inf, -math.inf], n), r.integers(0, 40, n) / 7),
    "one value": lambda r, n: np.where(r.random(n) < 0.95, 0.5, r.random(n)),
    "negative": lambda r, n: -r.exponential(3, n),
    "tiny": lambda r, n: r.choice([0.0, -0.0, -1e-10, 5e-324, 1e-310, -5e-324], n),
    "powers": lambda r, n: 2.0 ** r.integers(-30, 30, n) * r.choice([1, 1 - 2**-53, 1 + 2**-52, -1], n),
}


@pytest.mark.parametrize("spread", sorted(SPREADS))
def test_areas_by_counting_pairs(spark, spread):
    r = np.random.default_rng(7)
    e, y = SPREADS[spread](r, 400), r.integers(0, 2, 400)
    rows = [("g" if k % 3 else None, float(e[k]), int(y[k])) for k in range(400)] + [("ones", 1.0, 1), ("none", 2.0, 0)]
    got = {x.g: (x.auroc, x.num_samples) for x in evaluate.auroc(spark.createDataFrame(rows, "g string, entropy double, y int"), ["g"]).collect()}
    want = plain_areas(rows)
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == (pytest.approx(want[g][0], abs=1e-9), want[g][1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=40))
def test_ranges_are_in_order(spark, numbers):
    rows = spark.createDataFrame([(x,) for x in numbers], "e double").select("e", evaluate.entropy_range(F.col("e")).alias("r")).collect()
    rows = sorted((x.e, x.r) for x in rows)
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:])) and all((e == 0) == (r == 0) for e, r in rows)


def scans(df, name: str) -> int:
    """How often a table's files are read by a plan, once it has run: exchanges that were reused read nothing."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    return sum("Scan" in line and name in line for line in plan.split("== Initial Plan ==")[0].splitlines())


def test_measures_are_read_once(spark):
    from quorumkit import queries

    from .conftest import SF

    assert scans(evaluate.evaluate(queries.rounded_lines(spark, SF)), "lineitem") <= 4
    c = queries.line_clusters(spark, SF)
    both = entropy.entropies(c).join(evaluate.question_scores(c), "qid")
    key = lambda df: sorted(tuple(None if v is None else round(float(v), 9) for v in r) for r in df.select(sorted(both.columns)).collect())
    assert key(evaluate.question_measures(c)) == key(both)


def vectors_of(rng, n: int, d: int = 24) -> list:
    """Unit-like vectors of which some are near each other, some of zeros, null, or with odd numbers."""
    base = rng.normal(size=(8, d))
    v = base[rng.integers(0, 8, n)] * rng.choice([0.0, 1.0, 2.0], n)[:, None] + rng.normal(size=(n, d)) * rng.choice([0.1, 1.0], n)[:, None]
    rows = [list(map(float, x)) for x in np.float32(v)]
    rows[3], rows[7], rows[11], rows[12] = [0.0] * d, None, [1.0] * (d - 1), rows[13]
    return rows


@pytest.mark.parametrize("threshold", [0.0, 0.1, 0.3, 0.5, 0.7, 0.9])
def test_cosine_links(spark, threshold):
    """Tiles give the pairs that all pairs give, at every threshold, for several questions at once."""
    rng = np.random.default_rng(int(threshold * 10))
    rows = [(q, k, v) for q, n in ((None, 90), ("a", 200), ("b", 40), ("c", 70)) for k, v in enumerate(vectors_of(rng, n))]
    samples = spark.createDataFrame(rows, "qid string, pos int, v array<float>")
    want = sorted(map(tuple, similarity.above(similarity.cosine_pairs(samples, "v"), threshold).select("qid", "a", "b").collect()))
    for limit, tile in ((64, 32), (10, 1024), (64, 7)):
        got = similarity.cosine_links(samples, "v", threshold, limit=limit, tile=tile)
        assert sorted(map(tuple, got.filter("qid IS NOT NULL").collect())) == want
    assert similarity.cosine_links(samples.limit(0), "v", threshold).count() == 0


def test_cosines_at_the_threshold(spark):
    """Pairs whose cosine is the threshold itself, or the next number to it."""
    rows = [(0, k, [float(x) for x in v]) for k, v in enumerate([[3, 4], [4, 3], [1, 0], [0, 1], [1, 1], [0.6, 0.8], [24, 7]])]
    samples = spark.createDataFrame(rows, "qid int, pos int, v array<double>")
    for p in similarity.cosine_pairs(samples, "v").collect():
        for t in (p.similarity, np.nextafter(p.similarity, 0)):
            want = similarity.above(similarity.cosine_pairs(samples, "v"), float(t)).select("a", "b").collect()
            assert sorted(similarity.cosine_links(samples, "v", float(t), limit=1, tile=3).select("a", "b").collect()) == sorted(want)


def test_rows_that_bounds_leave_out():
    """At high thresholds most pairs are settled by a part of their numbers."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 64))
    x[1] = x[0] + 0.01
    unit, share = x / np.linalg.norm(x, axis=1, keepdims=True), {}
    for t in (0.1, 0.5, 0.7, 0.9):
        i, j, whole = similarity.near_rows(x, x, t, same=True)
        share[t] = whole / 600**2
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(np.triu(unit @ unit.T > t, 1)))))
        i, j, _ = similarity.near_rows(x[:200], x[200:], t)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(unit[:200] @ unit[200:].T > t))))
    assert share[0.1] > 0.9 and share[0.7] < 0.8 and share[0.9] < 0.01


PROGRAMS = [
    "def f(a, b):\n    total = a + b\n    for i in range(total):\n        total = total - i\n    return total\n", "def g(a):\n    x = a\n    y = x\n    return [z for z in y if z]\n",
    "def f(a, b):\n    return a + b", "x = 1\nx += 2\nprint(x)", "def broken(", "", None, " \n", "return return if", "a b c d e f", "async def h(x: int = 3) -> int:\n    with x as y:\n        return await y", "(" * 3000 + ")" * 3000,
]


def test_code_bleu_by_pairs_of_programs(spark):
    """Each part from rows that meet by equality against the part from two parsed programs."""
    rows = [(k % 2, k, c) for k, c in enumerate(PROGRAMS * 2)] + [(5, 0, PROGRAMS[0])]
    got = {(r.qid, r.a, r.b): r for r in similarity.code_bleu_parts(spark.createDataFrame(rows, "qid int, pos int, code string"), "code").collect()}
    assert len(got) == 2 * 12 * 11 // 2
    mean = lambda f, x, y: (f(x, y) + f(y, x)) / 2
    for (q, a, b), r in got.items():
        x, y = rows[a][2], rows[b][2]
        sound = codebleu.features(x)[0] and codebleu.features(y)[0]
        want = [0.0] * 4
        if sound:
            u, v = codebleu._parsed(x), codebleu._parsed(y)
            want = [mean(f, x.split(), y.split()) for f in (codebleu.ngram_match, codebleu.weighted_match)]
            want += [mean(codebleu._share, f(u), f(v)) for f in (codebleu._subtrees, codebleu._flows)]
        assert [r.ngram, r.weighted, r.tree, r.flow] == pytest.approx(want, abs=1e-9), (x, y)
    whole = {(r.a, r.b): r.similarity for r in similarity.code_bleu_pairs(spark.createDataFrame(rows, "qid int, pos int, code string").filter("qid = 0"), "code").collect()}
    assert all(s == pytest.approx(codebleu.both_ways(rows[a][2], rows[b][2]), abs=1e-9) for (a, b), s in whole.items())


def test_command_line_of_selections(spark, saved):
    """Cascade and baselines over saved rounds, with a question that has no metadata."""
    from quorumkit.__main__ import main

    (saved / "c.json").write_text(json.dumps(CONFIG))
    (saved / "q.json").write_text(json.dumps([{"task_id": q, "prompt": "p", "is_stdin": False} for q in ("q0", "q1")]))
    rounds_, config, metadata = (str(saved / n) for n in ("rounds", "c.json", "q.json"))
    for _ in range(2):  # a second run writes in place of the first
        main(["cascade", rounds_, config, str(saved / "out"), "--metadata", metadata, "--options", '{"key": ["code"]}'], spark)
    full = {r.qid: r for r in spark.read.json(str(saved / "out" / "full")).collect()}
    assert {q: (r.final_layer, r.error if "error" in r else None) for q, r in full.items()} == {"q0": (0, None), "q1": (-1, None), "q2": (-1, "the question has no metadata")}
    assert full["q0"].final_score == 1.0 and full["q0"].final_passed and full["q1"].source == ""
    assert {r.qid for r in spark.read.json(str(saved / "out" / "report")).collect()} == {"q0", "q1", "q2"}
    main(["baselines", rounds_, config, str(saved / "base"), "--metadata", metadata], spark)
    rows = spark.read.json(str(saved / "base" / "answers")).collect()
    assert {(r.qid, r.method): r.passed for r in rows} == {(q, m): q == "q0" for q in ("q0", "q1", "q2") for m in selection.METHODS}
    assert {r.error for r in rows if r.qid == "q2"} == {"the question has no metadata"} and all(r.error is None for r in rows if r.qid != "q2")
    totals = spark.read.json(str(saved / "base" / "statistics" / "vanilla")).first()
    assert (totals.total_questions, totals.passed, totals.accuracy) == (3, 1, pytest.approx(1 / 3))
    told = json.loads("\n".join(r.value for r in spark.read.text(str(saved / "base" / "config")).collect()))
    assert told["config"] == CONFIG and told["parameters"]["seed"] == 0


def test_cascade_answers_of_faulty_and_unsampled_questions(spark):
    stop = [("s", 0, 0, "m0", True, 0, True, 1.0, -1.0), ("f", 0, 0, "m0", True, 0, True, 1.0, -1.0)]
    samples = spark.createDataFrame(stop, "qid string, layer int, pos int, model string, is_passed_public boolean, cluster int, passed boolean, score double, logprob double")
    _, chosen = runs.cascade_run(samples, [{"layer": 0, "alpha": 1.0, "beta": 1.0, "threshold": 0.5}])
    questions = spark.createDataFrame([("s",), ("f",), ("n",), ("n",)], "qid string")
    errors = spark.createDataFrame([("f", "broken"), ("x", "unknown")], "qid string, error string")
    got = {r.qid: (r.final_score, r.final_layer, r.source, r.error, len(r.layer_details)) for r in selection.cascade_answers(chosen, questions, errors).collect()}
    assert got == {"s": (1.0, 0, "m0/0", None, 1), "f": (0.0, -1, "", "broken", 0), "n": (0.0, -1, "", None, 0)}
    assert selection.cascade_answers(chosen, questions).filter("error IS NOT NULL").count() == 0


def test_selections_are_read_few_times(spark):
    from quorumkit import queries

    from .conftest import SF

    assert scans(queries.line_layers(spark, SF)[1], "lineitem") <= 4
    assert scans(selection.select("pass_at_n", queries.baseline_lines(spark, SF)), "lineitem") == 1
    assert scans(queries.event_clusters(spark, SF), "events") == 1


def test_links_by_a_function(spark):
    """A function of one's own, the same both ways or not, over tiles: what it says of each pair in order."""
    rng = random.Random(3)
    rows = [(q, k, None if rng.random() < 0.1 else rng.randrange(60)) for q in ("a", "b", None) for k in rng.sample(range(500), 70)]
    samples = spark.createDataFrame(rows, "qid string, pos int, v int")

    def ahead(x: list, y: list) -> np.ndarray:
        return np.array([[float("nan") if a is None or b is None else (b - a) % 7 for b in y] for a in x], float)

    def near(x: list, y: list) -> np.ndarray:
        return np.array([[-1.0 if a is None or b is None else 1 / (1 + abs(a - b)) for b in y] for a in x], float)

    for f, t, both in ((ahead, 4, False), (near, 0.4, True), (near, 0.4, False)):
        want = {(q, a, b) for q, a, x in rows for r, b, y in rows if q == r and a < b and f([x], [y])[0, 0] > t}
        for tile in (9, 1000):
            found = [tuple(r) for r in similarity.links_by(samples, "v", f, t, both, tile=tile).collect()]
            assert set(found) == want and len(found) == len(want)
    assert similarity.links_by(samples.limit(0), "v", near, 0.4).count() == 0


def test_a_registered_similarity(spark):
    rows = [("q", k, v) for k, v in enumerate([1, 5, 2, 9, 6, 3])]
    samples = spark.createDataFrame(rows, "qid string, pos int, v int")
    registry.register_similarity("beside", lambda x, y: (np.abs(np.subtract.outer(x, y)) <= 1).astype(float), "v", 0.5, "numbers beside each other", symmetric=True)
    try:
        for algorithm, want in (("dfs", [0, 1, 0, 2, 1, 0]), ("greedy", [0, 1, 0, 2, 1, 3])):
            got = registry.cluster_samples(samples, "beside", algorithm=algorithm).orderBy("pos").collect()
            assert [r.cluster for r in got] == want
        assert registry.method_info("beside")["description"] == "numbers beside each other"
    finally:
        del registry.METHODS["beside"]


def test_batches_of_rounds_count_once(spark, tmp_path, monkeypatch):
    """A stream that ends between its write and its commit, and is started again."""
    step = F.struct(F.lit("c").alias("code"), F.lit(1).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"), F.lit(-1.0).alias("logprob"), F.lit(-1.0).alias("norm_logprob"))
    made = lambda lo, hi: spark.range(lo, hi).select(F.col("id").cast("string").alias("question_id"), F.array(step).alias("debug_trace"), F.lit(True).alias("is_passed_public"), F.lit(True).alias("passed"), F.lit(1.0).alias("score"), F.lit("easy").alias("difficulty"), F.lit("m").alias("model"), (F.col("id") % 2).cast("int").alias("round_id"))
    source, folder, checkpoint = (f"{tmp_path}/{n}" for n in ("source", "rounds", "checkpoint"))
    made(0, 10).coalesce(1).write.parquet(source)
    start = lambda: rounds.save_rounds(spark.readStream.schema(made(0, 1).schema).parquet(source), folder, checkpoint).awaitTermination()
    start()
    made(10, 30).coalesce(1).write.mode("append").parquet(source)
    write = writers.write_rounds

    def broken(*a, **k):
        write(*a, **k)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(rounds, "write_rounds", broken)
        with pytest.raises(Exception, match="lost"):
            start()
    for _ in range(2):
        start()
        back = readers.rounds(spark, folder)
        assert sorted(int(r.question_id) for r in back.collect()) == list(range(30)) and "batch" not in back.columns
        assert readers.rounds(spark, folder, wanted=[("m", 1)]).count() == 15


def test_clusters_by_outputs_by_brute_force(spark):
    """Against every sample's vector on every test: missing, null, repeated and failed outputs, outputs of no sample."""
    rng = random.Random(6)
    samples = [(q, p) for q in range(25) for p in range(rng.randint(1, 7))]
    outputs = [(q, p, t, rng.choice(["1", "1", "2", None, "Error: x", "an Error: y"])) for q in range(27) for p in range(8) for t in range(rng.randint(0, 4)) for _ in range(rng.choice([0, 1, 1, 1, 2])) if rng.random() < 0.9]
    given: dict = {}
    for q, p, t, o in outputs:
        given.setdefault((q, p, t), []).append("ERROR" if o and "Error:" in o else o)
    least = {k: min((o for o in v if o is not None), default="ERROR") for k, v in given.items()}
    want, errors = {}, {}
    for q in {q for q, _ in samples}:
        own, tests = [p for r, p in samples if r == q], sorted({t for r, _, t, _ in outputs if r == q})
        failed = {t: sum(least.get((q, p, t), "ERROR") == "ERROR" for p in own) for t in tests}
        errors |= {(q, t): (n, len(own)) for t, n in failed.items()}
        valid, ids = [t for t in tests if failed[t] < len(own) / 2], {}
        for p in own:
            key = tuple(least.get((q, p, t), "ERROR") for t in valid) if valid else p
            want[q, p] = ids.setdefault(key, len(ids))
    s = spark.createDataFrame(samples, "qid int, pos int")
    o = spark.createDataFrame(outputs, "qid int, pos int, test int, output string")
    assert {(r.qid, r.pos): r.cluster for r in functional.by_outputs(s, o).collect()} == want
    assert {(r.qid, r.test): (r.errors, r.n) for r in functional.error_counts(s, o).collect()} == errors
    assert functional.by_outputs(s.limit(0), o).count() == 0
    assert [r.cluster for r in functional.by_outputs(s.filter("qid = 0"), o.limit(0)).orderBy("pos").collect()] == list(range(sum(q == 0 for q, _ in samples)))
