"""What plans read and shuffle, of which the work on large tables is made."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from jobs import answer_chats
from quorumkit import queries
from quorumkit.functions import codebleu
from quorumkit.operators import clusters, entropy, evaluate, functional, selection, similarity, traces

from .conftest import SF
from .test_cases import scans


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


def test_measures_of_samples_by_question_shuffle_no_more(spark):
    clustered = queries.line_clusters(spark, SF)
    assert exchanges(clustered) == exchanges(evaluate.question_measures(clustered)) == exchanges(entropy.entropies(clustered)) == 1


def test_stored_counts_are_all_that_curves_read(spark):
    assert scans(evaluate.roc_summary(queries.rounded_lines(spark, SF), least=queries.SHOWN), "lineitem") == 0


def test_counts_are_those_of_the_long_form(spark):
    rows = [("m", "x", d, y, z, *e) for d, y, z, e in ((None, 1, 0, (0.5, None, 0.0, float("nan"))), ("d", 0, None, (0.5, 1.0, -0.0, float("nan"))), ("d", 1, 1, (0.5, 1.0, 2.0, None)), ("overall", 1, 0, (0.5, 0.25, 2.0, 1.0)))]
    df = spark.createDataFrame(rows, "model string, method string, difficulty string, pass_at_n int, pass_at_cluster int, PE_MC double, PE_Rao double, SE double, DSE double")
    keys, targets = ["model", "method", "difficulty"], ["pass_at_n", "pass_at_cluster"]
    flat = evaluate.with_overall(evaluate.long_form(df, keys, targets))
    want = flat.groupBy(*keys, "metric", "entropy_type", F.col("entropy").alias("__e")).agg(F.sum(F.col("y").cast("long")).alias("p"), F.sum(1 - F.col("y").cast("long")).alias("n"))
    assert sorted(map(repr, evaluate._counted(df, keys, targets).collect())) == sorted(map(repr, want.collect()))


def test_cascades_read_and_shuffle_samples_once(spark):
    layers, chosen = queries.line_layers(spark, SF)
    assert exchanges(layers) == exchanges(chosen) == 1 and scans(chosen, "lineitem") == 1


def test_cascade_of_odd_samples(spark):
    """Null flags, layers without passing samples, layers that the configuration lacks, and a question without an id."""
    rows = [("a", 0, 0, "m", True, True, 1.0, -1.0, 0), ("a", 0, 1, "n", True, False, 0.0, None, 0), ("a", 0, 2, "n", None, False, 0.0, -1.0, None), ("b", 7, 0, "m", True, True, 1.0, -1.0, 0),
            ("c", 0, 0, "m", False, True, 1.0, -1.0, None), ("c", 1, 0, "m", True, False, 0.25, -40.0, 0), ("c", 1, 1, "m", True, True, 1.0, -1.0, 1), (None, 0, 0, "m", True, True, 1.0, -1.0, 0)]
    df = spark.createDataFrame(rows, "qid string, layer int, pos int, model string, is_passed_public boolean, passed boolean, score double, logprob double, cluster int")
    config = [{"layer": k, "alpha": 1.0, "beta": 1.0, "threshold": 0.5} for k in (0, 1)]
    got = {(r.qid, r.layer): (r.total_count, r.passed_public_count, r.num_clusters, r.top_cluster, r.top_size, r.decision, r.pick and r.pick.pos) for r in selection.cascade_layers(df, config, seed=None).collect()}
    none = (0, 0, 0, None, 0, "skip_no_samples", None)
    assert got == {
        ("a", 0): (3, 2, 1, 0, 2, "stop", 0), ("a", 1): none, ("b", 0): none, ("b", 1): none, ("c", 0): (1, 0, 0, None, 0, "skip_no_samples", None),
        ("c", 1): (2, 2, 2, 0, 1, "stop", 0), (None, 0): none, (None, 1): none,
    }


def test_saved_rounds_are_small_and_parsed_once(spark):
    from quorumkit import queries_files
    from quorumkit.plans import runs

    rows = queries_files.saved_rounds(spark, SF)
    assert all(x.endswith(".json.gz") for x in rows.inputFiles())
    assert scans(runs.cascade_sweep(rows, queries_files.CONFIG, "equality", seed=None, key=["code"])[0], "json") == 0
    assert scans(runs.entropy_sweep(rows, {"equality": {"key": ["code"]}}, [0, 1]), "json") == 0
    assert scans(runs.baseline_sweep(rows, queries_files.CONFIG, ["pass_at_n"]), "json") == 0


def test_a_program_is_parsed_once_to_be_renamed(monkeypatch):
    from quorumkit.functions import code as C

    read, parse = [], C._tree
    monkeypatch.setattr(C, "_tree", lambda code: read.append(code) or parse(code))
    for k in range(5):
        assert C.check_program(f"def f{k}(a):\n    return f{k}(a - 1)\n", "def second(x):\n    return x\n").startswith("def left(a):\n    return left(a - 1)\n\n\ndef right(x):\n")
    assert len(read) == 2 * 5 + 2  # each program, and what became of it
    assert C.check_program("def broken(", "def h(x): pass") is C.check_program("x = 1", None) is None


def test_programs_are_read_once_and_never_by_the_driver(spark):
    df = queries.code_bleu_pairs(spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Broadcast" not in plan and plan.count("- ArrowEvalPython") == 1


def test_pairs_of_programs_shuffle_texts_only(spark):
    """One exchange, below the parser: no n-gram, subtree or flow is shuffled."""
    df = queries.code_bleu_pairs(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert exchanges(df) == 1 and plan.index("- ArrowEvalPython") < plan.index("Exchange hashpartitioning")


def test_pairs_of_programs_in_rows_and_by_joins(spark):
    rng = random.Random(5)
    lines = ["x = a", "y = x + a", "for i in range(y):\n    x = i", "return return", "if x: y = 2", "def f(a):\n    return a if a else 1", "s = '\u00a0 \u2003'", "\u85cf = '\U0001f600'"]
    text = lambda: rng.choice([None, "", " \x0b\t", "(" * 3000, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 5)))])
    rows = [(q, p, text()) for q in (*range(12), None) for p in (0, 1, 5, 3, None, 5, 5)[: rng.randint(1, 7)]] + [(20, p, text()) for p in range(40)]
    samples = spark.createDataFrame(rows, "qid int, pos long, code string")
    every = [similarity.code_bleu_parts(samples, "code", limit=k) for k in (0, 32, 64)]
    rounded = [sorted(map(str, queries.rounded(df).collect())) for df in every]
    assert rounded[0] == rounded[1] == rounded[2] and len(rounded[0]) > 40 * 39 // 2 and every[0].dtypes == every[1].dtypes == every[2].dtypes


def test_items_of_programs_are_counted_in_parts(monkeypatch):
    samples = [codebleu.counted([c]) for c in ("a b a b", "def f(a):\n    return a", None, "a b c\n" * 3)]
    whole = codebleu.shared_counts(samples)
    monkeypatch.setattr(codebleu, "ITEMS", 2)
    assert all((x == y).all() for x, y in zip(whole, codebleu.shared_counts(samples)))
    assert whole[0][0].tolist() == [0, 4, 3, 2, 1, 0, 0] and whole[1][2].tolist() == [0, 4, 2, 0, 0, 0, 0]  # the first and the last share a twice, b twice, "a b" twice


def test_clusters_by_outputs_shuffle_samples_and_outputs_only(spark):
    """By question: samples for their rows, samples for their positions, and outputs."""
    assert exchanges(queries.functional_clusters(spark, SF)) <= 3


def test_clusters_by_outputs_in_rows_and_by_joins(spark):
    rows = [(q, p, t, ("a", "a", "b", None, "Error: x", "ERROR")[(7 * q + 3 * p * p + 5 * (t or 0) + p * q * (t or 0)) % 6]) for q in range(40) for p in range(-1, q % 9) for t in (0, 1, 2, None) if (q + p) % 7]
    outputs = spark.createDataFrame(rows + rows[::3] + [(q, p, t, "c") for q, p, t, _ in rows[::11]], "qid int, pos int, test int, output string")
    samples = spark.createDataFrame([(f"s{p}", q, p) for q in range(38) for p in range(q % 9 + 1)] + [("again", 8, 2)], "name string, qid int, pos int")
    both = [functional.by_outputs(samples, outputs, limit=k) for k in (0, 64)]
    assert both[0].columns == both[1].columns and both[0].dtypes == both[1].dtypes
    got = [sorted(map(str, df.collect())) for df in both]
    assert got[0] == got[1] and len(got[0]) == samples.count()
    odd = samples.union(spark.createDataFrame([("no question", None, 0), ("no place", 3, None)], samples.schema))
    assert sorted(map(str, functional.by_outputs(odd, outputs).collect())) == sorted(map(str, functional.by_outputs(odd, outputs, limit=0).collect()))


def test_symbolic_clusters_shuffle_samples_only(spark):
    """By question: samples for themselves, for their positions, for both sides of the pairs, and ids; no join by position."""
    assert exchanges(queries.symbolic_directed_components(spark, SF)) <= 5


def test_components_of_many_questions(spark):
    """Against searches from each position that is not yet reached; with links of no sample, repeated ones and positions that leave gaps."""
    rng = random.Random(9)
    at = {q: sorted(rng.sample(range(100), rng.randint(1, 30))) for q in range(60)}
    links = [(q, rng.choice([*own, 200]), rng.choice([*own, None])) for q, own in at.items() for _ in range(rng.randint(0, len(own)))] + [(99, 0, 1)] * 3
    samples = spark.createDataFrame([(f"s{p}", q, p) for q, own in at.items() for p in own], "name string, qid int, pos int")
    ends = spark.createDataFrame(links, "qid int, a int, b int")
    for directed in (False, True):
        want = {}
        for q, own in at.items():
            for root in own:
                todo = [root] if (q, root) not in want else []
                k = 1 + max([c for (r, _), c in want.items() if r == q], default=-1)
                while todo:
                    p = todo.pop()
                    if want.setdefault((q, p), k) == k:
                        near = [b for r, a, b in links if (r, a) == (q, p)] + [a for r, a, b in links if (r, b) == (q, p) and not directed]
                        todo += [n for n in near if n in own and (q, n) not in want]
        for limit in (10, 64):
            assert {(r.qid, r.pos): r.cluster for r in clusters.components(samples, ends, directed=directed, limit=limit).collect()} == want
            whole = clusters.components(samples, ends, directed=directed, limit=limit, whole=True)
            assert {(r.qid, r.pos): r.cluster for r in whole.collect()} == want and whole.columns == ["qid", "pos", "name", "cluster"]


def test_ngram_pairs_shuffle_texts_only(spark):
    assert exchanges(queries.bleu_ngram_pairs(spark, SF)) == 1


def test_ngram_pairs_by_question_and_by_joins(spark):
    rng = random.Random(3)
    texts = lambda: rng.choice([None, "", " ", " ".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))])
    rows = [(q, p, texts()) for q in (*range(20), None) for p in (0, 1, 3, 4, None, 4)]
    samples = spark.createDataFrame(rows, "qid int, pos int, code string")
    for n in (1, 2, 3):
        both = [sorted(map(str, similarity.ngram_precision_pairs(samples, "code", n, limit=k).collect())) for k in (0, 64)]
        assert both[0] == both[1] and len(both[0]) == 20 * 9


def test_chats_are_clustered_by_question(spark):
    samples = spark.createDataFrame([(1, k, "a b", 1) for k in range(3)], "qid long, pos long, code string, steps long")
    found = answer_chats.clustered(samples, answer_chats.SETTINGS)
    assert exchanges(found) <= 4 and found.columns == [*samples.columns, "cluster"] and [r.cluster for r in found.collect()] == [0, 0, 0]


def test_results_of_tests_that_hold_nulls_are_not_missing(spark):
    expected = spark.createDataFrame([("a", k) for k in range(4)], "qid string, test int")
    results = spark.createDataFrame([("a", 0, None, "m", 1.0), ("a", 1, True, None, None), ("a", 3, None, None, None)], "qid string, test int, passed boolean, message string, seconds double")
    got = {r.test: (r.passed, r.message, r.seconds) for r in traces.fill_tests(expected, results).collect()}
    assert got == {0: (None, "m", 1.0), 1: (True, None, None), 2: (False, "Error: Time out!", float("inf")), 3: (None, None, None)}


def test_missing_tests_as_sql_where_quantities_are_null(spark, tmp_path):
    import duckdb

    from .conftest import rows_of

    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines.withColumn("l_quantity", F.when(F.col("l_partkey") % 7 > 0, F.col("l_quantity"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW lineitem AS SELECT * REPLACE (CASE WHEN l_partkey % 7 > 0 THEN l_quantity END AS l_quantity) FROM '{SF}/lineitem.parquet'")
    got = queries.QUERIES["fill_missing_tests"](spark, str(tmp_path)).toArrow()
    assert rows_of(got) == rows_of(duck.sql(queries.ORACLE_SQL["fill_missing_tests"]).to_arrow_table())
