"""Queries that write the driver's tables as files of each kind, read them back and compare with SQL on the tables."""

from __future__ import annotations

import base64
import json
import zlib
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import entropy
from .plans.bindings import bound
from .plans.runs import baseline_sweep, cascade_sweep, entropy_sweep
from .queries import ORACLE_SQL, E, L, query, rounded
from .session import checkpoints
from .sources import readers, writers

#: A cascade of two layers over the models that the binding has.
CONFIG = {"layers_count": 2, "layers": [{"layer_idx": 0, "samples": {"m0": [0, 1], "m1": [0]}, "alpha": 0.5, "beta": 0.5, "threshold": 0.5}, {"layer_idx": 1, "samples": {"m2": [2]}, "alpha": 0.5, "beta": 0.5, "threshold": 0.5}]}
#: SQL: one row per (question, model), numbered among the model's samples of the question.
RUNS = f"""SELECT qid, model, CASE WHEN qid % 2 = 0 THEN 'easy' ELSE 'hard' END AS difficulty, ROW_NUMBER() OVER (PARTITION BY qid, model ORDER BY pos) - 1 AS round_id, ckey AS code, CASE WHEN pos % 4 = 3 THEN NULL ELSE logprob END AS logprob, is_passed_public, passed, score FROM ({L}) b"""


def folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoints(spark)}/{name}-{uuid4().hex}"


def saved_rounds(spark: SparkSession, sf_dir: str, wanted: readers.Wanted | None = None) -> DataFrame:
    """The binding's samples, written as rounds, of which the wanted ones are read again. A sample has a trace of two steps, or of
    one where its key ends with O."""
    step = lambda code, logprob: F.struct(code.alias("code"), F.lit(1).alias("prompt_tokens"), F.lit(2).alias("completion_tokens"), logprob.alias("logprob"), logprob.alias("norm_logprob"))
    one, two = F.array(step(F.col("code"), F.col("logprob"))), F.array(step(F.concat(F.lit("first "), "code"), F.lit(-9.0)), step(F.col("code"), F.col("logprob")))
    trace = F.when(F.endswith("code", F.lit("O")), one).otherwise(two)
    rows = bound(spark, sf_dir, RUNS).withColumn("question_id", F.col("qid").cast("string")).withColumn("debug_trace", trace)
    writers.write_rounds(rows, at := folder(spark, "rounds"))
    return readers.rounds(spark, at, wanted=wanted)


@query(f"SELECT qid::VARCHAR AS question_id, difficulty, model, round_id::INTEGER AS round_id, code, ROUND(COALESCE(logprob, CASE WHEN code LIKE '%O' THEN NULL ELSE -9 END), 6) AS logprob, is_passed_public, passed, ROUND(score, 6) AS score FROM ({RUNS})")
def rounds_written_and_read(spark, sf_dir):
    rows = readers.final_samples(saved_rounds(spark, sf_dir))
    return rows.select("question_id", "difficulty", "model", "round_id", "code", F.round("logprob", 6).alias("logprob"), "is_passed_public", "passed", F.round("score", 6).alias("score"))


@query(f"SELECT qid::VARCHAR AS qid, model, code, CASE round_id WHEN 2 THEN 0 ELSE 0 + (SELECT COUNT(*) FROM ({RUNS}) x WHERE x.qid = r.qid AND x.model = r.model AND x.round_id = 2) END::BIGINT AS pos FROM ({RUNS}) r WHERE round_id IN (2, 0)")
def model_samples_of_rounds(spark, sf_dir):
    return rounded(readers.model_samples(saved_rounds(spark, sf_dir, [(None, 2), (None, 0)]), [2, 0]).select("qid", "model", "code", "pos"))


@query(f"SELECT qid::VARCHAR AS qid, model, code, (ROW_NUMBER() OVER (PARTITION BY qid ORDER BY CASE model WHEN 'm1' THEN 0 ELSE 1 END) - 1)::BIGINT AS pos FROM ({RUNS}) WHERE (model = 'm1' AND round_id = 0) OR (model = 'm0' AND round_id = 1)")
def ensemble_samples_of_rounds(spark, sf_dir):
    return rounded(readers.ensemble_samples(saved_rounds(spark, sf_dir, [("m1", 0), ("m0", 1)]), ["m1", "m0"], [0, 1]).select("qid", "model", "code", "pos"))


@query(f"""WITH s AS (SELECT qid, model, difficulty, code, COUNT(*) AS n FROM ({RUNS}) r WHERE round_id < 3 GROUP BY ALL)
SELECT qid::VARCHAR AS problem_id, difficulty, model, 'equality' AS method, SUM(n)::BIGINT AS num_samples, COUNT(*) AS num_clusters, ROUND(-SUM(n / t * ln(n / t + 1e-10)), 6) + 0 AS DSE
FROM (SELECT *, SUM(n) OVER (PARTITION BY qid, model, difficulty) AS t FROM s) x GROUP BY qid, difficulty, model""")
def entropy_sweep_of_rounds(spark, sf_dir):
    """Every model and difficulty of the saved rounds, in one plan."""
    rows = entropy_sweep(saved_rounds(spark, sf_dir, [(None, k) for k in range(3)]), {"equality": {"key": ["code"]}}, [0, 1, 2])
    return rounded(rows.select("problem_id", "difficulty", "model", "method", "num_samples", "num_clusters", "DSE"))


def read_config(spark: SparkSession) -> dict:
    spark.createDataFrame([(json.dumps(CONFIG),)], "value string").coalesce(1).write.text(at := folder(spark, "config"))
    return readers.config(spark, at)


@query(f"""WITH s AS (SELECT *, CASE WHEN model = 'm2' THEN 1 ELSE 0 END AS layer, CASE WHEN model = 'm1' THEN 2 WHEN model = 'm2' THEN 0 ELSE round_id END AS k FROM ({RUNS}) WHERE (model = 'm0' AND round_id < 2) OR (model = 'm1' AND round_id = 0) OR (model = 'm2' AND round_id = 2))
SELECT qid::VARCHAR AS qid, layer::BIGINT AS layer, model || '/round_' || round_id AS source, (ROW_NUMBER() OVER (PARTITION BY qid, layer ORDER BY k) - 1)::BIGINT AS pos, ROUND(COALESCE(logprob, CASE WHEN code LIKE '%O' THEN 0 ELSE -9 END), 6) AS logprob FROM s""")
def layer_samples_of_rounds(spark, sf_dir):
    found = read_config(spark)
    return rounded(readers.layer_samples(saved_rounds(spark, sf_dir, readers.wanted_of(found)), found).select("qid", "layer", "source", "pos", "logprob"))


@query(f"""WITH s AS (SELECT *, CASE WHEN model = 'm1' THEN 2 ELSE round_id END AS k FROM ({RUNS}) WHERE (model = 'm0' AND round_id < 2) OR (model = 'm1' AND round_id = 0))
SELECT qid::VARCHAR AS qid, model || '/round_' || round_id AS source, (ROW_NUMBER() OVER (PARTITION BY qid ORDER BY k) - 1)::BIGINT AS pos, CASE WHEN code LIKE '%O' THEN code ELSE 'first ' || code END AS first_code, code AS last_code, passed AND code LIKE '%O' AS first_passed, passed AS last_passed FROM s""")
def baseline_samples_of_rounds(spark, sf_dir):
    found = read_config(spark)
    rows = readers.baseline_samples(saved_rounds(spark, sf_dir, readers.wanted_of(found, 1)), found)
    return rounded(rows.select("qid", "source", "pos", "first_code", "last_code", "first_passed", "last_passed"))


@query(f"""WITH b AS ({E}), f AS (SELECT qid, ckey, MIN(pos) AS f, COUNT(*) AS n FROM b GROUP BY qid, ckey), c AS (SELECT qid, SUM(n) AS t, COUNT(*) AS k FROM f GROUP BY qid)
SELECT f.qid::VARCHAR AS problem_id, 'd' || (f.qid % 3) AS difficulty, 'a+b c' AS model, 'equality' AS method, ANY_VALUE(c.t)::BIGINT AS num_samples, ANY_VALUE(c.k)::BIGINT AS num_clusters, ROUND(-SUM(n / t * ln(n / t + 1e-10)), 6) AS DSE FROM f JOIN c ON f.qid = c.qid GROUP BY f.qid""")
def results_written_and_read(spark, sf_dir):
    from .operators import clusters

    rows = entropy.question_rows(clusters.by_key(bound(spark, sf_dir, E), ["ckey"])).withColumn("difficulty", F.concat(F.lit("d"), (F.col("qid") % 3).cast("string")))
    rows = rows.withColumnsRenamed({"qid": "problem_id"}).withColumns({"problem_id": F.col("problem_id").cast("string"), "model": F.lit("a+b c"), "method": F.lit("equality")})
    writers.write_results(rows, at := folder(spark, "results"), {"models": ["a+b c"]})
    return rounded(readers.results(spark, at).select("problem_id", "difficulty", "model", "method", "num_samples", "num_clusters", "DSE"))


@query(f"""WITH b AS ({E}), f AS (SELECT qid, list(ckey ORDER BY pos) AS l FROM b GROUP BY qid)
SELECT qid::VARCHAR AS task_id, qid % 2 = 0 AS is_stdin, CASE WHEN qid % 3 = 0 THEN ['later'] ELSE l END AS inputs FROM f""")
def cache_written_and_read(spark, sf_dir):
    """Every third list has a second line, in the file that is written later; that line counts."""
    test = lambda text: F.struct(text.alias("input"), F.lit("").alias("output"), F.lit("stdin").alias("testtype"))
    rows = bound(spark, sf_dir, E).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("pos", "ckey"))).alias("g"))
    rows = rows.select(F.col("qid").cast("string").alias("task_id"), (F.col("qid") % 2 == 0).alias("is_stdin"), "qid", F.transform("g.ckey", test).alias("generated_tests"))
    at = folder(spark, "cache")
    writers.write_cache(spark, rows.drop("qid"), f"{at}/0")
    writers.write_cache(spark, rows.filter("qid % 3 = 0").select("task_id", "is_stdin", F.array(test(F.lit("later"))).alias("generated_tests")), f"{at}/1")
    return readers.test_cache(spark, f"{at}/*").select("task_id", "is_stdin", F.col("generated_tests.input").alias("inputs"))


@query(ORACLE_SQL["cache_upsert"])
def cache_appended_and_read(spark, sf_dir):
    """Tests of even samples, then those of others and of every third, which are added to a cache in parts; the second twice."""
    test = F.struct("pos", F.struct(F.col("ckey").alias("input"), F.lit("").alias("output"), F.lit("stdin").alias("testtype")).alias("t"))
    rows, at = bound(spark, sf_dir, E), folder(spark, "parts")
    for which in ("pos % 2 = 0", "pos % 2 = 1 OR pos % 3 = 0", "pos % 2 = 1 OR pos % 3 = 0"):
        lists = rows.filter(which).groupBy(F.col("qid").cast("string").alias("task_id"), F.lit(True).alias("is_stdin")).agg(F.sort_array(F.collect_list(test)).alias("g"))
        writers.append_tests(spark, lists.select("task_id", "is_stdin", F.col("g.t").alias("generated_tests")), at)
    return readers.test_cache(spark, at).select("task_id", F.col("generated_tests.input").alias("inputs"))


@query("SELECT c_custkey::VARCHAR AS task_id, 'later ' || c_name AS prompt, c_custkey % 2 = 0 AS is_stdin FROM customer")
def questions_written_and_read(spark, sf_dir):
    """One JSON array that holds each question twice; the later one counts."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    one = lambda first: F.struct(F.lit(first).alias("k"), F.struct(F.col("c_custkey").cast("string").alias("task_id"), F.concat(F.lit("" if first else "later "), "c_name").alias("prompt"), (F.col("c_custkey") % 2 == 0).alias("is_stdin")).alias("q"))
    both = rows.select(F.explode(F.array(one(True), one(False))).alias("x")).select(F.when(F.col("x.k"), 0).otherwise(1).alias("k"), "x.q")
    array = both.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("k", "q"))), lambda x: x["q"])).alias("value"))
    array.write.text(at := folder(spark, "questions"))
    return readers.questions(spark, at)


@query("""SELECT p_partkey::VARCHAR AS task_id, p_name AS prompt, p_partkey % 2 = 0 AS is_stdin, 1::BIGINT AS public, CASE WHEN p_partkey % 3 = 2 THEN 0 ELSE 2 END::BIGINT AS private, CASE WHEN p_partkey % 3 <> 2 THEN '7' END AS input
FROM part WHERE p_size >= 10""")
def problems_written_and_read(spark, sf_dir):
    """Private tests as packed text, as plain JSON, and undecodable; an earlier line of each problem doesn't count."""
    test = lambda kind: json.dumps([{"input": "7", "output": "8", "testtype": kind}])
    packed = base64.b64encode(zlib.compress(json.dumps(json.dumps(2 * json.loads(test("stdin")))).encode())).decode()
    key = F.col("p_partkey")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        key.cast("string").alias("question_id"), F.col("p_name").alias("question_content"), F.lit("").alias("starter_code"), F.when(F.col("p_size") < 10, "easy").otherwise("hard").alias("difficulty"),
        F.lit("2024-01-01T00:00:00").alias("contest_date"), F.when(key % 2 == 0, test("stdin")).otherwise(test("functional")).alias("public_test_cases"),
        F.when(key % 3 == 0, packed).when(key % 3 == 1, json.dumps(2 * json.loads(test("stdin")))).otherwise("gASV").alias("private_test_cases"),
    )
    at = folder(spark, "problems")
    rows.withColumn("question_content", F.lit("earlier")).write.json(f"{at}/0")
    rows.write.json(f"{at}/1")
    found = readers.examples(readers.problems(spark, f"{at}/*", "hard", "2024-01-01", "2024-01-01", last=True))
    return rounded(found.select("task_id", "prompt", "is_stdin", F.size("public_tests").cast("long").alias("public"), F.size("test").cast("long").alias("private"), F.get("test", F.lit(0))["input"].alias("input")))


@query("SELECT event_id, 'no json ' || event_id AS _corrupt_record FROM events WHERE event_id % 7 = 0")
def rejected_lines(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("no json "), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct(F.col("event_id").cast("string").alias("question_id"))))
    rows.select(line.alias("value")).write.text(at := folder(spark, "lines"))
    out = writers.rejected(spark, at, readers.ROUND)
    return out.select(F.regexp_extract("_corrupt_record", r"(\d+)", 1).cast("long").alias("event_id"), "_corrupt_record")


#: SQL: the samples of both layers of questions that have metadata; a, each layer's decision; fin, the first layer that stops; pick, its answer.
CASCADE = f"""s AS (SELECT *, CASE WHEN model = 'm2' THEN 1 ELSE 0 END AS layer, CASE WHEN model = 'm1' THEN 2 WHEN model = 'm2' THEN 0 ELSE round_id END AS k FROM ({RUNS}) WHERE (model = 'm0' AND round_id < 2) OR (model = 'm1' AND round_id = 0) OR (model = 'm2' AND round_id = 2)),
p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid, layer ORDER BY k) - 1 AS pos FROM s WHERE qid % 5 <> 0),
n AS (SELECT qid, layer, COUNT(*) AS total, COUNT(*) FILTER (WHERE is_passed_public) AS pp FROM p GROUP BY qid, layer),
g AS (SELECT qid, layer, code, COUNT(*) AS size, COUNT(DISTINCT model) AS models, MIN(pos) AS first FROM p WHERE is_passed_public GROUP BY qid, layer, code),
t AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid, layer ORDER BY size DESC, first) AS r FROM g) WHERE r = 1),
a AS (SELECT q.qid, l.layer, COALESCE(n.total, 0) AS total, COALESCE(n.pp, 0) AS pp, t.first, COALESCE(n.pp, 0) > 0 AND (l.layer = 1 OR (t.size > 0.3 * n.total AND t.size > 0.6 * n.pp AND t.models > 1)) AS stop
  FROM (SELECT DISTINCT qid FROM p) q CROSS JOIN (SELECT unnest([0, 1]) AS layer) l LEFT JOIN n ON n.qid = q.qid AND n.layer = l.layer LEFT JOIN t ON t.qid = q.qid AND t.layer = l.layer),
fin AS (SELECT qid, COALESCE(MIN(CASE WHEN stop THEN layer END), -1) AS final_layer FROM a GROUP BY qid),
pick AS (SELECT fin.qid, fin.final_layer, p.score, p.passed, p.model || '/' || p.pos AS source FROM fin LEFT JOIN a ON a.qid = fin.qid AND a.layer = fin.final_layer LEFT JOIN p ON p.qid = fin.qid AND p.layer = fin.final_layer AND p.pos = a.first)"""


def swept_cascade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A cascade over saved rounds; every fifth question has no metadata."""
    found = read_config(spark)
    rows = saved_rounds(spark, sf_dir, readers.wanted_of(found))
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").cast("string").alias("task_id"), F.lit("").alias("prompt"), F.lit(True).alias("is_stdin"))
    return cascade_sweep(rows, found, "equality", keys, seed=None, key=["code"])


@query(f"""WITH {CASCADE}, every AS (SELECT DISTINCT qid FROM s)
SELECT e.qid::VARCHAR AS qid, COALESCE(k.final_layer, -1)::BIGINT AS final_layer, ROUND(COALESCE(k.score, 0), 6) + 0 AS final_score, COALESCE(k.passed, FALSE) AS final_passed, COALESCE(k.source, '') AS source,
  CASE WHEN e.qid % 5 = 0 THEN 'the question has no metadata' END AS error, CASE WHEN k.qid IS NULL THEN 0 WHEN k.final_layer = 0 THEN 1 ELSE 2 END::BIGINT AS num_layers FROM every e LEFT JOIN pick k ON k.qid = e.qid""")
def cascade_of_rounds(spark, sf_dir):
    """Every question of the rounds has a row; those with a fault say which."""
    out = writers.full_rows(swept_cascade(spark, sf_dir)[0])
    return rounded(out.select("qid", "final_layer", "final_score", "final_passed", "source", "error", F.size("layer_details").cast("long").alias("num_layers")))


@query(f"""WITH {CASCADE}, shown AS (SELECT a.* FROM a JOIN fin ON fin.qid = a.qid WHERE fin.final_layer < 0 OR a.layer <= fin.final_layer),
ids AS (SELECT p.qid, p.layer, list(c.id ORDER BY p.pos) AS ids, list(p.passed ORDER BY p.pos) AS oks FROM p JOIN (SELECT qid, layer, code, DENSE_RANK() OVER (PARTITION BY qid, layer ORDER BY first) - 1 AS id FROM g) c ON c.qid = p.qid AND c.layer = p.layer AND c.code = p.code WHERE p.is_passed_public GROUP BY p.qid, p.layer)
SELECT shown.qid::VARCHAR AS qid, shown.layer::BIGINT AS layer, shown.pp AS passed_public, stop, ids.ids AS cluster_ids, ids.oks AS passed FROM shown LEFT JOIN ids ON ids.qid = shown.qid AND ids.layer = shown.layer""")
def cascade_report_of_rounds(spark, sf_dir):
    """The layers of the report, one row each."""
    rows = writers.cascade_rows(*swept_cascade(spark, sf_dir)).select("qid", F.explode("layers").alias("l"))
    return rounded(rows.select("qid", F.col("l.layer_idx").alias("layer"), F.col("l.passed_public").alias("passed_public"), "l.stop", F.col("l.cluster_ids").cast("array<bigint>").alias("cluster_ids"), "l.passed"))


@query(f"""WITH b AS (SELECT * FROM ({RUNS}) WHERE (model = 'm0' AND round_id < 2) OR (model = 'm1' AND round_id = 0)), e AS (SELECT DISTINCT qid FROM b),
r AS (SELECT qid, BOOL_OR(passed) AS passed, AVG(score) AS score, COUNT(*) AS n FROM b WHERE qid % 5 <> 0 GROUP BY qid),
o AS (SELECT qid, BOOL_OR(passed AND code LIKE '%O') AS passed, AVG(score) AS score, COUNT(*) AS n FROM b WHERE qid % 5 <> 0 GROUP BY qid)
SELECT e.qid::VARCHAR AS qid, m.method, COALESCE(CASE m.method WHEN 'pass_at_n' THEN r.passed ELSE o.passed END, FALSE) AS passed, ROUND(COALESCE(r.score, 0), 6) + 0 AS score, r.n AS num_samples,
  CASE WHEN e.qid % 5 = 0 THEN 'the question has no metadata' END AS error FROM e CROSS JOIN (SELECT unnest(['pass_at_n', 'pass_at_n_oneshot']) AS method) m LEFT JOIN r ON r.qid = e.qid LEFT JOIN o ON o.qid = e.qid""")
def baselines_of_rounds(spark, sf_dir):
    found = read_config(spark)
    rows = saved_rounds(spark, sf_dir, readers.wanted_of(found, 1))
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").cast("string").alias("task_id"), F.lit("").alias("prompt"), F.lit(True).alias("is_stdin"))
    out = baseline_sweep(rows, found, ["pass_at_n", "pass_at_n_oneshot"], metadata=keys)
    return rounded(out.select("qid", "method", "passed", "score", "num_samples", "error"))
