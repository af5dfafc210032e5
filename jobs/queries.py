"""The jobs as queries: each runs twice into one new folder and returns its whole output, as SQL says it."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumkit.operators.entropy import MEASURES
from quorumkit.session import checkpoints

from . import answer_chats, follow_entropies


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoints(spark)}/{name}-{uuid4().hex}"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 8) + F.lit(0.0) for c in names})


def job1_follow_entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job1")
    for _ in range(2):
        out = follow_entropies.run(spark, f"{sf_dir}/events.parquet", at, f"{at}/checkpoint")
    return _rounded(out.drop("bucket"), *MEASURES, "top_share")


def job2_answer_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job2")
    for _ in range(2):
        out = answer_chats.run(spark, f"{sf_dir}/conversations.parquet", at)
    prompts = spark.read.schema("qid long, key string").parquet(f"{at}/requests").groupBy("qid").agg(F.count(F.lit(1)).alias("requests"))
    out = _rounded(out.join(prompts, "qid", "left"), "DSE")
    return out.select("qid", "sample", F.sha2("answer", 256).alias("answer_sha256"), "steps", "votes", "DSE", "num_samples", "num_clusters", "review", F.coalesce("requests", F.lit(0)).alias("requests"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_follow_entropies": job1_follow_entropies, "job2_answer_chats": job2_answer_chats}

ORACLE_SQL: dict[str, str] = {
    "job1_follow_entropies": """
WITH c AS (SELECT user_id AS question, event_type AS answer, CASE WHEN event_id % 7 = 0 THEN NULL ELSE -value / 100.0::DOUBLE END AS lp FROM events WHERE user_id IS NOT NULL),
t AS (SELECT question, COUNT(*) AS n, COUNT(lp) AS m, SUM(lp) AS s, MAX(lp) AS mx FROM c GROUP BY question),
p AS (SELECT c.question, answer, COUNT(*) AS n, SUM(EXP(lp - mx)) AS z, SUM(EXP(lp - mx) * (lp - mx)) AS w FROM c JOIN t ON c.question = t.question GROUP BY c.question, answer),
q AS (SELECT question, SUM(z) AS z, SUM(w) AS w, arg_max(answer, (n, -rank)) AS top, MAX(n) AS top_n
      FROM (SELECT *, RANK() OVER (PARTITION BY question ORDER BY answer NULLS LAST) AS rank FROM p) GROUP BY question)
SELECT p.question, ROUND(MAX(-t.s / t.m), 8) + 0 AS PE_MC, ROUND(MAX(LN(q.z) - q.w / q.z), 8) + 0 AS PE_Rao,
  ROUND(SUM(CASE WHEN p.z > 0 THEN -(p.z / q.z) * LN(p.z / q.z) WHEN p.z = 0 THEN 0 END), 8) + 0 AS SE,
  ROUND(SUM(-(p.n / t.n::DOUBLE) * LN(p.n / t.n::DOUBLE + 1e-10)), 8) + 0 AS DSE, MAX(t.n) AS num_samples, COUNT(*) AS num_clusters,
  ANY_VALUE(q.top) AS top_answer, ROUND(MAX(q.top_n) / MAX(t.n)::DOUBLE, 8) + 0 AS top_share
FROM p JOIN t ON p.question = t.question JOIN q ON p.question = q.question GROUP BY p.question""",
    "job2_answer_chats": r"""
WITH RECURSIVE k AS (SELECT conv_id // 8 AS qid, conv_id AS pos, arg_max(text, (turn, text)) AS t, COUNT(*) AS steps FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL GROUP BY conv_id),
m AS (SELECT *, regexp_extract_all(t, '(?s)```python\s*\n(.*?)```', 1) AS p, regexp_extract_all(t, '(?s)```(?:.*?)\n(.*?)```', 1) AS g, regexp_extract_all(t, '(?s)<code>(.*?)</code>', 1) AS x FROM k),
l AS (SELECT *, CASE WHEN len(p) > 0 THEN p WHEN len(g) > 0 THEN g WHEN len(x) > 0 THEN x ELSE [t] END AS c FROM m),
b AS (SELECT qid, pos, steps, regexp_replace(list_reduce(c, lambda u, v: CASE WHEN length(v) > length(u) THEN v ELSE u END), '^\s+|\s+$', '', 'g') AS code FROM l),
w AS (SELECT qid, pos, list_filter(regexp_split_to_array(code, '\s+'), lambda u: u <> '') AS t FROM b),
gr AS (SELECT qid, pos, g, COUNT(*) AS c FROM (SELECT qid, pos, unnest(t) AS g FROM w) GROUP BY qid, pos, g),
z AS (SELECT qid, pos, SUM(c)::DOUBLE AS t FROM gr GROUP BY qid, pos),
s AS (SELECT x.qid, x.pos AS a, y.pos AS b, SUM(LEAST(x.c, y.c))::DOUBLE AS m FROM gr x JOIN gr y ON x.qid = y.qid AND x.g = y.g AND x.pos < y.pos GROUP BY x.qid, x.pos, y.pos),
near AS (SELECT s.qid, a, b FROM s JOIN z za ON za.qid = s.qid AND za.pos = a JOIN z zb ON zb.qid = s.qid AND zb.pos = b WHERE (m / za.t + m / zb.t) / 2 > 0.15),
e AS (SELECT qid, a, b FROM near UNION ALL SELECT qid, b, a FROM near),
reach AS (SELECT qid, pos, pos AS r FROM b UNION SELECT reach.qid, e.b, reach.r FROM reach JOIN e ON reach.qid = e.qid AND reach.pos = e.a),
c AS (SELECT qid, pos, MIN(r) AS root FROM reach GROUP BY qid, pos),
n AS (SELECT qid, root, COUNT(*) AS n FROM c GROUP BY qid, root),
h AS (SELECT qid, SUM(-(n / t) * LN(n / t + 1e-10)) AS DSE, MAX(t)::BIGINT AS num_samples, COUNT(*) AS num_clusters FROM (SELECT *, (SUM(n) OVER (PARTITION BY qid))::DOUBLE AS t FROM n) GROUP BY qid),
top AS (SELECT qid, root, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY n DESC, root) AS k FROM n) WHERE k = 1)
SELECT top.qid, top.root AS sample, sha256(b.code) AS answer_sha256, b.steps, top.n AS votes, ROUND(DSE, 8) + 0 AS DSE, num_samples, num_clusters, DSE > 1.0 AS review,
  CASE WHEN DSE > 1.0 THEN 2 * (num_clusters - 1) ELSE 0 END AS requests
FROM top JOIN b ON b.qid = top.qid AND b.pos = top.root JOIN h ON h.qid = top.qid""",
}
