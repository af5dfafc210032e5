"""Views that give general tables the shapes of saved samples; the SQL runs in Spark and DuckDB alike.

Ids are renamed below the window that numbers samples, so that what follows reuses its partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A question is a user, a sample an event.
EVENTS = """
SELECT qid, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY ts, event_id) - 1 AS pos, event_type AS ckey,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE -value / CAST(100 AS DOUBLE) END AS logprob,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE -value / CAST(1000 AS DOUBLE) END AS norm_logprob,
  CASE WHEN event_id % 3 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(FLOOR(value / 25) AS DOUBLE) / 10 END AS score
FROM (SELECT user_id AS qid, ts, event_id, event_type, value FROM events) e"""

#: A question is an order, a sample a line; with a model, verdicts, a score and a layer.
LINEITEM = """
SELECT s.*, CASE WHEN pos < 3 THEN 0 WHEN pos < 6 THEN 1 ELSE 2 END AS layer FROM (
  SELECT qid,
    ROW_NUMBER() OVER (PARTITION BY qid ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
      l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS pos,
    l_linestatus AS ckey2, CONCAT(l_returnflag, l_linestatus) AS ckey, CONCAT('m', CAST(l_suppkey % 3 AS VARCHAR(9))) AS model,
    l_discount <= CAST(0.05 AS DOUBLE) AS is_passed_public, l_quantity >= 40 AS passed,
    CASE WHEN l_quantity >= 40 THEN CAST(1 AS DOUBLE) ELSE CAST(FLOOR(l_quantity / 5) AS DOUBLE) / 10 END AS score,
    -l_extendedprice / CAST(10000 AS DOUBLE) AS logprob, l_partkey, l_linenumber AS line
  FROM (SELECT l_orderkey AS qid, * FROM lineitem) l) s"""

#: A question is ten consecutive vectors.
EMBED = "SELECT CAST(FLOOR(vec_id / 10) AS BIGINT) AS qid, vec_id % 10 AS pos, vec_id, embedding, label FROM embeddings"

#: A question is a conversation, a turn a step of its trace.
CONVERSATIONS = """
SELECT conv_id AS qid, turn AS step, text AS code,
  CASE WHEN turn % 3 = 2 THEN NULL ELSE -LENGTH(text) / CAST(100 AS DOUBLE) END AS logprob,
  CASE WHEN turn % 4 = 3 THEN NULL ELSE -LENGTH(text) / CAST(1000 AS DOUBLE) END AS norm_logprob
FROM conversations"""

#: A label and a score for evaluation.
DOCS = """
SELECT d.doc_id, d.lang AS difficulty, l.quality AS y, CAST(d.n_chars % 97 AS DOUBLE) AS entropy, CAST(l.toxic AS DOUBLE) AS score
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def bound(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A binding over the parquet tables of a folder, without registering views."""
    for name in ("events", "lineitem", "embeddings", "conversations", "documents", "labels"):
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {name}", f"{word} parquet.`{sf_dir}/{name}.parquet`")
    return spark.sql(sql)
