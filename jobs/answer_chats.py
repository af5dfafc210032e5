"""Chooses an answer to every question from the chats about it, and says which questions need a second look.

    python -m jobs.answer_chats CHATS OUTPUT [--config FILE]

CHATS is a table of turns (Parquet). A chat is one sample of its question: its last kept turn is the answer, of which
the longest fenced block counts, or all of it where none is fenced. Answers of a question whose n-gram precision is
above the threshold belong together; the first sample of the largest cluster is the answer. Questions with an
entropy above `review_above` go to review, and for those the prompts are written that ask a language model whether the
chosen answer and the first one of each other cluster entail each other, under the keys of the cache of responses.

OUTPUT/answers/review=<b>/bucket=<k>/ has one row per question, OUTPUT/requests/bucket=<k>/ one per prompt. Both are
written anew from all chats, so a run can be repeated. A chat without a kept turn is no sample; of several rows of one
step the greatest text counts; rows without a question or a sample are left out. A question needs as many chats as one
task holds pairs of: give `question` as an expression that groups a bounded number of them.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumkit.functions.text import code_block, prompt_key
from quorumkit.operators.clusters import components
from quorumkit.operators.entropy import discrete_entropy
from quorumkit.operators.selection import major_voting
from quorumkit.operators.similarity import above, ngram_precision_pairs, verdict_prompt

from .common import config_of, parser, session

log = logging.getLogger("answer_chats")

#: SQL for question, sample, step and text of a turn, and for which turns are kept; words of an n-gram; what joins answers;
#: what is reviewed; buckets of the output.
SETTINGS = {
    "question": "conv_id DIV 8", "sample": "conv_id", "step": "turn", "keep": "role = 'assistant'", "text": "text",
    "words": 1, "threshold": 0.15, "review_above": 1.0, "buckets": 8,
}


def answers(turns: DataFrame, config: dict) -> DataFrame:
    """(qid, pos, code, steps): the answer of each chat, and the number of its kept turns."""
    rows = turns.filter(F.expr(config["keep"])).select(F.expr(config["question"]).alias("qid"), *[F.expr(config[c]).alias(n) for c, n in (("sample", "pos"), ("step", "step"), ("text", "text"))])
    rows = rows.filter("qid IS NOT NULL AND pos IS NOT NULL")
    last = rows.groupBy("qid", "pos").agg(F.max(F.struct("step", "text")).alias("last"), F.count(F.lit(1)).alias("steps"))
    return last.select("qid", "pos", code_block(F.coalesce("last.text", F.lit(""))).alias("code"), "steps")


def clustered(samples: DataFrame, config: dict) -> DataFrame:
    links = above(ngram_precision_pairs(samples, "code", config["words"]), config["threshold"])
    return components(samples, links, whole=True)


def chosen(found: DataFrame, config: dict) -> DataFrame:
    """One row per question: its answer, what it was chosen from, and whether it is to be reviewed."""
    voters = found.withColumns({"first_passed": F.lit(None).cast("boolean"), "source": F.struct("pos", "code", "steps", "cluster")})
    votes = major_voting(voters, seed=None).select("qid", F.col("source.pos").alias("sample"), F.col("source.code").alias("answer"), F.col("source.steps").alias("steps"), F.col("source.cluster").alias("cluster"), F.col("largest_cluster_size").alias("votes"))
    out = votes.join(discrete_entropy(found), "qid").withColumn("review", F.col("DSE") > config["review_above"])
    return out.withColumn("bucket", F.pmod(F.xxhash64("qid"), F.lit(config["buckets"])).cast("int"))


def requests(found: DataFrame, picked: DataFrame) -> DataFrame:
    """(qid, cluster, direction, key, prompt, bucket): what to ask about each other cluster of the questions under review, both ways."""
    firsts = found.groupBy("qid", "cluster").agg(F.min_by("code", "pos").alias("other"))
    asked = picked.filter("review").select("qid", "bucket", "answer", F.col("cluster").alias("own"))
    met = firsts.join(asked, "qid").filter("cluster <> own")
    name = F.col("qid").cast("string")
    both = F.array(*[F.struct(F.lit(d).alias("direction"), verdict_prompt(name, F.col(a), F.col(b)).alias("prompt")) for d, a, b in (("forth", "answer", "other"), ("back", "other", "answer"))])
    rows = met.select("qid", "cluster", "bucket", F.explode(both).alias("p")).select("qid", "cluster", "p.*", "bucket")
    return rows.withColumn("key", prompt_key(F.col("prompt")))


def stored(df: DataFrame, path: str, *names: str) -> DataFrame:
    """df, written in place of what was there, in folders by the columns named, and read again."""
    out = df.repartition(*names) if names else df
    out.write.mode("overwrite").partitionBy(*names).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run(spark: SparkSession, chats: str, output: str, config: dict | None = None) -> DataFrame:
    """Writes answers and requests, and returns the answers as written; config: as in SETTINGS."""
    config = SETTINGS | (config or {})
    turns = spark.read.parquet(chats)
    log.info("read %d turns from %s", turns.count(), chats)
    samples = stored(answers(turns, config), f"{output}/samples")
    found = stored(clustered(samples, config), f"{output}/clusters")
    picked = stored(chosen(found, config), f"{output}/answers", "review", "bucket")
    asked = stored(requests(found, picked), f"{output}/requests", "bucket")
    log.info("wrote %d answers to %s/answers and %d prompts to %s/requests", picked.count(), output, asked.count(), output)
    return picked


def main(arguments: list[str] | None = None) -> None:
    asked = parser(__doc__, "chats", "output").parse_args(arguments)
    spark = session("answer_chats")
    try:
        run(spark, asked.chats, asked.output, config_of(spark, asked.config, SETTINGS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
