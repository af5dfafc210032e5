"""The queries op1 to op12 over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table
from .exact_dedup import exact_groups
from .hypervectors import identify_languages
from .line_dedup import dedup_lines
from .maxscore import top_k
from .mixing import mix_report
from .pii import pseudonymize
from .periodic import collapse_runs
from .piece_codec import encode_decode
from .quality_lm import classify
from .sharding import shard_rows
from .simhash import near_groups
from .toxicity import score_toxicity


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed_spans", lambda s: F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string"))), ",")
    return out.select("doc_id", "n_lines", "removed_lines", spans.alias("removed_spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op2_topk_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op3_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    """The public vocabulary file, where it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    ids = F.sha2(F.array_join("ids", ","), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


def op5_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A fixed key for reports and tests; a corpus gets a secret one of its own.
DEMO_KEY = b"a key for reports, not a secret!"


def op6_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymize(table(spark, sf_dir, "documents"), DEMO_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct("spans.kind")), ",")
    return out.select("doc_id", F.size("spans").cast("long").alias("n_replaced"), kinds.alias("kinds"), F.sha2("text", 256).alias("text_sha256"), "spans", "text")


def op7_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op9_shard_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op11_language_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents of which about a tenth repeat some of their words to the end, so that there are runs.

    With h = crc32(doc_id), g = floor(h / 10) and n words: where h % 10 = 0, word i >= a is word a + (i - a) % p, with a = g % n
    and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split("text", WORD.replace("^", "")), lambda w: w != "")
    words = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, split).alias("words"))
    cut = words.withColumn("a", F.when(F.size("words") > 0, F.col("g") % F.size("words")))
    cut = cut.withColumn("p", 1 + F.floor((F.size("words") - F.col("a")) / (3 + F.col("g") % 8)))
    places = F.sequence(F.lit(0).cast("long"), F.size("words") - F.col("a") - 1)
    tail = F.transform(places, lambda i: F.get("words", (F.col("a") + i % F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collapse_runs(looped(table(spark, sf_dir, "documents")))
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]  # noqa: E731  runs are in order: of equal ones the first stays
    best = F.aggregate("runs", F.get("runs", 0), lambda b, r: F.when(more(r, b), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    digests = [F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256")]
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), *digests)
    milli = F.expr("(1000 * b.length) div b.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", milli, "runs_sha256", "collapsed_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline, which lies beside the package."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_topk_maxscore": op2_topk_maxscore,
    "op3_toxicity_trees": op3_toxicity_trees,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_lm": op5_quality_lm,
    "op6_pii_feistel": op6_pii_feistel,
    "op7_simhash_pivots": op7_simhash_pivots,
    "op8_mix_sources": op8_mix_sources,
    "op9_shard_jump": op9_shard_jump,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_language_vectors": op11_language_vectors,
    "op12_periodic_runs": op12_periodic_runs,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls, text IS NULL AS none FROM documents),
l AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS p, unnest(ls) AS line FROM cut),
w AS (SELECT doc_id, p AS p0, lead(p, 1) OVER o AS p1, lead(p, 2) OVER o AS p2,
        sha256(trim(line)) || sha256(trim(lead(line, 1) OVER o)) || sha256(trim(lead(line, 2) OVER o)) AS h
      FROM l WHERE trim(line) <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, p0) AS n FROM w WHERE h IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest([p0, p1, p2]) AS p FROM r WHERE n > 1)),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.p) AS t FROM l ANTI JOIN gone USING (doc_id, p) GROUP BY l.doc_id),
isle AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM gone),
span AS (SELECT doc_id, min(p) AS a, max(p) AS b, count(*) AS n FROM isle GROUP BY doc_id, k),
spans AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS s, sum(n) AS n FROM span GROUP BY doc_id)
SELECT c.doc_id, CASE WHEN none THEN 0 ELSE len(ls) END::BIGINT AS n_lines, coalesce(s.n, 0)::BIGINT AS removed_lines,
  coalesce(s.s, '') AS removed_spans, sha256(coalesce(k.t, '')) AS text_sha256
FROM cut c LEFT JOIN spans s USING (doc_id) LEFT JOIN kept k USING (doc_id)""",
    "op2_topk_maxscore": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
