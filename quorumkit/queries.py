"""Queries over the driver's tables, one or more for each operator, and the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import code as C
from .functions import generated as G
from .functions import text as T
from .operators import clusters, entropy, evaluate, functional, registry, selection, similarity, traces
from .plans import bindings
from .plans.bindings import bound
from .plans.runs import cascade_run, layer_clusters
from .session import ship
from .sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Alpha, beta and threshold of the layers that the bindings have.
CONFIG = [{"layer": k, "alpha": 0.5, "beta": 0.5, "threshold": 0.6} for k in range(3)]
E, L, V, K, D = bindings.EVENTS, bindings.LINEITEM, bindings.EMBED, bindings.CONVERSATIONS, bindings.DOCS


def query(oracle: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, zero without a sign, and whole numbers as long."""
    kinds = {"double": lambda c: (F.round(c, digits) + F.lit(0.0)), "int": lambda c: c.cast("long"), "smallint": lambda c: c.cast("long")}
    return df.select(*[kinds[t](F.col(f"`{c}`")).alias(c) if t in kinds else F.col(f"`{c}`") for c, t in df.dtypes])


# -- clusters by key, and entropies -----------------------------------------------------------------

#: SQL: the samples of a binding with clusters of equal keys.
def keyed(binding: str, key: str, group: str = "qid") -> str:
    return f"""b AS ({binding}), f AS (SELECT {group}, {key} AS k, MIN(pos) AS f FROM b GROUP BY {group}, {key}),
r AS (SELECT *, DENSE_RANK() OVER (PARTITION BY {group} ORDER BY f) - 1 AS cluster FROM f),
c AS (SELECT b.*, r.cluster FROM b JOIN r ON {' AND '.join(f'b.{g.strip()} = r.{g.strip()}' for g in group.split(','))} AND b.{key} = r.k)"""


#: SQL: entropies of c by group, from log probabilities lp.
def bundle(lp: str, group: str = "qid") -> str:
    on = " AND ".join(f"t.{g.strip()} = x.{g.strip()}" for g in group.split(","))
    return f"""t AS (SELECT {group}, COUNT(*) AS n, COUNT({lp}) AS m, SUM({lp}) AS s, MAX({lp}) AS mx FROM c GROUP BY {group}),
p AS (SELECT {', '.join('x.' + g.strip() for g in group.split(','))}, x.cluster, COUNT(*) AS n, SUM(EXP(x.{lp} - t.mx)) AS z, SUM(EXP(x.{lp} - t.mx) * (x.{lp} - t.mx)) AS w
      FROM c x JOIN t ON {on} GROUP BY {', '.join('x.' + g.strip() for g in group.split(','))}, x.cluster),
tz AS (SELECT {group}, SUM(z) AS z, SUM(w) AS w FROM p GROUP BY {group}),
e AS (SELECT {', '.join('x.' + g.strip() for g in group.split(','))}, MAX(-t.s / t.m) AS PE_MC, MAX(LN(tz.z) - tz.w / tz.z) AS PE_Rao,
        SUM(CASE WHEN x.z > 0 THEN -(x.z / tz.z) * LN(x.z / tz.z) WHEN x.z = 0 THEN 0 END) AS SE,
        SUM(-(x.n / t.n::DOUBLE) * LN(x.n / t.n::DOUBLE + 1e-10)) AS DSE, MAX(t.n) AS num_samples, COUNT(*) AS num_clusters
      FROM p x JOIN t ON {on} JOIN tz ON {on.replace('t.', 'tz.')} GROUP BY {', '.join('x.' + g.strip() for g in group.split(','))})"""


#: SQL: the measures. Means of numbers with a few decimals may end in a five at the seventh place, which sums in another
#: order round the other way; at these places none of the tables' means does.
MEASURES_SQL = ", ".join(f"ROUND({m}, 8) + 0 AS {m}" for m in ("PE_MC", "PE_Rao", "SE", "DSE"))


def event_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.by_key(bound(spark, sf_dir, E), ["ckey"])


def line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.by_key(bound(spark, sf_dir, L), ["ckey"])


@query(f"WITH {keyed(E, 'ckey')} SELECT qid, pos::BIGINT AS pos, cluster::BIGINT AS cluster FROM c")
def equality_clusters(spark, sf_dir):
    return rounded(event_clusters(spark, sf_dir).select("qid", "pos", "cluster"))


@query(f"WITH {keyed(E, 'ckey')}, {bundle('logprob')} SELECT qid, ROUND(DSE, 6) + 0 AS DSE, num_samples, num_clusters FROM e")
def dse_by_group(spark, sf_dir):
    return rounded(entropy.discrete_entropy(event_clusters(spark, sf_dir)))


@query(f"WITH {keyed(E, 'ckey')}, {bundle('logprob')} SELECT qid, {MEASURES_SQL}, num_samples, num_clusters FROM e")
def entropy_bundle(spark, sf_dir):
    return rounded(entropy.entropies(event_clusters(spark, sf_dir)), 8)


@query(f"WITH {keyed(E, 'ckey')}, {bundle('norm_logprob')} SELECT qid, {MEASURES_SQL.replace('8', '9')}, num_samples, num_clusters FROM e")
def entropy_norm_switch(spark, sf_dir):
    return rounded(entropy.entropies(event_clusters(spark, sf_dir), "norm_logprob"), 9)


@query(f"WITH {keyed(L, 'ckey')}, {bundle('logprob')} SELECT qid, ROUND(PE_MC, 10) + 0 AS PE_MC FROM e")
def pe_mc(spark, sf_dir):
    return rounded(entropy.entropies(line_clusters(spark, sf_dir)).select("qid", "PE_MC"), 10)


@query(f"WITH {keyed(L, 'ckey')}, {bundle('logprob')} SELECT qid, ROUND(PE_Rao, 6) + 0 AS PE_Rao FROM e")
def pe_rao(spark, sf_dir):
    return rounded(entropy.entropies(line_clusters(spark, sf_dir)).select("qid", "PE_Rao"))


@query(f"WITH {keyed(L, 'ckey')}, {bundle('logprob')} SELECT qid, ROUND(SE, 6) + 0 AS SE FROM e")
def se_soft(spark, sf_dir):
    return rounded(entropy.entropies(line_clusters(spark, sf_dir)).select("qid", "SE"))


@query(f"""WITH {keyed(E, 'ckey')}, {bundle('logprob')} SELECT e.qid, {MEASURES_SQL}, num_samples, num_clusters, ROUND(avg_score, 8) + 0 AS avg_score,
  scores, cluster_ids FROM e JOIN (SELECT qid, AVG(score) AS avg_score, LIST(ROUND(score, 6) ORDER BY pos) AS scores, LIST(cluster::INTEGER ORDER BY pos) AS cluster_ids FROM c GROUP BY qid) s ON e.qid = s.qid""")
def question_results(spark, sf_dir):
    return rounded(entropy.question_rows(event_clusters(spark, sf_dir)), 8).withColumn("scores", F.transform("scores", lambda x: F.round(x, 6))).withColumn("cluster_ids", F.col("cluster_ids").cast("array<int>"))


@query(f"""WITH {keyed(E, 'ckey')}, {bundle('logprob')}, s AS (SELECT qid, AVG(score) AS avg_score FROM c GROUP BY qid)
SELECT ROUND(AVG(PE_MC), 6) AS avg_PE_MC, ROUND(AVG(PE_Rao), 6) AS avg_PE_Rao, ROUND(AVG(SE), 6) AS avg_SE, ROUND(AVG(DSE), 6) AS avg_DSE,
  ROUND(AVG(num_clusters), 6) AS avg_num_clusters, ROUND(AVG(avg_score), 6) AS avg_score, COUNT(*) AS num_questions FROM e JOIN s ON e.qid = s.qid""")
def dataset_means(spark, sf_dir):
    return rounded(entropy.dataset_means(entropy.question_rows(event_clusters(spark, sf_dir))))


@query(f"WITH {keyed(E, 'ckey')} SELECT qid, COUNT(DISTINCT cluster) AS num_clusters FROM c GROUP BY qid")
def cluster_count(spark, sf_dir):
    return event_clusters(spark, sf_dir).groupBy("qid").agg(F.countDistinct("cluster").alias("num_clusters"))


#: SQL: the largest cluster of each question in c.
TOP = """g AS (SELECT qid, cluster, COUNT(*) AS size FROM c GROUP BY qid, cluster),
top AS (SELECT qid, cluster, size FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY size DESC, cluster) AS k FROM g) WHERE k = 1)"""


@query(f"WITH {keyed(E, 'ckey')}, {TOP} SELECT qid, cluster::BIGINT AS cluster, size FROM top")
def largest_cluster(spark, sf_dir):
    return rounded(clusters.largest(event_clusters(spark, sf_dir)))


SCORES = f"""WITH {keyed(L, 'ckey')}, {TOP}, s AS (SELECT c.qid, (MAX(score) = 1)::INTEGER AS pass_at_n,
    (MAX(CASE WHEN c.cluster = top.cluster THEN score END) = 1)::INTEGER AS pass_at_cluster, AVG(score) AS avg_score, MAX(score) AS max_score,
    AVG(CASE WHEN c.cluster = top.cluster THEN score END) AS cluster_avg_score, MAX(CASE WHEN c.cluster = top.cluster THEN score END) AS cluster_max_score
  FROM c JOIN top ON c.qid = top.qid GROUP BY c.qid)"""


@query(f"{SCORES} SELECT qid, pass_at_n::BIGINT AS pass_at_n FROM s")
def pass_at_n(spark, sf_dir):
    return rounded(evaluate.question_scores(line_clusters(spark, sf_dir)).select("qid", "pass_at_n"))


@query(f"{SCORES} SELECT qid, pass_at_cluster::BIGINT AS pass_at_cluster FROM s")
def pass_at_cluster(spark, sf_dir):
    return rounded(evaluate.question_scores(line_clusters(spark, sf_dir)).select("qid", "pass_at_cluster"))


@query(f"{SCORES} SELECT qid, ROUND(avg_score, 6) AS avg_score, ROUND(max_score, 6) AS max_score, ROUND(cluster_avg_score, 6) AS cluster_avg_score, ROUND(cluster_max_score, 6) AS cluster_max_score FROM s")
def score_metrics(spark, sf_dir):
    return rounded(evaluate.question_scores(line_clusters(spark, sf_dir)).drop("pass_at_n", "pass_at_cluster"))


# -- similarity and components ----------------------------------------------------------------------

COS = f"""b AS ({V}), s AS (SELECT x.qid, x.pos AS a, y.pos AS b, list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))
  / (sqrt(list_sum(list_transform(x.embedding, lambda v: v::DOUBLE * v::DOUBLE))) * sqrt(list_sum(list_transform(y.embedding, lambda v: v::DOUBLE * v::DOUBLE)))) AS similarity
  FROM b x JOIN b y ON x.qid = y.qid AND x.pos < y.pos)"""
LINKED = "WITH RECURSIVE " + COS + """, l AS (SELECT qid, a, b FROM s WHERE similarity > 0.1 UNION ALL SELECT qid, b, a FROM s WHERE similarity > 0.1),
reach AS (SELECT qid, pos, pos AS r FROM b UNION SELECT reach.qid, l.b, reach.r FROM reach JOIN l ON reach.qid = l.qid AND reach.pos = l.a),
m AS (SELECT qid, pos, MIN(r) AS root FROM reach GROUP BY qid, pos),
c AS (SELECT qid, pos, DENSE_RANK() OVER (PARTITION BY qid ORDER BY root) - 1 AS cluster FROM m)"""
NEAR = 0.1


def vector_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    samples = bound(spark, sf_dir, V)
    return samples, similarity.cosine_links(samples, "embedding", NEAR)


@query(f"WITH {COS} SELECT qid, a, b, ROUND(similarity, 6) + 0 AS similarity FROM s")
def cosine_pairs(spark, sf_dir):
    return rounded(similarity.cosine_pairs(bound(spark, sf_dir, V), "embedding"))


@query(f"""WITH {COS}, m AS (SELECT qid, a, b, similarity FROM s UNION ALL SELECT qid, b, a, similarity FROM s UNION ALL SELECT qid, pos, pos, 1 FROM b)
SELECT qid, a, list(ROUND(similarity, 6) + 0 ORDER BY b) AS row FROM m GROUP BY qid, a""")
def similarity_matrix(spark, sf_dir):
    samples = bound(spark, sf_dir, V)
    rows = rounded(similarity.matrix(similarity.cosine_pairs(samples, "embedding"), samples))
    return rows.groupBy("qid", "a").agg(F.sort_array(F.collect_list(F.struct("b", "similarity"))).alias("r")).select("qid", "a", F.col("r.similarity").alias("row"))


@query(LINKED + " SELECT qid, pos, cluster FROM c")
def dfs_components(spark, sf_dir):
    return rounded(clusters.components(*vector_links(spark, sf_dir)))


@query(LINKED + " SELECT qid, pos, cluster FROM c")
def dfs_components_by_labels(spark, sf_dir):
    return rounded(clusters.propagate(*vector_links(spark, sf_dir)))


@query(f"""WITH RECURSIVE {COS}, l AS (SELECT qid, a, b FROM s WHERE similarity > 0.1 UNION ALL SELECT qid, b, a FROM s WHERE similarity > 0.1),
near AS (SELECT b.qid, b.pos, COALESCE(list(l.b ORDER BY l.b) FILTER (WHERE l.b IS NOT NULL), []) AS others FROM b LEFT JOIN l ON b.qid = l.qid AND b.pos = l.a GROUP BY b.qid, b.pos),
scan AS (SELECT qid, pos, [pos] AS leaders FROM near WHERE pos = 0
  UNION ALL SELECT n.qid, n.pos, CASE WHEN list_has_any(scan.leaders, n.others) THEN scan.leaders ELSE list_append(scan.leaders, n.pos) END
  FROM scan JOIN near n ON n.qid = scan.qid AND n.pos = scan.pos + 1),
led AS (SELECT qid, arg_max(leaders, pos) AS leaders FROM scan GROUP BY qid)
SELECT n.qid, n.pos, list_position(led.leaders, CASE WHEN list_contains(led.leaders, n.pos) THEN n.pos
  ELSE list_max(list_filter(led.leaders, lambda k: k < n.pos AND list_contains(n.others, k))) END)::BIGINT - 1 AS cluster
FROM near n JOIN led ON n.qid = led.qid""")
def greedy_leader(spark, sf_dir):
    return rounded(clusters.leaders(*vector_links(spark, sf_dir)))


@query(LINKED + """, g AS (SELECT qid, cluster, COUNT(*) AS n FROM c GROUP BY qid, cluster)
SELECT qid, ROUND(SUM(-(n / t) * LN(n / t + 1e-10)), 6) + 0 AS DSE, MAX(t)::BIGINT AS num_samples, COUNT(*) AS num_clusters
FROM (SELECT *, (SUM(n) OVER (PARTITION BY qid))::DOUBLE AS t FROM g) GROUP BY qid""")
def embed_entropy(spark, sf_dir):
    return rounded(entropy.discrete_entropy(registry.cluster_samples(bound(spark, sf_dir, V), "embed", threshold=NEAR)))


GRAMS = f"""b AS ({K}), w AS (SELECT qid, step AS pos, list_filter(regexp_split_to_array(code, '\\s+'), lambda t: t <> '') AS t FROM b),
g AS (SELECT qid, pos, g, COUNT(*) AS c FROM (SELECT qid, pos, unnest(list_transform(range(1, len(t)::BIGINT), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM w) GROUP BY qid, pos, g),
z AS (SELECT qid, pos, SUM(c)::DOUBLE AS t FROM g GROUP BY qid, pos),
m AS (SELECT x.qid, x.pos AS a, y.pos AS b, SUM(LEAST(x.c, y.c))::DOUBLE AS m FROM g x JOIN g y ON x.qid = y.qid AND x.g = y.g AND x.pos < y.pos GROUP BY x.qid, x.pos, y.pos)"""


@query(f"""WITH {GRAMS} SELECT x.qid, x.step AS a, y.step AS b, ROUND((COALESCE(m.m / za.t, 0) + COALESCE(m.m / zb.t, 0)) / 2, 6) AS similarity
FROM b x JOIN b y ON x.qid = y.qid AND x.step < y.step LEFT JOIN m ON m.qid = x.qid AND m.a = x.step AND m.b = y.step
LEFT JOIN z za ON za.qid = x.qid AND za.pos = x.step LEFT JOIN z zb ON zb.qid = x.qid AND zb.pos = y.step""")
def bleu_ngram_pairs(spark, sf_dir):
    return rounded(similarity.ngram_precision_pairs(bound(spark, sf_dir, K), "code", 2, pos="step"))


#: SQL: programs as text: kind 0 doesn't parse, 1 calls itself, 2 has a loop. Of their syntax trees, counted by hand, kind 1 has
#: 8 inner nodes and 2 has 11, which share the import; kind 2 has data flows, kind 1 none.
PROGRAMS = """SELECT event_id, event_id // 8 AS qid, event_id % 8 AS pos, CASE WHEN event_id % 10 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 2 ELSE 1 END AS kind, CASE WHEN event_id % 10 = 0 THEN 'def broken('
  WHEN event_id % 3 = 1 THEN 'import math' || chr(10) || 'def f' || event_id || '(a, b):' || chr(10) || '    total = a + b' || chr(10) || '    for i in range(total):' || chr(10) || '        total = total - i' || chr(10) || '    return total' || chr(10)
  ELSE 'import math' || chr(10) || chr(10) || 'def f' || event_id || '(a, b=1):' || chr(10) || '    return f' || event_id || '(a - 1) if a else b' || chr(10) END AS code FROM events"""
KEYWORDS = "['def', 'import', 'return', 'if', 'else', 'for', 'in']"


def _bleu_sql(ref: str, cand: str, w: bool) -> str:
    """SQL: the n-gram match (or the weighted one) of cand's program against ref's, from matches m1 to m4 and totals."""
    m = [f"COALESCE({'mw' if w and n == 1 else f'm{n}'}, 0)" for n in range(1, 5)]
    t = [f"CASE WHEN COALESCE({c}, 0) = 0 THEN 1.0 ELSE {c} END" for c in ([f"{ref}.{'tw' if n == 1 else f't{n}'}" for n in range(1, 5)] if w else [f"{cand}.t{n}" for n in range(1, 5)])]
    logs = " + ".join(f"LN((CASE WHEN {a} > 0 THEN {a} ELSE 0.1 END) / {b})" for a, b in zip(m, t))
    return f"CASE WHEN {m[0]} > 0 THEN LEAST(1, EXP(1 - {ref}.t1 / {cand}.t1)) * EXP(({logs}) / 4) ELSE 0 END"


@query(f"""WITH b AS ({PROGRAMS}), w AS (SELECT qid, pos, kind, list_filter(regexp_split_to_array(code, '\\s+'), lambda t: t <> '') AS t FROM b),
g AS (SELECT qid, pos, n, g, COUNT(*)::DOUBLE AS c FROM (SELECT qid, pos, n, unnest(list_transform(range(1, len(t)::BIGINT - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))) AS g FROM w, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL),
x AS (SELECT *, CASE WHEN n > 1 THEN 0 WHEN list_contains({KEYWORDS}, g) THEN 1.0 ELSE 0.2 END AS w FROM g),
z AS (SELECT qid, pos, {", ".join(f"SUM(c) FILTER (WHERE n = {n}) AS t{n}" for n in range(1, 5))}, SUM(c * w) AS tw FROM x GROUP BY qid, pos),
m AS (SELECT p.qid, p.pos AS a, q.pos AS b, {", ".join(f"SUM(LEAST(p.c, q.c)) FILTER (WHERE p.n = {n}) AS m{n}" for n in range(1, 5))}, SUM(LEAST(p.c, q.c) * p.w) AS mw
  FROM x p JOIN x q ON p.qid = q.qid AND p.n = q.n AND p.g = q.g AND p.pos < q.pos GROUP BY p.qid, p.pos, q.pos),
k AS (SELECT x.qid, x.pos AS a, y.pos AS b, x.kind AS ka, y.kind AS kb FROM b x JOIN b y ON x.qid = y.qid AND x.pos < y.pos)
SELECT k.qid, k.a, k.b, ROUND(({_bleu_sql("za", "zb", False)} + {_bleu_sql("zb", "za", False)}) / 2, 6) + 0 AS ngram, ROUND(({_bleu_sql("za", "zb", True)} + {_bleu_sql("zb", "za", True)}) / 2, 6) + 0 AS weighted,
  ROUND(CASE WHEN ka = 0 OR kb = 0 THEN 0 WHEN ka = kb THEN 1 ELSE (1.0 / 8 + 1.0 / 11) / 2 END, 6) + 0 AS tree, CASE WHEN ka = 2 AND kb = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS flow
FROM k JOIN z za ON za.qid = k.qid AND za.pos = k.a JOIN z zb ON zb.qid = k.qid AND zb.pos = k.b LEFT JOIN m ON m.qid = k.qid AND m.a = k.a AND m.b = k.b""")
def code_bleu_pairs(spark, sf_dir):
    return rounded(similarity.code_bleu_parts(bound(spark, sf_dir, PROGRAMS.replace("chr(10)", "CHAR(10)").replace("//", "DIV")), "code"))


#: SQL: verdicts of both directions for pairs of lines, made from part keys.
VERDICTS = f"b AS ({L}), v AS (SELECT x.qid, x.pos AS a, y.pos AS b, (x.l_partkey + 2 * y.l_partkey) % 3 AS forth, (y.l_partkey + 2 * x.l_partkey + x.pos) % 3 AS back FROM b x JOIN b y ON x.qid = y.qid AND x.pos < y.pos)"


def verdict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = similarity.pairs(bound(spark, sf_dir, L), "l_partkey")
    return both.select("qid", "a", "b", ((F.col("x") + 2 * F.col("y")) % 3).alias("forth"), ((F.col("y") + 2 * F.col("x") + F.col("a")) % 3).alias("back"))


@query(f"""WITH {VERDICTS} SELECT qid, a::BIGINT AS a, b::BIGINT AS b, forth = 2 AND back = 2 AS strict, forth <> 0 AND back <> 0 AND NOT (forth = 1 AND back = 1) AS relaxed FROM v""")
def nli_strict_relaxed(spark, sf_dir):
    forth, back = F.col("forth"), F.col("back")
    return rounded(verdict_pairs(spark, sf_dir).select("qid", "a", "b", similarity.entails(forth, back).alias("strict"), similarity.entails(forth, back, False).alias("relaxed")))


@query("""WITH p AS (SELECT vec_id, [abs(embedding[1]::DOUBLE), abs(embedding[2]::DOUBLE), abs(embedding[3]::DOUBLE)] AS r FROM embeddings),
q AS (SELECT vec_id, r[1] / list_sum(r) AS c, r[2] / list_sum(r) AS n, r[3] / list_sum(r) AS e FROM p)
SELECT vec_id, CASE WHEN c >= n AND c >= e THEN 0 WHEN n >= e THEN 1 ELSE 2 END::BIGINT AS verdict, ROUND(e, 6) AS strict, ROUND(e / (e + c), 6) AS exclude_neutral, ROUND(e + n / 2, 6) AS half_neutral FROM q""")
def nli_scores(spark, sf_dir):
    raw = F.transform(F.slice("embedding", 1, 3), lambda x: F.abs(x.cast("double")))
    p = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", raw.alias("r"))
    p = p.select("vec_id", F.transform("r", lambda x: x / F.aggregate("r", F.lit(0.0), lambda a, b: a + b)).alias("p"))
    modes = [similarity.entailment_score(F.col("p"), m).alias(m) for m in ("strict", "exclude_neutral", "half_neutral")]
    return rounded(p.select("vec_id", similarity.verdict_of(F.col("p")).alias("verdict"), *modes))


RESPONSES = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Entailment.' WHEN 1 THEN 'NEUTRAL, not entailment' WHEN 2 THEN 'contradiction' WHEN 3 THEN 'It is clear to me that this is entailment'
  WHEN 4 THEN 'neutral or contradiction' ELSE props END AS response FROM events"""


@query(f"""WITH r AS ({RESPONSES}), h AS (SELECT event_id, left(lower(response), 30) AS h FROM r)
SELECT event_id, CASE WHEN contains(h, 'entailment') THEN 2 WHEN contains(h, 'neutral') THEN 1 WHEN contains(h, 'contradiction') THEN 0 ELSE 1 END::BIGINT AS verdict FROM h""")
def nli_response_parse(spark, sf_dir):
    return rounded(bound(spark, sf_dir, RESPONSES).select("event_id", similarity.parse_verdict(F.col("response")).alias("verdict")))


@query("""SELECT conv_id, turn, md5('We are evaluating answers to the question "' || conv_id || '"' || chr(10) || 'Here are two possible answers:' || chr(10) || 'Possible Answer 1: ' || text || chr(10)
  || 'Possible Answer 2: ' || role || chr(10) || 'Does Possible Answer 1 semantically entail Possible Answer 2? Respond only with entailment, contradiction, or neutral.' || chr(10) || 'Response:') AS key FROM conversations""")
def md5_prompt_key(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    prompt = similarity.verdict_prompt(F.col("conv_id").cast("string"), F.col("text"), F.col("role"))
    return rows.select("conv_id", "turn", T.prompt_key(prompt).alias("key"))


@query(f"""WITH RECURSIVE {VERDICTS}, d AS (SELECT qid, a, b FROM v WHERE forth = 2 UNION ALL SELECT qid, b, a FROM v WHERE back = 2),
nodes AS (SELECT qid, pos FROM b), reach AS (SELECT qid, pos AS r, pos FROM nodes UNION SELECT reach.qid, reach.r, d.b FROM reach JOIN d ON d.qid = reach.qid AND d.a = reach.pos),
sets AS (SELECT qid, r, list(pos) AS s FROM reach GROUP BY qid, r), n AS (SELECT qid, COUNT(*) AS n FROM nodes GROUP BY qid),
scan AS (SELECT n.qid, 0::BIGINT AS k, list_transform(range(n.n), lambda i: -1::BIGINT) AS roots FROM n
  UNION ALL SELECT scan.qid, scan.k + 1, CASE WHEN scan.roots[scan.k + 1] >= 0 THEN scan.roots
    ELSE list_transform(scan.roots, lambda x, i: CASE WHEN x < 0 AND list_contains(sets.s, i - 1) THEN scan.k ELSE x END) END
  FROM scan JOIN n ON n.qid = scan.qid AND scan.k < n.n JOIN sets ON sets.qid = scan.qid AND sets.r = scan.k),
done AS (SELECT scan.qid, scan.roots FROM scan JOIN n ON n.qid = scan.qid AND scan.k = n.n),
u AS (SELECT qid, unnest(range(len(roots))) AS pos, unnest(roots) AS root FROM done)
SELECT qid, pos::BIGINT AS pos, (DENSE_RANK() OVER (PARTITION BY qid ORDER BY root) - 1)::BIGINT AS cluster FROM u""")
def symbolic_directed_components(spark, sf_dir):
    v = verdict_pairs(spark, sf_dir)
    both = [F.struct(F.col(a).alias("a"), F.col(b).alias("b"), (F.col(c) == 2).alias("equivalent")) for a, b, c in (("a", "b", "forth"), ("b", "a", "back"))]
    verdicts = v.select("qid", F.inline(F.array(*both)))
    return rounded(registry.cluster_samples(bound(spark, sf_dir, L), "symbolic", verdicts=verdicts).select("qid", "pos", "cluster"))


# -- traces -----------------------------------------------------------------------------------------


def conversation_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.traces(bound(spark, sf_dir, K)).withColumn("passed", F.col("qid") % 3 == 0)


@query(f"""WITH b AS ({K}) SELECT qid, arg_max(code, step) AS code, ROUND(arg_max(logprob, step) FILTER (WHERE logprob IS NOT NULL), 6) AS logprob,
  ROUND(arg_max(norm_logprob, step) FILTER (WHERE norm_logprob IS NOT NULL), 6) AS norm_logprob, COUNT(*) AS trace_length FROM b GROUP BY qid""")
def trace_last_backfill(spark, sf_dir):
    return rounded(traces.final_samples(conversation_traces(spark, sf_dir)).select("qid", "code", "logprob", "norm_logprob", "trace_length"))


@query(f"""WITH b AS ({K}) SELECT qid, arg_min(code, step) AS first_code, arg_max(code, step) AS last_code, ROUND(COALESCE(arg_min(COALESCE(logprob, 0), step), 0), 6) + 0 AS first_logprob,
  qid % 3 = 0 AND COUNT(*) = 1 AS first_passed, qid % 3 = 0 AS last_passed, COUNT(*) AS debug_trace_length FROM b GROUP BY qid""")
def trace_first_last(spark, sf_dir):
    out = traces.first_last(conversation_traces(spark, sf_dir))
    return rounded(out.select("qid", "first_code", "last_code", "first_logprob", "first_passed", "last_passed", "debug_trace_length"))


@query("SELECT user_id AS qid, event_type AS g, ROUND(SUM(-value), 4) AS logprob, ROUND(AVG(-value), 6) AS norm_logprob, COUNT(*) AS completion_tokens FROM events GROUP BY user_id, event_type")
def token_logprob_sum(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("qid"), F.col("event_type").alias("g"), (-F.col("value")).alias("lp"))
    out = entropy.sequence_logprob(rows, ["qid", "g"], "lp")
    return out.select("qid", "g", F.round("logprob", 4).alias("logprob"), F.round("norm_logprob", 6).alias("norm_logprob"), "completion_tokens")


@query(f"""WITH b AS ({L}), n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid, model ORDER BY pos) AS k FROM b), f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid, model ORDER BY pos) AS j FROM n WHERE l_partkey % 4 <> 0)
SELECT qid, model, pos::BIGINT AS pos, k AS total_count FROM f WHERE j = 1""")
def first_matching_row(spark, sf_dir):
    rows = bound(spark, sf_dir, L).withColumn("debug_trace", F.when(F.col("l_partkey") % 4 == 0, F.array().cast("array<int>")).otherwise(F.array(F.col("line"))))
    return rounded(traces.first_rows(rows, ["qid", "model"], ["pos"]).select("qid", "model", "pos", "total_count"))


@query(f"WITH b AS ({L}) SELECT qid, layer::BIGINT AS layer, COUNT(*) AS total_count, COUNT(*) FILTER (WHERE is_passed_public) AS passed_public_count FROM b GROUP BY qid, layer")
def layer_counts(spark, sf_dir):
    return rounded(traces.layer_counts(bound(spark, sf_dir, L)))


@query(f"WITH b AS ({L}) SELECT qid, BOOL_AND(passed) AS passed, ROUND(AVG(passed::INTEGER), 6) AS score, COUNT(*) AS num_tests FROM b GROUP BY qid")
def test_verdict(spark, sf_dir):
    return rounded(traces.verdicts(bound(spark, sf_dir, L), order="pos"))


@query(f"""WITH b AS ({L}), f AS (SELECT *, MAX(CASE WHEN NOT is_passed_public THEN pos END) OVER (PARTITION BY qid) AS x FROM b)
SELECT qid, BOOL_AND(is_passed_public) AS passed, ROUND(AVG((x IS NULL OR pos > x)::INTEGER), 6) AS score, COUNT(*) AS num_tests FROM f GROUP BY qid""")
def test_verdict_fast_check(spark, sf_dir):
    return rounded(traces.verdicts(bound(spark, sf_dir, L), order="pos", passed="is_passed_public", fast=True))


@query(f"""WITH b AS ({L}) SELECT qid, pos::BIGINT AS test, CASE WHEN pos % 3 = 2 THEN FALSE ELSE passed END AS passed, CASE WHEN pos % 3 = 2 THEN 'Error: Time out!' ELSE 'm' || line END AS message,
  CASE WHEN pos % 3 = 2 THEN 'Infinity'::DOUBLE ELSE line::DOUBLE END AS seconds FROM b""")
def fill_missing_tests(spark, sf_dir):
    rows = bound(spark, sf_dir, L).withColumnRenamed("pos", "test")
    known = rows.filter("test % 3 <> 2").select("qid", "test", "passed", F.concat(F.lit("m"), F.col("line").cast("string")).alias("message"), F.col("line").cast("double").alias("seconds"))
    return traces.fill_tests(rows.select("qid", "test"), known).withColumn("test", F.col("test").cast("long"))


@query(f"WITH b AS ({L}) SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE is_passed_public) AS public, COUNT(*) FILTER (WHERE passed) AS private, ROUND(AVG(passed::INTEGER), 6) AS accuracy FROM b")
def running_counters(spark, sf_dir):
    return rounded(traces.running_counts(bound(spark, sf_dir, L)))


# -- evaluation -------------------------------------------------------------------------------------

CURVE = f"""b AS ({D}), x AS (SELECT y, entropy, unnest([difficulty, 'overall']) AS difficulty FROM b), k AS (SELECT difficulty, entropy, SUM(y)::BIGINT AS p, SUM(1 - y)::BIGINT AS n FROM x GROUP BY difficulty, entropy),
u AS (SELECT *, SUM(p) OVER w AS tp, SUM(n) OVER w AS fp, SUM(p) OVER (PARTITION BY difficulty) AS pp, SUM(n) OVER (PARTITION BY difficulty) AS nn FROM k WINDOW w AS (PARTITION BY difficulty ORDER BY entropy)),
r AS (SELECT difficulty, fp / nn AS fpr, tp / pp AS tpr FROM u WHERE pp > 0 AND nn > 0 UNION ALL SELECT DISTINCT difficulty, 0, 0 FROM u
  UNION ALL SELECT DISTINCT difficulty, 1, 1 FROM u WHERE pp = 0 OR nn = 0)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.with_overall(bound(spark, sf_dir, D))


@query(f"WITH {CURVE} SELECT difficulty, ROUND(fpr, 6) AS fpr, ROUND(tpr, 6) AS tpr FROM r")
def roc_points(spark, sf_dir):
    return rounded(evaluate.roc_points(labelled(spark, sf_dir), ["difficulty"]))


@query(f"""WITH b AS ({D}), k AS (SELECT difficulty, COUNT(*) AS num_samples FROM b GROUP BY difficulty),
a AS (SELECT p.difficulty, AVG(CASE WHEN p.entropy < n.entropy THEN 1 WHEN p.entropy = n.entropy THEN 0.5 ELSE 0 END) AS auroc FROM b p JOIN b n ON p.difficulty = n.difficulty AND p.y = 1 AND n.y = 0 GROUP BY p.difficulty)
SELECT k.difficulty, ROUND(COALESCE(auroc, 0)::DOUBLE, 6) AS auroc, num_samples FROM k LEFT JOIN a ON a.difficulty = k.difficulty""")
def auroc_by_group(spark, sf_dir):
    return rounded(evaluate.auroc(bound(spark, sf_dir, D), ["difficulty"]))


@query(f"""WITH b AS (SELECT y, entropy, unnest([difficulty, 'overall']) AS difficulty FROM ({D})), k AS (SELECT difficulty, COUNT(*) AS num_samples FROM b GROUP BY difficulty),
a AS (SELECT p.difficulty, AVG(CASE WHEN p.entropy < n.entropy THEN 1 WHEN p.entropy = n.entropy THEN 0.5 ELSE 0 END) AS auroc FROM b p JOIN b n ON p.difficulty = n.difficulty AND p.y = 1 AND n.y = 0 GROUP BY p.difficulty)
SELECT k.difficulty, ROUND(COALESCE(auroc, 0)::DOUBLE, 6) AS auroc, num_samples FROM k LEFT JOIN a ON a.difficulty = k.difficulty""")
def auroc_overall(spark, sf_dir):
    return rounded(evaluate.auroc(labelled(spark, sf_dir), ["difficulty"]))


def _at_sql(x: str, y: str, at: str, name: str) -> str:
    return f"""(SELECT ROUND(CASE WHEN h.x IS NULL THEN l.y ELSE l.y + (h.y - l.y) * ({at} - l.x) / (h.x - l.x) END, 6)
      FROM (SELECT {x} AS x, {y} AS y FROM r WHERE r.difficulty = d.difficulty AND {x} <= {at} ORDER BY 1 DESC, 2 DESC LIMIT 1) l
      LEFT JOIN (SELECT {x} AS x, {y} AS y FROM r WHERE r.difficulty = d.difficulty AND {x} > {at} ORDER BY 1, 2 DESC LIMIT 1) h ON TRUE) AS {name}"""


@query(f"WITH {CURVE} SELECT d.difficulty, {_at_sql('tpr', 'fpr', '0.8', 'fpr_at_80')}, {_at_sql('tpr', 'fpr', '0.9', 'fpr_at_90')} FROM (SELECT DISTINCT difficulty FROM r) d")
def fpr_at_tpr(spark, sf_dir):
    return rounded(evaluate.fpr_at_tpr(evaluate.roc_points(labelled(spark, sf_dir), ["difficulty"]), ["difficulty"]))


@query(f"WITH {CURVE} SELECT d.difficulty, {_at_sql('fpr', 'tpr', '0.05', 'tpr_at_5')}, {_at_sql('fpr', 'tpr', '0.1', 'tpr_at_10')} FROM (SELECT DISTINCT difficulty FROM r) d")
def tpr_at_fpr(spark, sf_dir):
    return rounded(evaluate.tpr_at_fpr(evaluate.roc_points(labelled(spark, sf_dir), ["difficulty"]), ["difficulty"]))


@query(f"WITH b AS ({D}) SELECT 'all' AS g, ROUND(corr(entropy, score), 6) AS correlation, COUNT(*) AS num_samples FROM b")
def pearson_corr(spark, sf_dir):
    return rounded(evaluate.pearson(bound(spark, sf_dir, D).withColumn("g", F.lit("all")), ["g"], "entropy", "score"))


@query(f"WITH b AS (SELECT entropy, score, unnest([difficulty, 'overall']) AS difficulty FROM ({D})) SELECT difficulty, ROUND(CASE WHEN COUNT(*) < 2 OR MIN(entropy) = MAX(entropy) OR MIN(score) = MAX(score) THEN 0 ELSE corr(entropy, score) END, 6) AS correlation, COUNT(*) AS num_samples FROM b GROUP BY difficulty")
def pearson_grouped(spark, sf_dir):
    return rounded(evaluate.pearson(labelled(spark, sf_dir), ["difficulty"], "entropy", "score"))


@query()
def pearson_p_value(spark, sf_dir):
    return rounded(evaluate.with_p_value(evaluate.pearson(labelled(spark, sf_dir), ["difficulty"], "entropy", "score")))


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.question_measures(line_clusters(spark, sf_dir))
    return rows.select("*", F.lit("all").alias("model"), F.lit("equality").alias("method"), F.concat(F.lit("d"), (F.col("qid") % 3).cast("string")).alias("difficulty"))


SCORED = SCORES.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {bundle('logprob')}, q AS (SELECT e.qid, e.PE_MC, e.PE_Rao, e.SE, e.DSE, s.* EXCLUDE (qid), 'd' || (e.qid % 3) AS d FROM e JOIN s ON e.qid = s.qid)"""


MEASURED = ("PE_MC", "PE_Rao", "SE", "DSE")


#: SQL: u, how many passed (p) and failed (n) at each entropy and how many passed or failed below it (tp, fp); a, the areas.
AREAS = f"""{SCORED}, ff AS (SELECT unnest([d, 'overall']) AS difficulty, pass_at_n, pass_at_cluster, PE_MC, PE_Rao, SE, DSE FROM q),
ll AS ({" UNION ALL ".join(f"SELECT difficulty, '{t}' AS metric, '{m}' AS entropy_type, {t} AS y, ROUND({m}, 9) AS entropy FROM ff" for t in ("pass_at_n", "pass_at_cluster") for m in MEASURED)}),
gg AS (SELECT difficulty, metric, entropy_type, entropy, SUM(y)::BIGINT AS p, SUM(1 - y)::BIGINT AS n FROM ll GROUP BY ALL),
u AS (SELECT *, SUM(p) OVER w - p AS tp, SUM(n) OVER w - n AS fp FROM gg WINDOW w AS (PARTITION BY difficulty, metric, entropy_type ORDER BY entropy)),
a AS (SELECT difficulty, metric, entropy_type, SUM(n * (tp + p / 2)) / (SUM(p) * SUM(n)) AS auroc, (SUM(p) + SUM(n))::BIGINT AS num_samples, SUM(p) AS ap, SUM(n) AS an FROM u GROUP BY ALL)"""
#: SQL: the correlations of all measures and scores.
CORRELATIONS = f"""{SCORED}, ff AS (SELECT unnest([d, 'overall']) AS difficulty, * EXCLUDE (d) FROM q),
cells AS ({" UNION ALL ".join(f"SELECT difficulty, '{s}' AS score_type, '{m}' AS entropy_type, corr({m}, {s}) AS correlation, COUNT(*) AS num_samples FROM ff GROUP BY difficulty" for s in ("avg_score", "max_score", "cluster_avg_score", "cluster_max_score") for m in MEASURED)})"""
#: The least area of a chart here: few curves of these tables reach the usual one.
SHOWN = 0.48


def rounded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_lines(spark, sf_dir).withColumns({m: F.round(m, 9) for m in MEASURED})


def _point_sql(x: str, y: str, at: str, name: str) -> str:
    """y where the curve through pts reaches x = at: from the last point up to there, of equal x the highest y, straight to the next."""
    low, high = f"arg_max({y}, {x} * 1e6 + {y}) FILTER (WHERE {x} <= {at})", f"arg_min({y}, {x} * 1e6 - {y}) FILTER (WHERE {x} > {at})"
    lx, hx = f"MAX({x}) FILTER (WHERE {x} <= {at})", f"MIN({x}) FILTER (WHERE {x} > {at})"
    return f"ROUND(CASE WHEN MAX(ap) = 0 OR MAX(an) = 0 THEN {at} WHEN {hx} IS NULL THEN {low} ELSE {low} + ({high} - {low}) * ({at} - {lx}) / ({hx} - {lx}) END, 5) + 0 AS {name}"


POINTS = ", ".join(_point_sql(*p) for p in (("y", "x", "0.8", "fpr_at_80"), ("y", "x", "0.9", "fpr_at_90"), ("x", "y", "0.05", "tpr_at_5"), ("x", "y", "0.1", "tpr_at_10")))
#: SQL: ev, the areas with their operating points.
EVALUATED = f"""{AREAS}, pts AS (SELECT difficulty, metric, entropy_type, (fp + n) / an AS x, (tp + p) / ap AS y, ap, an FROM u JOIN a USING (difficulty, metric, entropy_type) UNION ALL SELECT difficulty, metric, entropy_type, 0, 0, ap, an FROM a),
o AS (SELECT difficulty, metric, entropy_type, {POINTS} FROM pts GROUP BY difficulty, metric, entropy_type),
ev AS (SELECT o.*, ROUND(auroc, 5) AS auroc, num_samples FROM o JOIN a USING (difficulty, metric, entropy_type))"""


@query(f"{EVALUATED} SELECT * FROM ev")
def evaluation_grouped(spark, sf_dir):
    return rounded(evaluate.evaluate(rounded_lines(spark, sf_dir)).drop("model", "method"), 5)


@query(f"{CORRELATIONS} SELECT difficulty, score_type, entropy_type, ROUND(correlation, 5) AS correlation, num_samples FROM cells")
def correlation_grouped(spark, sf_dir):
    return rounded(evaluate.correlate(scored_lines(spark, sf_dir)).select("difficulty", "score_type", "entropy_type", "correlation", "num_samples"), 5)


@query(f"""{EVALUATED} SELECT * FROM (SELECT difficulty, metric, entropy_type, auroc, unnest(['roc', 'fpr', 'tpr']) AS chart, unnest([auroc >= {SHOWN}, fpr_at_80 < 0.8 OR fpr_at_90 < 0.8, tpr_at_5 >= 0.1 OR tpr_at_10 >= 0.1]) AS shown FROM ev) WHERE shown""")
def evaluation_charts(spark, sf_dir):
    """What each of the three charts shows, by limits that some rows of these tables reach and others don't."""
    found = rounded(evaluate.evaluate(rounded_lines(spark, sf_dir)), 5)
    rows = evaluate.chart_rows(found, limits=(SHOWN, 0.8, 0.1))
    return writers.evaluation_rows(rows).select("difficulty", "metric", "entropy_type", "auroc", "chart", F.lit(True).alias("shown"))


@query(f"""{EVALUATED}, report AS (SELECT difficulty, metric, entropy_type, unnest(['fpr_at_80', 'fpr_at_90', 'tpr_at_10', 'tpr_at_5']) AS point, unnest([fpr_at_80, fpr_at_90, tpr_at_10, tpr_at_5]) AS value FROM ev)
SELECT *, (ROW_NUMBER() OVER (ORDER BY difficulty, metric, entropy_type, point) - 1)::BIGINT AS place FROM report""")
def operating_points_in_order(spark, sf_dir):
    """The rows of the report in the order in which they are written."""
    return placed(writers.operating_rows(rounded(evaluate.evaluate(rounded_lines(spark, sf_dir)), 5))).drop("model", "method")


@query(f"""{CORRELATIONS}, report AS (SELECT difficulty, score_type, entropy_type, ROUND(correlation, 5) AS correlation, num_samples FROM cells)
SELECT *, (ROW_NUMBER() OVER (ORDER BY difficulty, score_type, entropy_type) - 1)::BIGINT AS place FROM report""")
def correlations_in_order(spark, sf_dir):
    return rounded(placed(writers.correlation_rows(evaluate.correlate(scored_lines(spark, sf_dir)))).drop("model", "method"), 5)


def placed(report: DataFrame) -> DataFrame:
    """A report with the place of each row, as one file of it has them: rows per group, not per question."""
    return report.coalesce(1).withColumn("place", F.monotonically_increasing_id())


@query(f"""{AREAS}, pts AS (SELECT difficulty, metric, entropy_type, (fp + n) / an AS x, (tp + p) / ap AS y FROM u JOIN a USING (difficulty, metric, entropy_type) WHERE auroc >= {SHOWN} UNION ALL SELECT difficulty, metric, entropy_type, 0, 0 FROM a WHERE auroc >= {SHOWN})
SELECT difficulty, metric, entropy_type, ROUND(x, 6) + 0 AS fpr, ROUND(y, 6) + 0 AS tpr FROM pts""")
def chart_roc_summary(spark, sf_dir):
    return rounded(evaluate.roc_summary(rounded_lines(spark, sf_dir), least=SHOWN).select("difficulty", "metric", "entropy_type", "fpr", "tpr"))


@query(f"{CORRELATIONS} SELECT difficulty, score_type, 'equality_' || entropy_type AS label, ROUND(correlation, 5) AS height, CASE WHEN correlation < 0 THEN 'red' ELSE 'blue' END AS colour FROM cells")
def chart_correlation_bars(spark, sf_dir):
    return rounded(evaluate.correlation_bars(evaluate.correlate(scored_lines(spark, sf_dir))).drop("model"), 5)


# -- selection --------------------------------------------------------------------------------------


def baseline_lines(spark: SparkSession, sf_dir: str, clustered: bool = False) -> DataFrame:
    source = F.concat_ws("/", "model", F.col("pos").cast("string"))
    rows = line_clusters(spark, sf_dir) if clustered else bound(spark, sf_dir, L)
    return rows.withColumns({"first_passed": F.col("is_passed_public"), "last_passed": F.col("passed"), "source": source})


@query(f"WITH b AS ({L}) SELECT qid, is_passed_public AS passed, is_passed_public::INTEGER::DOUBLE AS score, model || '/' || pos AS source FROM b WHERE pos = 0")
def vanilla_pick(spark, sf_dir):
    return selection.select("vanilla", baseline_lines(spark, sf_dir), seed=None)


@query(f"""WITH b AS ({L}), f AS (SELECT DISTINCT qid, CASE WHEN qid % 11 = 0 THEN 'a sample has no code' ELSE 'the question has no metadata' END AS error FROM b WHERE qid % 11 = 0 OR qid % 5 = 0),
o AS (SELECT o_orderkey AS qid FROM orders), x AS (SELECT b.* FROM b WHERE pos = 0 AND qid NOT IN (SELECT qid FROM f))
SELECT o.qid, 'vanilla' AS method, COALESCE(x.is_passed_public, FALSE) AS passed, COALESCE(x.is_passed_public, FALSE)::INTEGER::DOUBLE AS score, COALESCE(x.model || '/' || x.pos, 'none') AS source, f.error
FROM o LEFT JOIN x ON x.qid = o.qid LEFT JOIN f ON f.qid = o.qid""")
def error_rows(spark, sf_dir):
    """Questions with a sample without code, and questions without metadata, are rows of their own."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("qid"))
    metadata = keys.filter("qid % 5 <> 0").select(F.col("qid").alias("task_id"), F.lit("").alias("prompt"), F.lit(True).alias("is_stdin"))
    samples = baseline_lines(spark, sf_dir).withColumn("code", F.when((F.col("qid") % 11 != 0) | (F.col("pos") > 0), F.col("ckey")))
    found, errors = registry.cluster_sound(samples, "equality", metadata)
    return selection.answers("vanilla", found, keys, errors, seed=None).select("qid", "method", "passed", "score", "source", "error")


@query(f"""WITH {keyed(L, 'ckey')}, {TOP}, n AS (SELECT qid, COUNT(DISTINCT cluster) AS num_clusters FROM c GROUP BY qid),
x AS (SELECT c.*, top.size, ROW_NUMBER() OVER (PARTITION BY c.qid ORDER BY c.pos) AS k FROM c JOIN top ON c.qid = top.qid AND c.cluster = top.cluster)
SELECT x.qid, is_passed_public AS passed, is_passed_public::INTEGER::DOUBLE AS score, model || '/' || pos AS source, num_clusters, size AS largest_cluster_size FROM x JOIN n ON x.qid = n.qid WHERE k = 1""")
def major_voting(spark, sf_dir):
    return selection.select("major_voting", baseline_lines(spark, sf_dir, clustered=True), seed=None)


PASS_SQL = "WITH b AS ({b}) SELECT qid, BOOL_OR({p}) AS passed, ROUND(AVG(score), 6) AS score, COUNT(*) AS num_samples, COUNT(*) FILTER (WHERE {p}) AS num_passed FROM b GROUP BY qid"


@query(PASS_SQL.format(b=L, p="passed"))
def pass_at_n_baseline(spark, sf_dir):
    return rounded(selection.select("pass_at_n", baseline_lines(spark, sf_dir)))


@query(PASS_SQL.format(b=L, p="is_passed_public"))
def pass_at_n_oneshot(spark, sf_dir):
    return rounded(selection.select("pass_at_n_oneshot", baseline_lines(spark, sf_dir)))


@query(f"WITH r AS ({PASS_SQL.format(b=L, p='passed')}) SELECT COUNT(*) AS total_questions, COUNT(*) FILTER (WHERE passed) AS passed, ROUND(AVG(passed::INTEGER), 6) AS accuracy, ROUND(AVG(score), 5) AS avg_score, ROUND(AVG(num_samples), 6) AS avg_num_samples FROM r")
def baseline_stats(spark, sf_dir):
    return rounded(selection.statistics(rounded(selection.select("pass_at_n", baseline_lines(spark, sf_dir))))).withColumn("avg_score", F.round("avg_score", 5))


@query(f"""WITH b AS ({L}), o AS (SELECT DISTINCT o_orderkey AS qid FROM orders), r AS ({PASS_SQL.format(b=L, p='passed').replace('WITH b AS (' + L + ') ', '')})
SELECT o.qid, COALESCE(passed, FALSE) AS passed, COALESCE(score, 0) AS score FROM o LEFT JOIN r ON o.qid = r.qid""")
def questions_without_samples(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("qid"))
    return rounded(selection.with_all(ids, selection.select("pass_at_n", baseline_lines(spark, sf_dir))).select("qid", "passed", "score"))


LAYERS = f"""b0 AS ({L}), pub AS (SELECT * FROM b0 WHERE is_passed_public), f AS (SELECT qid, layer, ckey2, MIN(pos) AS f FROM pub GROUP BY qid, layer, ckey2),
rk AS (SELECT *, DENSE_RANK() OVER (PARTITION BY qid, layer ORDER BY f) - 1 AS cluster FROM f), c AS (SELECT pub.*, rk.cluster FROM pub JOIN rk ON pub.qid = rk.qid AND pub.layer = rk.layer AND pub.ckey2 = rk.ckey2),
n AS (SELECT qid, layer, COUNT(*) AS total, COUNT(*) FILTER (WHERE is_passed_public) AS pp FROM b0 GROUP BY qid, layer),
g AS (SELECT qid, layer, cluster, COUNT(*) AS size, COUNT(DISTINCT model) AS models FROM c GROUP BY qid, layer, cluster),
t AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid, layer ORDER BY size DESC, cluster) AS k, COUNT(*) OVER (PARTITION BY qid, layer) AS num_clusters, SUM(size) OVER (PARTITION BY qid, layer) AS tt FROM g) WHERE k = 1),
h AS (SELECT qid, layer, SUM(-(size / tt) * LN(size / tt + 1e-10)) AS dse FROM (SELECT *, (SUM(size) OVER (PARTITION BY qid, layer))::DOUBLE AS tt FROM g) GROUP BY qid, layer),
y AS (SELECT q.qid, l.layer, COALESCE(n.total, 0) AS total_count, COALESCE(n.pp, 0) AS passed_public_count, COALESCE(h.dse, 0) AS entropy, t.cluster AS top_cluster, COALESCE(t.size, 0) AS top_size, COALESCE(t.models, 0) AS models, COALESCE(t.num_clusters, 0) AS num_clusters
  FROM (SELECT DISTINCT qid FROM b0) q CROSS JOIN (SELECT unnest([0, 1, 2]) AS layer) l LEFT JOIN n ON n.qid = q.qid AND n.layer = l.layer LEFT JOIN t ON t.qid = q.qid AND t.layer = l.layer LEFT JOIN h ON h.qid = q.qid AND h.layer = l.layer),
a AS (SELECT *, CASE WHEN passed_public_count = 0 THEN 1 ELSE (total_count - passed_public_count) / total_count::DOUBLE END AS rate,
  CASE WHEN passed_public_count = 0 THEN 'skip_no_samples' WHEN layer = 2 OR (top_size > 0.3 * total_count AND top_size > 0.6 * passed_public_count AND models > 1) THEN 'stop' ELSE 'continue' END AS decision FROM y),
fin AS (SELECT qid, COALESCE(MIN(CASE WHEN decision = 'stop' THEN layer END), -1) AS final_layer FROM a GROUP BY qid)"""


def line_layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return cascade_run(layer_clusters(bound(spark, sf_dir, L), "equality", key=["ckey2"]), CONFIG, seed=None)


@query(f"WITH {LAYERS} SELECT qid, layer::BIGINT AS layer, CASE WHEN passed_public_count = 0 THEN 'Infinity'::DOUBLE ELSE ROUND(entropy * 0.5 + rate * 0.5, 6) + 0 END AS score, ROUND(rate, 6) AS public_fail_rate FROM a")
def layer_score(spark, sf_dir):
    return rounded(line_layers(spark, sf_dir)[0].select("qid", "layer", "score", "public_fail_rate"))


@query(f"WITH {LAYERS} SELECT qid, layer::BIGINT AS layer, total_count, passed_public_count, num_clusters, COALESCE(top_cluster, -1)::BIGINT AS top_cluster, top_size, ROUND(entropy, 6) + 0 AS entropy, decision FROM a")
def cascade_decision(spark, sf_dir):
    return rounded(line_layers(spark, sf_dir)[0].select("qid", "layer", "total_count", "passed_public_count", "num_clusters", F.coalesce("top_cluster", F.lit(-1)).alias("top_cluster"), "top_size", "entropy", "decision"))


@query(f"""WITH {LAYERS}, z AS (SELECT fin.qid, MIN(c.pos) AS pos FROM fin JOIN a ON a.qid = fin.qid AND a.layer = fin.final_layer JOIN c ON c.qid = a.qid AND c.layer = a.layer AND c.cluster = a.top_cluster GROUP BY fin.qid),
dl AS (SELECT a.qid, COUNT(*) AS layers FROM a JOIN fin ON a.qid = fin.qid WHERE final_layer < 0 OR a.layer <= final_layer GROUP BY a.qid)
SELECT fin.qid, COALESCE(b0.score, 0) AS final_score, COALESCE(b0.passed, FALSE) AS final_passed, final_layer::BIGINT AS final_layer, COALESCE(b0.model || '/' || b0.pos, '') AS source, dl.layers AS num_layers
FROM fin LEFT JOIN z ON z.qid = fin.qid LEFT JOIN b0 ON b0.qid = z.qid AND b0.pos = z.pos JOIN dl ON dl.qid = fin.qid""")
def cascade_selection(spark, sf_dir):
    out = line_layers(spark, sf_dir)[1]
    return rounded(out.select("qid", "final_score", "final_passed", "final_layer", "source", F.size("layer_details").cast("long").alias("num_layers")))


@query(f"WITH {LAYERS} SELECT final_layer::BIGINT AS final_layer, COUNT(*) AS questions FROM fin GROUP BY final_layer")
def cascade_stops(spark, sf_dir):
    return rounded(selection.cascade_statistics(line_layers(spark, sf_dir)[1])[0])


@query(f"""WITH {LAYERS} SELECT a.layer::BIGINT AS layer, ROUND(AVG(a.entropy), 6) AS avg_entropy, COUNT(*) AS questions FROM a JOIN fin ON a.qid = fin.qid WHERE final_layer < 0 OR a.layer <= final_layer GROUP BY a.layer""")
def cascade_layer_entropies(spark, sf_dir):
    return rounded(selection.cascade_statistics(line_layers(spark, sf_dir)[1])[2])


# -- outputs of programs ----------------------------------------------------------------------------

#: SQL: outputs of each line's program on three tests.
OUTPUTS = f"""SELECT b.qid, b.pos, t.test, CASE WHEN (b.l_partkey + t.test) % 5 < t.test THEN 'Error: x' WHEN t.test = 0 THEN b.ckey2 WHEN t.test = 1 THEN b.model ELSE b.ckey END AS output
FROM ({L}) b CROSS JOIN (SELECT 0 AS test UNION ALL SELECT 1 UNION ALL SELECT 2) t"""
#: SQL: the outputs without one of five, all samples on all tests, and the errors of each test.
VALID = f"""p AS ({OUTPUTS}), g AS ({L}), o AS (SELECT s.qid, s.pos, t.test, COALESCE(CASE WHEN contains(p.output, 'Error:') THEN 'ERROR' ELSE p.output END, 'ERROR') AS output FROM (SELECT qid, pos FROM g) s
  JOIN (SELECT DISTINCT qid, test FROM p WHERE (qid + pos + test) % 5 <> 0) t ON s.qid = t.qid LEFT JOIN (SELECT * FROM p WHERE (qid + pos + test) % 5 <> 0) p ON p.qid = s.qid AND p.pos = s.pos AND p.test = t.test),
n AS (SELECT qid, test, COUNT(*) AS n, COUNT(*) FILTER (WHERE output = 'ERROR') AS errors FROM o GROUP BY qid, test)"""


def some_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, OUTPUTS).filter("(qid + pos + test) % 5 <> 0")


@query(f"WITH {VALID} SELECT qid, test::BIGINT AS test, errors, n, errors < n / 2 AS valid FROM n")
def functional_error_filter(spark, sf_dir):
    return rounded(functional.error_counts(bound(spark, sf_dir, L), some_outputs(spark, sf_dir)).withColumn("valid", F.col("errors") < F.col("n") / 2))


@query(f"""WITH {VALID}, b AS ({L}), v AS (SELECT o.qid, o.pos, string_agg(o.test || '=' || output, '|' ORDER BY o.test) AS v FROM o JOIN n ON o.qid = n.qid AND o.test = n.test AND n.errors < n.n / 2 GROUP BY o.qid, o.pos),
k AS (SELECT b.qid, b.pos, COALESCE(v.v, '#' || b.pos) AS k FROM b LEFT JOIN v ON b.qid = v.qid AND b.pos = v.pos), f AS (SELECT qid, k, MIN(pos) AS f FROM k GROUP BY qid, k), r AS (SELECT *, DENSE_RANK() OVER (PARTITION BY qid ORDER BY f) - 1 AS cluster FROM f)
SELECT k.qid, k.pos::BIGINT AS pos, r.cluster::BIGINT AS cluster FROM k JOIN r ON k.qid = r.qid AND k.k = r.k""")
def functional_clusters(spark, sf_dir):
    samples = bound(spark, sf_dir, L)
    return rounded(registry.cluster_samples(samples, "functional", outputs=some_outputs(spark, sf_dir)).select("qid", "pos", "cluster"))


@query(f"""WITH b AS ({E}), q AS (SELECT DISTINCT qid FROM b), c AS (SELECT qid, ckey AS test, pos FROM b WHERE qid % 3 = 0), f AS (SELECT qid, ckey || '!' AS test, pos FROM b WHERE qid % 3 <> 2),
t AS (SELECT qid, list(test ORDER BY pos) AS l FROM c GROUP BY qid UNION ALL SELECT qid, list(test ORDER BY pos) FROM f WHERE qid NOT IN (SELECT qid FROM c) GROUP BY qid)
SELECT q.qid::VARCHAR AS task_id, COALESCE(CASE WHEN q.qid % 3 = 0 THEN LEAST(5, len(l)) ELSE len(l) END, 0)::BIGINT AS tests, (t.qid IS NOT NULL) AS stored, TRUE AS inside FROM q LEFT JOIN t ON t.qid = q.qid""")
def acquired_tests(spark, sf_dir):
    """Every third user has cached tests, every third fresh ones only, the others none; `inside`: tests come from the right list."""
    rows = bound(spark, sf_dir, E).select(F.col("qid").cast("string").alias("task_id"), F.lit(True).alias("is_stdin"), "qid", "pos", "ckey")
    made = lambda r, text: r.groupBy("task_id", "is_stdin").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(text.alias("input"), F.lit("").alias("output"), F.lit("stdin").alias("testtype")).alias("t")))).alias("g")).select("task_id", "is_stdin", F.col("g.t").alias("generated_tests"))
    cache, fresh = made(rows.filter("qid % 3 = 0"), F.col("ckey")), made(rows.filter("qid % 3 <> 2"), F.concat("ckey", F.lit("!")))
    tests, stored = functional.acquire_tests(rows.select("task_id", "is_stdin"), cache, fresh)
    lists = stored.select("task_id", F.col("generated_tests").alias("l"))
    right = tests.join(lists, "task_id").groupBy("task_id").agg(F.count(F.lit(1)).alias("tests"), F.bool_and(F.col("test") == F.get("l", F.col("test_no"))).alias("inside"))
    out = rows.select("task_id").distinct().join(right, "task_id", "left").join(lists, "task_id", "left")
    return out.select("task_id", F.coalesce("tests", F.lit(0)).cast("long").alias("tests"), F.col("l").isNotNull().alias("stored"), F.coalesce("inside", F.lit(True)).alias("inside"))


# -- text functions ---------------------------------------------------------------------------------

#: SQL: texts with code in fences of several kinds.
FENCED = """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'Here:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'or' || chr(10) || '```python' || chr(10) || 'x' || chr(10) || '```'
  WHEN 1 THEN '```' || chr(10) || text || chr(10) || '```' WHEN 2 THEN 'a <code> ' || text || ' </code> b' WHEN 3 THEN '```js' || chr(10) || role || chr(10) || '```' ELSE '  ' || text || chr(10) END AS raw FROM conversations"""
CONCAT_FENCED = FENCED.replace("chr(10)", "CHAR(10)")


@query(f"""WITH r AS ({FENCED}), m AS (SELECT *, regexp_extract_all(raw, '(?s)```python\\s*\\n(.*?)```', 1) AS p, regexp_extract_all(raw, '(?s)```(?:.*?)\\n(.*?)```', 1) AS g, regexp_extract_all(raw, '(?s)<code>(.*?)</code>', 1) AS t FROM r),
c AS (SELECT conv_id, turn, raw, CASE WHEN len(p) > 0 THEN p WHEN len(g) > 0 THEN g WHEN len(t) > 0 THEN t ELSE [raw] END AS c FROM m)
SELECT conv_id, turn, regexp_replace(list_reduce(c, lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END), '^\\s+|\\s+$', '', 'g') AS code FROM c""")
def extract_code_block(spark, sf_dir):
    return bound(spark, sf_dir, CONCAT_FENCED).select("conv_id", "turn", T.code_block(F.col("raw")).alias("code"))


@query(f"""WITH r AS ({FENCED}), s AS (SELECT conv_id, turn, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS t FROM r),
c AS (SELECT *, CASE WHEN contains(t, '```python') THEN regexp_extract(t, '(?s)```python(.*?)```', 1) WHEN contains(t, '```') THEN regexp_extract(t, '(?s)```(.*)```', 1) ELSE t END AS c FROM s)
SELECT conv_id, turn, regexp_replace(c, '^\\s+|\\s+$', '', 'g') AS code FROM c""")
def extract_first_fence(spark, sf_dir):
    return bound(spark, sf_dir, CONCAT_FENCED).select("conv_id", "turn", T.first_fence(F.col("raw")).alias("code"))


VALUES = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR(20)) WHEN 1 THEN CONCAT(' -', CAST(event_id AS VARCHAR(20)), ' ') WHEN 2 THEN CONCAT('\"', event_type, '\"') WHEN 3 THEN event_type WHEN 4 THEN '[1, 2]' ELSE CONCAT(CAST(event_id AS VARCHAR(20)), '.5') END AS raw FROM events"


@query(f"""WITH r AS ({VALUES}) SELECT event_id, CASE event_id % 6 WHEN 4 THEN '[1,2]' WHEN 2 THEN trim(raw) WHEN 3 THEN '"' || raw || '"' ELSE trim(raw) END AS value FROM r""")
def parse_value(spark, sf_dir):
    return bound(spark, sf_dir, VALUES).select("event_id", T.value_json(F.col("raw")).alias("value"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN [event_id::VARCHAR, '"' || event_type || '"'] ELSE [user_id::VARCHAR, event_id::VARCHAR] END AS inputs FROM events""")
def functional_io_parse(spark, sf_dir):
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("n = "), i, F.lit(", kind='"), F.col("event_type"), F.lit("'"))).otherwise(F.concat(u, F.lit("\n\n "), i, F.lit("\n")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", T.functional_inputs(raw).alias("inputs"))


@query("""WITH s AS (SELECT doc_id, regexp_replace(text || CASE WHEN doc_id % 2 = 0 THEN ' - ' ELSE chr(10) END, '^\\s+|\\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, md5(CASE WHEN suffix(t, '-') THEN regexp_replace(left(t, length(t) - 1), '\\s+$', '') ELSE t END) AS key FROM s""")
def stdin_io_parse(spark, sf_dir):
    raw = F.concat("text", F.when(F.col("doc_id") % 2 == 0, " - ").otherwise("\n"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(T.stdin_output(raw)).alias("key"))


@query("""SELECT page_id, CASE WHEN contains(html, 'sys.stdin') OR contains(html, 'input(') OR contains(html, '__name__ == "__main__"') OR contains(html, 'if __name__') OR page_id % 3 = 0 THEN 'stdin' ELSE 'functional' END AS kind FROM pages""")
def detect_code_type(spark, sf_dir):
    html = F.concat("html", F.when(F.col("page_id") % 3 == 0, "x = input()").otherwise(""))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.code_type(html).alias("kind"))


@query("SELECT p_partkey, 'f' || p_partkey AS name, replace(replace(p_name, '/', '_'), chr(92), '_') AS file FROM part")
def names_of_functions_and_files(spark, sf_dir):
    head = F.concat(F.lit("def f"), F.col("p_partkey").cast("string"), F.lit(" (a, b): return g(a)"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.signature_name(head).alias("name"), T.file_name(F.col("p_name")).alias("file"))


@query(f"WITH b AS ({E}) SELECT qid, pos::BIGINT AS round_id, ROUND(0.7 + 0.01 * pos, 6)::DOUBLE AS temperature FROM b")
def temperature_schedule(spark, sf_dir):
    """Each sample of a question is a round of its own."""
    return rounded(bound(spark, sf_dir, E).select("qid", F.col("pos").alias("round_id"), T.temperature(0.7, F.col("pos")).alias("temperature")))


@query(f"WITH b AS ({L}) SELECT qid, pos::BIGINT AS pos, CASE model WHEN 'm0' THEN 'a first model' WHEN 'm2' THEN 'a third model' ELSE model END AS name FROM b")
def alias_names(spark, sf_dir):
    return rounded(bound(spark, sf_dir, L).select("qid", "pos", T.alias(F.col("model"), {"m0": "a first model", "m2": "a third model"}).alias("name")))


#: SQL: a line's outcome on its test, as text.
OUTCOME = """'[Test ' || pos || ']' || chr(10) || 'Input: ' || model || chr(10) || 'Expected: ' || ckey2 || chr(10) || 'Actual: ' || ckey || chr(10)
  || CASE WHEN passed THEN 'Status: PASSED ✓' || chr(10) ELSE 'Status: FAILED ✗' || chr(10) || CASE WHEN pos % 2 = 0 THEN 'Error: ' || ckey || chr(10) ELSE '' END END || CASE WHEN pos % 3 = 0 THEN '' ELSE 'Time: ' || printf('%.3f', line / 8.0) || 's' || chr(10) END"""
#: SQL: the same between rules.
CASE_TEXT = """chr(10) || repeat('-', 50) || chr(10) || CASE WHEN pos % 2 = 0 THEN 'Input (stdin):' || chr(10) || model || chr(10) || 'Expected Output (stdout):' || chr(10) || ckey2 ELSE 'Input: ' || model || chr(10) || 'Expected Output: ' || ckey2 END
  || chr(10) || 'Actual Output: ' || ckey || chr(10) || 'Status: ' || CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END || chr(10) || 'Time: ' || printf('%.3f', line / 8.0) || 's' || chr(10) || CASE WHEN passed THEN '' ELSE 'Error: ' || COALESCE(CASE WHEN pos % 2 = 0 THEN ckey END, 'None') || chr(10) END || repeat('-', 50) || chr(10)"""


@query(f"WITH b AS ({L}) SELECT qid, pos::BIGINT AS pos, md5({OUTCOME}) AS outcome, md5({CASE_TEXT}) AS shown FROM b")
def test_outcome_texts(spark, sf_dir):
    even, seconds = F.col("pos") % 2 == 0, F.col("line") / 8.0
    outcome = T.test_feedback(F.col("pos"), F.col("model"), F.col("ckey2"), F.col("ckey"), F.col("passed"), F.when(even, F.col("ckey")).otherwise(""), F.when(F.col("pos") % 3 != 0, seconds))
    shown = T.debug_case(F.col("model"), F.col("ckey2"), F.col("ckey"), F.col("passed"), F.when(even, F.col("ckey")), seconds, even)
    return rounded(bound(spark, sf_dir, L).select("qid", "pos", F.md5(outcome).alias("outcome"), F.md5(shown).alias("shown")))


@query(f"""WITH b AS ({L}), h AS (SELECT *, md5('7/' || qid || '/' || pos) AS h FROM b)
SELECT qid, arg_min(is_passed_public, h) AS passed, arg_min(is_passed_public, h)::INTEGER::DOUBLE AS score, arg_min(model || '/' || pos, h) AS source FROM h GROUP BY qid""")
def vanilla_pick_seeded(spark, sf_dir):
    return selection.select("vanilla", baseline_lines(spark, sf_dir), seed=7)


@query("SELECT doc_id, doc_id % 3 = 0 AS is_stdin FROM documents")
def test_type_check(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 3 == 0, '[{"testtype": "functional"}, {"testtype": "stdin"}]').when(F.col("doc_id") % 3 == 1, '[{"testtype": "functional"}]').otherwise("no json")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.has_test_type(raw, "stdin").alias("is_stdin"))


def line_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = F.struct("pos", F.col("passed").alias("passed"), F.col("ckey").alias("message"), F.col("model").alias("input"), F.col("ckey2").alias("output"))
    rows = bound(spark, sf_dir, L).groupBy("qid").agg(F.sort_array(F.collect_list(tests)).alias("t"))
    return rows.select("qid", F.transform("t", lambda x: F.struct(*[x[c].alias(c) for c in ("passed", "message", "input", "output")])).alias("t"))


@query(f"""WITH b AS ({L}), s AS (SELECT qid, COUNT(*) AS n, COUNT(*) FILTER (WHERE passed) AS p, string_agg('  - Test ' || pos || ': ' || ckey || chr(10), '' ORDER BY pos) FILTER (WHERE NOT passed) AS f FROM b GROUP BY qid)
SELECT qid, md5(chr(10) || repeat('=', 50) || chr(10) || 'Test Results Summary' || chr(10) || repeat('=', 50) || chr(10) || 'Passed: ' || p || '/' || n || chr(10) || CASE WHEN p < n THEN chr(10) || 'Failed tests:' || chr(10) || f ELSE '' END || repeat('=', 50) || chr(10)) AS summary FROM s""")
def results_summary(spark, sf_dir):
    return line_tests(spark, sf_dir).select("qid", F.md5(T.results_summary(F.col("t"))).alias("summary"))


@query(f"""WITH b AS ({L}), s AS (SELECT qid, string_agg(chr(10) || 'Test ' || (pos + 1) || ': ' || CASE WHEN passed THEN '✓ PASS' || chr(10) ELSE '✗ FAIL' || chr(10) || 'Input: ' || model || chr(10) || 'Expected: ' || ckey2 || chr(10) || 'Error: ' || ckey || chr(10) END, '' ORDER BY pos) AS t FROM b GROUP BY qid)
SELECT qid, md5('# Problem' || chr(10) || 'p' || qid || chr(10) || chr(10) || '# Your Previous Code' || chr(10) || '```python' || chr(10) || 'c' || chr(10) || '```' || chr(10) || chr(10) || '# Test Results' || chr(10) || t || chr(10) || '# Task' || chr(10)
  || 'Analyze why your code failed and provide a corrected version. Focus on fixing the specific test failures shown above.') AS feedback FROM s""")
def debug_feedback(spark, sf_dir):
    prompt = F.concat(F.lit("p"), F.col("qid").cast("string"))
    return line_tests(spark, sf_dir).select("qid", F.md5(T.debug_feedback(prompt, F.lit("c"), F.col("t"))).alias("feedback"))


# -- readers' relational parts ----------------------------------------------------------------------


@query("SELECT DISTINCT user_id::VARCHAR AS qid FROM events")
def distinct_question_ids(spark, sf_dir):
    return readers.question_ids(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id")


@query(f"WITH b AS ({L}) SELECT qid, pos::BIGINT AS pos, z.i::BIGINT AS i FROM b JOIN (VALUES (0, 'm0', 1), (1, 'm1', 2), (2, 'm2', 1)) z(i, model, line) ON b.model = z.model AND b.line = z.line")
def ensemble_zip(spark, sf_dir):
    models = readers.padded_ensemble(["m0", "m1", "m2", "m0"], [1, 2, 1])
    chosen = spark.createDataFrame([(i, m, r) for i, (m, r) in enumerate(zip(models, [1, 2, 1]))], "i long, model string, line int")
    return rounded(bound(spark, sf_dir, L).join(F.broadcast(chosen), ["model", "line"]).select("qid", "pos", "i"))


@query(f"WITH b AS ({E}) SELECT qid, pos::BIGINT AS pos, COALESCE(c_name, '') AS prompt, COALESCE(c_custkey % 2 = 0, FALSE) AS is_stdin FROM b LEFT JOIN customer ON c_custkey = qid AND c_custkey % 3 <> 0")
def metadata_defaults(spark, sf_dir):
    meta = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("task_id"), F.col("c_name").alias("prompt"), (F.col("c_custkey") % 2 == 0).alias("is_stdin"))
    return rounded(readers.with_questions(bound(spark, sf_dir, E), meta).select("qid", "pos", "prompt", "is_stdin"))


@query(f"WITH b AS ({E}) SELECT qid, pos::BIGINT AS pos FROM b SEMI JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = qid")
def metadata_filter(spark, sf_dir):
    meta = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("qid"))
    return rounded(bound(spark, sf_dir, E).join(meta, "qid", "left_semi").select("qid", "pos"))


@query(f"""WITH b AS ({E}), e AS (SELECT qid, list(ckey ORDER BY pos) AS o FROM b WHERE pos % 2 = 0 GROUP BY qid), f AS (SELECT qid, list(ckey ORDER BY pos) AS n FROM b WHERE pos % 2 = 1 OR pos % 3 = 0 GROUP BY qid)
SELECT COALESCE(e.qid, f.qid)::VARCHAR AS task_id, CASE WHEN f.qid IS NULL THEN o ELSE list_concat(o, list_filter(n, lambda x: NOT list_contains(o, x))) END AS inputs FROM e FULL JOIN f ON e.qid = f.qid""")
def cache_upsert(spark, sf_dir):
    test = F.struct("pos", F.struct(F.col("ckey").alias("input"), F.lit("").alias("output"), F.lit("stdin").alias("testtype")).alias("t"))
    rows = bound(spark, sf_dir, E)
    gather = lambda r: r.groupBy(F.col("qid").cast("string").alias("task_id"), F.lit(True).alias("is_stdin")).agg(F.sort_array(F.collect_list(test)).alias("g")).select("task_id", "is_stdin", F.col("g.t").alias("generated_tests"))
    out = writers.upsert_tests(gather(rows.filter("pos % 2 = 0")), gather(rows.filter("pos % 2 = 1 OR pos % 3 = 0")))
    return out.select("task_id", F.col("generated_tests.input").alias("inputs"))


@query(f"""WITH b AS ({E}) SELECT qid::VARCHAR AS task_id, arg_max(ckey, pos) AS input FROM b GROUP BY qid""")
def cache_last_line_wins(spark, sf_dir):
    test = F.array(F.struct(F.col("ckey").alias("input"), F.lit("").alias("output"), F.lit("stdin").alias("testtype")))
    rows = bound(spark, sf_dir, E).select(F.when(F.col("pos") % 2 == 0, F.col("qid").cast("string")).otherwise("").alias("task_id"), F.col("qid").cast("string").alias("question_id"), F.lit(True).alias("is_stdin"), test.alias("generated_tests"), "pos")
    return readers.last_tests(rows, "pos").select("task_id", F.col("generated_tests")[0]["input"].alias("input"))


# -- functions on syntax trees, tested against brute force --------------------------------------------


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    n = F.col("event_id").cast("string")
    body = F.concat(F.lit("import math\n\ndef f"), n, F.lit("(a, b=1):\n    return f"), n, F.lit("(a - 1) if a else b\n"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(F.col("event_id") % 10 == 0, "def broken(").otherwise(body).alias("code"))


@query("SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN 'f' || event_id END AS name, CASE WHEN event_id % 10 <> 0 THEN 'f' || event_id || '(a, b)' END AS signature FROM events")
def function_signature_ast(spark, sf_dir):
    return programs(spark, sf_dir).select("event_id", C.function_name_and_signature(F.col("code")).alias("f")).select("event_id", "f.name", "f.signature")


@query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'def broken(' ELSE 'def f' || event_id || '(a, b=1):' || chr(10) || '    return f' || event_id || '(a - 1) if a else b' END AS definitions FROM events""")
def function_definitions_ast(spark, sf_dir):
    return programs(spark, sf_dir).select("event_id", C.function_definitions_of(F.col("code")).alias("definitions"))


@query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'def broken(' WHEN event_id = 7 THEN 'import math' || chr(10) || chr(10) || 'def g(a, b=1):' || chr(10) || '    return g(a - 1) if a else b'
  ELSE 'import math' || chr(10) || chr(10) || 'def f' || event_id || '(a, b=1):' || chr(10) || '    return f' || event_id || '(a - 1) if a else b' END AS code FROM events""")
def rename_function_ast(spark, sf_dir):
    return programs(spark, sf_dir).select("event_id", C.rename_function_in(F.col("code"), "f7", "g").alias("code"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END::BIGINT AS tests, CASE event_id % 3 WHEN 0 THEN '1000000000' WHEN 1 THEN event_type || chr(10) END AS first FROM events""")
def test_list_parser(spark, sf_dir):
    ship(spark)
    raw = F.when(F.col("event_id") % 3 == 0, '```json\n[{"input": 10**9, "output": 2}]\n```').when(F.col("event_id") % 3 == 1, F.concat(F.lit("Input: "), F.col("event_type"), F.lit("\nOutput: 1\nInput: 2 Output: 3"))).otherwise("nothing")
    tests = G.parse_tests_of(raw, F.col("event_id") % 3 == 1)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", tests.alias("t"))
    return rows.select("event_id", F.size("t").cast("long").alias("tests"), F.get("t", 0)["input"].alias("first"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"kind": "' || event_type || '", "n": [1, 2]}' WHEN 1 THEN '["it''s", true]' END AS json FROM events""")
def quotes_to_json(spark, sf_dir):
    ship(spark)
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{'kind': '"), F.col("event_type"), F.lit("', 'n': [1, 2]}"))).when(F.col("event_id") % 3 == 1, "[\"it's\", True]").otherwise("{'broken")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", G.quotes_to_json_of(raw).alias("json"))


@query("""WITH p AS (SELECT string_agg(line, chr(10) ORDER BY k) AS tail FROM (VALUES (1, 'def outcome(run, values):'), (2, '    try:'), (3, '        return ''value'', run(*values)'), (4, '    except Exception as error:'),
  (5, '        return ''error'', type(error).__name__'), (6, ''), (7, ''), (8, 'def agree(*values) -> bool:'), (9, '    return outcome(left, values) == outcome(right, values)'), (10, '')) t(k, line))
SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN 'def left(a, b=1):' || chr(10) || '    return left(a - 1) if a else b' || repeat(chr(10), 3) || 'def right(x):' || chr(10) || '    return x' || repeat(chr(10), 3) || tail END AS program FROM events, p""")
def check_program(spark, sf_dir):
    rows = programs(spark, sf_dir)
    return rows.select("event_id", C.check_program_of(F.col("code"), F.lit("def h(x):\n    return x\n")).alias("program"))


@query("SELECT event_id, event_id % 2 = 0 AS cached, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 9 END::BIGINT AS verdict FROM events")
def verdict_cache(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("prompt"))
    cache = asked.filter("event_id % 2 = 0").select(F.md5("prompt").alias("key"), F.lit("Entailment").alias("response"))
    out = similarity.cached_verdicts(asked, cache)
    return rounded(out.select("event_id", F.col("verdict").isNotNull().alias("cached"), F.coalesce("verdict", F.lit(9)).alias("verdict")))


from . import queries_files  # noqa: E402, F401  registers the queries on files
