"""Four measures of how uncertain a set of samples is."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Added to each share before the logarithm; one cluster therefore gives about -1e-10.
EPSILON = 1e-10
#: Log probabilities are added up in steps of this size.
STEP = 32.0
MEASURES = ("PE_MC", "PE_Rao", "SE", "DSE")


def discrete_entropy(clustered: DataFrame, group: Sequence[str] = ("qid",)) -> DataFrame:
    """(group, DSE, num_samples, num_clusters): the entropy of the clusters' shares of the samples."""
    sizes = clustered.groupBy(*group, "cluster").agg(F.count(F.lit(1)).alias("n"))
    alike = sizes.groupBy(*group, "n").agg(F.count(F.lit(1)).alias("k"))
    listed = alike.groupBy(*group).agg(F.collect_list(F.struct("n", "k")).alias("__l"), F.sum(F.col("n") * F.col("k")).alias("num_samples"), F.sum("k").alias("num_clusters"))
    return listed.select(*group, _shares("num_samples").alias("DSE"), "num_samples", "num_clusters")


def _added(f: Callable[[Column], Column]) -> Column:
    """The sum of f over the list __l of what a question's clusters are, nulls left out; null if there is nothing else."""
    one = F.filter(F.transform("__l", f), lambda v: v.isNotNull())
    return F.when(F.size(one) > 0, F.aggregate(one, F.lit(0.0), lambda a, v: a + v))


def _scaled(f: Callable[[Column], Column], ahead: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: f(x) * F.exp(ahead(x))


def _shares(total: str) -> Column:
    """Minus the sum of share * log(share), where k clusters have n of all samples each; null without samples."""
    share = lambda x: F.try_divide(x["n"].cast("double"), F.col(total))
    return _added(lambda x: -x["k"] * share(x) * F.log(share(x) + EPSILON))


def entropy_parts(samples: DataFrame, logprob: str = "logprob", group: Sequence[str] = ("qid",), key: Sequence[str] = ("cluster",), also: Sequence[Column] = ()) -> DataFrame:
    """(group, key, step, n, m, s, z, w, also): what the entropies of a question are made of, in sums that add up.

    Rows of one (group, key, step) can be added number by number, whatever part of the samples each is from: `n` samples,
    `m` of them with a log probability, whose sum is `s`; `z` is the sum of exp(d) and `w` that of d exp(d), where d is
    what the log probability is above step * STEP. Steps keep exponentials of very small log probabilities. `also`: more aggregates of the samples.
    """
    lp = F.col(logprob).cast("double")
    step = F.floor(lp / STEP)
    d = lp - step * STEP
    sums = [F.count(F.lit(1)).alias("n"), F.count("__lp").alias("m"), F.sum("__lp").alias("s"), F.sum(F.exp("__d")).alias("z"), F.sum(F.col("__d") * F.exp("__d")).alias("w")]
    return samples.withColumns({"__lp": lp, "step": step, "__d": d}).groupBy(*group, *key, "step").agg(*sums, *also)


def add_parts(parts: DataFrame, group: Sequence[str] = ("qid",), key: Sequence[str] = ("cluster",)) -> DataFrame:
    """Parts of several sets of samples as those of all of them."""
    return parts.groupBy(*group, *key, "step").agg(*[F.sum(c).alias(c) for c in ("n", "m", "s", "z", "w")])


def entropies_of_parts(
    parts: DataFrame, group: Sequence[str] = ("qid",), key: Sequence[str] = ("cluster",), also: Sequence[Column] = (),
    more: Mapping[str, tuple[Callable[[Column], Column], Column]] | None = None, then: Sequence[Column] = (),
) -> DataFrame:
    """The measures of entropies() from parts, of which each (group, key, step) has one row, and `then`.

    also: aggregates of other columns of parts by (group, key); more: by name, an aggregate such as F.max that can be taken
    again of its own results, and what it is taken of: these, the keys and `n`; then: columns of `more` and the measures.
    A key with n = 0 is no cluster.

    With z and w brought to the greatest step of a question, Z their sum and z by key: PE_Rao is log Z - W / Z, and
    SE is log Z - sum(z log z) / Z. A key's z, w and z log z are brought to its own greatest step, and added up over
    the keys of a question with the same step and size, of which there are few; what is left is one short list for a
    question. Nothing is joined and all sums are combined before they are shuffled: where samples lie by question,
    nothing is shuffled at all.
    """
    more = more or {}
    steps = F.collect_list(F.when(F.col("step").isNotNull(), F.struct("step", "z", "w"))).alias("__steps")
    clusters = parts.groupBy(*group, *key).agg(*[F.sum(c).alias(c) for c in ("n", "m", "s")], F.max("step").alias("__top"), steps, *also)
    ahead = lambda x: (x["step"] - F.col("__top")) * STEP
    add = lambda f: F.when(F.col("__top").isNotNull(), F.aggregate("__steps", F.lit(0.0), lambda a, x: a + f(x) * F.exp(ahead(x))))
    clusters = clusters.withColumns({"z": add(lambda x: x["z"]), "w": add(lambda x: x["w"] + x["z"] * ahead(x))}).drop("__steps")
    clusters = clusters.withColumn("t", F.when(F.col("z") > 0, F.col("z") * F.log("z")).when(F.col("z") == 0, 0.0))
    alike = clusters.groupBy(*group, "__top", "n").agg(F.count(F.lit(1)).alias("k"), *[F.sum(c).alias(c) for c in ("m", "s", "z", "w", "t")], *[f(c).alias(name) for name, (f, c) in more.items()])
    listed = alike.groupBy(*group).agg(
        F.collect_list(F.struct(F.col("__top").alias("step"), "n", "k", "z", "w", "t")).alias("__l"), F.max("__top").alias("__top"), F.sum(F.col("n") * F.col("k")).alias("num_samples"),
        F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("num_clusters"), F.sum("m").alias("__m"), F.sum("s").alias("__s"), *[f(F.col(name)).alias(name) for name, (f, _) in more.items()],
    )
    # Z, W and the sum of z log z at the greatest step of all; z log z grows by z times the logarithm of the factor.
    brought = {"__z": lambda x: x["z"], "__w": lambda x: x["w"] + x["z"] * ahead(x), "__t": lambda x: x["t"] + x["z"] * ahead(x)}
    met = listed.withColumns({name: _added(_scaled(f, ahead)) for name, f in brought.items()})
    return met.select(
        *group, F.try_divide(-F.col("__s"), F.col("__m")).alias("PE_MC"), (F.log("__z") - F.col("__w") / F.col("__z")).alias("PE_Rao"), (F.log("__z") - F.col("__t") / F.col("__z")).alias("SE"),
        _shares("num_samples").alias("DSE"), "num_samples", "num_clusters", *then,
    )


def entropies(clustered: DataFrame, logprob: str = "logprob", group: Sequence[str] = ("qid",)) -> DataFrame:
    """One row per question: PE_MC, PE_Rao, SE, DSE, num_samples, num_clusters.

    PE_MC is minus the mean log probability. PE_Rao is the entropy of the log probabilities normalised
    over the samples, SE that of the clusters' summed probabilities. Samples without a log probability
    count for DSE only; without any the other three are null. Samples are added up by (question, cluster) before they
    are shuffled, and a question's parts meet as sums only, so that one question may have most of all samples.
    """
    return entropies_of_parts(entropy_parts(clustered, logprob, group), group)


def question_rows(clustered: DataFrame, logprob: str = "logprob", group: Sequence[str] = ("qid",), pos: str = "pos", score: str = "score") -> DataFrame:
    """entropies() with avg_score, and scores and cluster_ids as arrays in the order of positions."""
    listed = clustered.groupBy(*group).agg(
        F.avg(score).alias("avg_score"), F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(score).alias("s"), F.col("cluster").alias("c")))).alias("__r")
    )
    arrays = listed.select(*group, "avg_score", F.col("__r.s").alias("scores"), F.col("__r.c").alias("cluster_ids"))
    return entropies(clustered, logprob, group).join(arrays, list(group))


def dataset_means(rows: DataFrame) -> DataFrame:
    """Means over questions, nulls left out."""
    return rows.agg(*[F.avg(c).alias(f"avg_{c}") for c in (*MEASURES, "num_clusters")], F.avg("avg_score").alias("avg_score"), F.count(F.lit(1)).alias("num_questions"))


def sequence_logprob(tokens: DataFrame, group: Sequence[str], logprob: str) -> DataFrame:
    """(group, logprob, norm_logprob, completion_tokens): sum and mean of tokens' log probabilities, null without any."""
    return tokens.groupBy(*group).agg(F.sum(logprob).alias("logprob"), F.avg(logprob).alias("norm_logprob"), F.count(F.lit(1)).alias("completion_tokens"))
