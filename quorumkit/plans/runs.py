"""The runs from end to end: entropies of samples, their evaluation, and the selection of answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clusters import by_key
from ..operators.entropy import MEASURES, question_rows
from ..operators.evaluate import correlate, evaluate, question_scores, with_p_value
from ..operators.registry import cluster_samples, faults
from ..operators.selection import answers, cascade, cascade_answers, cascade_layers
from ..session import kept
from ..sources.readers import baseline_samples, config_rows, layer_samples, model_samples


def entropy_run(samples: DataFrame, method: str, metadata: DataFrame | None = None, norm: bool = False, **options) -> DataFrame:
    """Clusters and entropies of all questions (those in metadata, if given) in one plan.

    samples: (qid, pos, logprob, norm_logprob, score) and what the method needs.
    """
    if metadata is not None:
        samples = samples.join(metadata.select(F.col("task_id").alias("qid")), "qid", "left_semi")
    clustered = cluster_samples(samples, method, **options)
    return question_rows(clustered, "norm_logprob" if norm else "logprob").withColumnRenamed("qid", "problem_id")


def evaluation_run(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Areas and operating points, and correlations with p values, of saved results (sources.readers.results)."""
    keys = ["model", "method", "difficulty"]
    samples = results.select(*keys, "problem_id", F.explode(F.arrays_zip("scores", "cluster_ids")).alias("z")).select(*keys, "problem_id", F.col("z.scores").alias("score"), F.col("z.cluster_ids").alias("cluster"))
    scored = results.select(*keys, "problem_id", *MEASURES).join(question_scores(samples, [*keys, "problem_id"]), [*keys, "problem_id"])
    return evaluate(scored, keys), with_p_value(correlate(scored, keys))


def cascade_run(clustered: DataFrame, config: list[dict], measure: str = "DSE", logprob: str = "logprob", seed: int | None = 0) -> tuple[DataFrame, DataFrame]:
    """Layers and chosen answers of all questions. clustered: samples of every layer (operators.selection.cascade_layers)."""
    layers = cascade_layers(clustered, config, measure, logprob=logprob, seed=seed)
    return layers, cascade(layers)


def layer_clusters(samples: DataFrame, method: str, **options) -> DataFrame:
    """Samples of layers (sources.readers.layer_samples) with `cluster`: each layer of a question clusters those that pass
    public tests by a method; the others have none. Equal keys are found in one pass over all of them."""
    if method == "equality":
        return cluster_samples(samples, method, where="is_passed_public", group=("qid", "layer"), **options)
    public = samples.filter("is_passed_public").withColumn("qid", F.struct("qid", "layer"))
    found = cluster_samples(public, method, **options).withColumn("qid", F.col("qid.qid"))
    none = samples.filter("NOT coalesce(is_passed_public, false)").withColumn("cluster", F.lit(None).cast(found.schema["cluster"].dataType))
    return found.select(none.columns).unionByName(none)


def cascade_sweep(rows: DataFrame, config: dict, method: str, metadata: DataFrame | None = None, measure: str = "DSE", seed: int | None = 0, **options) -> tuple[DataFrame, DataFrame]:
    """A cascade over all questions of saved rounds (sources.readers.rounds) by a configuration, and its clustered samples.

    One row per question, with `error` for those that registry.faults names; a question that a layer has no sample of
    goes on without it. The rows are stored in columns, so that their text is parsed once.
    """
    rows = kept(rows)
    samples = layer_samples(rows, config)
    errors = faults(samples, metadata)
    clustered = layer_clusters(samples.join(errors.select("qid"), "qid", "left_anti"), method, **options)
    _, chosen = cascade_run(clustered, config_rows(config), measure, seed=seed)
    return cascade_answers(chosen, rows.select(F.col("question_id").alias("qid")), errors), clustered


def baseline_sweep(rows: DataFrame, config: dict, methods: Sequence[str], key: Sequence[str] = ("last_code",), metadata: DataFrame | None = None, seed: int | None = 0) -> DataFrame:
    """One row per question and baseline of operators.selection, over the first layer's samples of saved rounds; major
    voting groups samples by equal keys. The rows are stored in columns, so that their text is parsed once."""
    rows = kept(rows)
    samples = baseline_samples(rows, config).withColumn("code", F.col("last_code"))
    errors, questions = faults(samples, metadata), rows.select(F.col("question_id").alias("qid"))
    out = []
    for method in methods:
        given = by_key(samples, key) if method == "major_voting" else samples
        seeded = {"seed": seed} if method in ("vanilla", "major_voting") else {}
        out.append(answers(method, given, questions, errors, **seeded))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def entropy_sweep(rows: DataFrame, methods: Mapping[str, dict], round_ids: Sequence[int], norm: bool = False) -> DataFrame:
    """Clusters and entropies of all questions of all models and difficulties in `rows` (sources.readers.rounds) by each
    method with its options, as sources.writers.write_results takes them.

    A question of one model and difficulty is one group; a method is one plan over all of them. The samples are stored
    in columns, so that their text is parsed once.
    """
    names = ("difficulty", "model", "problem_id")
    samples = kept(model_samples(rows, round_ids))
    key = F.struct("difficulty", "model", F.col("qid").alias("problem_id"))
    samples = samples.withColumn("qid", key).drop("difficulty", "model")
    found = [question_rows(cluster_samples(samples, m, **o), "norm_logprob" if norm else "logprob").withColumn("method", F.lit(m)) for m, o in methods.items()]
    every = reduce(DataFrame.unionByName, found)
    return every.select(*[F.col(f"qid.{n}").alias(n) for n in names], *[c for c in every.columns if c != "qid"])
