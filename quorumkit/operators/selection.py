"""Choosing an answer for each question: single picks, votes, pass at n, and a cascade of layers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clusters import largest
from .entropy import entropies_of_parts, entropy_parts

#: A layer stops if its largest cluster has more than these shares of all samples and of those that pass
#: public tests, and comes from more than one model.
OF_ALL, OF_PUBLIC, MODELS = 0.3, 0.6, 1


def pick_order(group: Sequence[str], pos: str, seed: int | None) -> list[Column]:
    """By position, or in a pseudorandom order that any engine can make again: by the MD5 of seed/group/position."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*group, pos)])
    return [F.col(pos)] if seed is None else [F.md5(text), F.col(pos)]


def pick_one(rows: DataFrame, group: Sequence[str] = ("qid",), pos: str = "pos", seed: int | None = 0) -> DataFrame:
    """One row of each question: the first by position (seed None), or one that depends on the seed only."""
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(pick_order(group, pos, seed))])
    best = F.min_by(F.struct(*[F.col(c) for c in rows.columns if c not in group]), order).alias("__x")
    return rows.groupBy(*group).agg(best).select(*group, "__x.*")


def with_all(questions: DataFrame, results: DataFrame, group: Sequence[str] = ("qid",)) -> DataFrame:
    """Every question; those without samples fail with score 0.0 and source 'none'."""
    met = questions.select(*group).distinct().join(results, list(group), "left")
    fill = {"passed": F.coalesce("passed", F.lit(False)), "score": F.coalesce("score", F.lit(0.0))}
    if "source" in results.columns:
        fill["source"] = F.coalesce("source", F.lit("none"))
    return met.withColumns(fill)


def vanilla(samples: DataFrame, group: Sequence[str] = ("qid",), passed: str = "first_passed", seed: int | None = 0) -> DataFrame:
    """One sample of each question and whether its first code passed; score 1.0 or 0.0."""
    return pick_one(samples, group, seed=seed).select(*group, F.col(passed).alias("passed"), F.col(passed).cast("double").alias("score"), "source")


def major_voting(clustered: DataFrame, group: Sequence[str] = ("qid",), passed: str = "first_passed", seed: int | None = 0) -> DataFrame:
    """One sample of the largest cluster of each question, with the number of clusters and its size."""
    sizes = clustered.groupBy(*group).agg(F.countDistinct("cluster").alias("num_clusters"))
    top = largest(clustered, group)
    inside = clustered.join(top, [*group, "cluster"])
    out = pick_one(inside, group, seed=seed).join(sizes, list(group))
    return out.select(*group, F.col(passed).alias("passed"), F.col(passed).cast("double").alias("score"), "source", "num_clusters", F.col("size").alias("largest_cluster_size"))


def pass_at_n(samples: DataFrame, group: Sequence[str] = ("qid",), passed: str = "last_passed", score: str = "score") -> DataFrame:
    """Whether any sample passed, the mean score, and counts."""
    return samples.groupBy(*group).agg(
        F.bool_or(passed).alias("passed"), F.avg(score).alias("score"), F.count(F.lit(1)).alias("num_samples"), F.count_if(passed).alias("num_passed")
    )


def statistics(results: DataFrame) -> DataFrame:
    """Totals of a method's results."""
    means = [F.avg(c).alias(f"avg_{c}") for c in ("num_clusters", "num_samples") if c in results.columns]
    return results.agg(
        F.count(F.lit(1)).alias("total_questions"), F.count_if("passed").alias("passed"), F.avg(F.col("passed").cast("int")).alias("accuracy"), F.avg("score").alias("avg_score"), *means
    )


METHODS: dict[str, Callable[..., DataFrame]] = {
    "vanilla": vanilla,
    "major_voting": major_voting,
    "pass_at_n": pass_at_n,
    "pass_at_n_oneshot": lambda samples, **kw: pass_at_n(samples, passed="first_passed", **kw),
}


def select(method: str, samples: DataFrame, **options) -> DataFrame:
    """All questions by one method of METHODS."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: one of {', '.join(METHODS)}")
    return METHODS[method](samples, **options)


def answers(method: str, samples: DataFrame, questions: DataFrame, errors: DataFrame | None = None, group: Sequence[str] = ("qid",), **options) -> DataFrame:
    """One row for each question by one method of METHODS, with `method` and `error`.

    errors: (group, error), one row for each question that has a fault. Such a question fails with score 0.0 and
    source 'none', whatever samples it has; one without samples does so too, without an error.
    """
    if errors is None:
        errors = questions.select(*group, F.lit("").alias("error")).filter("false")
    sound = samples.join(errors.select(*group), list(group), "left_anti")
    out = with_all(questions, select(method, sound, **options), group).join(errors.select(*group, "error"), list(group), "left")
    if "source" not in out.columns:
        out = out.withColumn("source", F.when(F.col("error").isNotNull(), "none"))
    return out.withColumn("method", F.lit(method))


def layer_score(entropy: Column, total: Column, public: Column, alpha: Column, beta: Column) -> Column:
    """entropy * alpha + share that fails public tests * beta; infinite for a layer without passing samples."""
    rate = F.coalesce(F.try_divide((total - public).cast("double"), total.cast("double")), F.lit(0.0))
    return F.when(public == 0, F.lit(float("inf"))).otherwise(F.coalesce(entropy, F.lit(0.0)) * alpha + rate * beta)


def cascade_layers(samples: DataFrame, config: Sequence[dict], measure: str = "DSE", group: str = "qid", logprob: str = "logprob", seed: int | None = 0) -> DataFrame:
    """One row per question and layer: counts, entropy, score, largest cluster, a sample of it (`pick`), and the decision.

    samples: (group, layer, pos, model, is_passed_public, passed, score, cluster); clusters are of those that pass public
    tests, null for the others. config: layer, alpha, beta and threshold of each layer. A layer without passing samples
    is skipped; the last one always stops; another stops if its largest cluster dominates (OF_ALL, OF_PUBLIC, MODELS).
    Counts, entropies, clusters and picks come from one aggregate of the samples, and a question's layers meet in one row:
    samples that lie by question are not shuffled. A question without an id has no samples in any layer.
    """
    keys, own = [group, "layer"], F.coalesce(F.col("is_passed_public"), F.lit(False))
    inside = samples.withColumns({"__in": own, logprob: F.when(own, F.col(logprob))})
    pick = F.min(F.when(F.col("__in"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(pick_order(keys, "pos", seed))], "pos", "model", "passed", "score"))).alias("__pick")
    parts = entropy_parts(inside, logprob, keys, ["cluster", "__in"], also=[F.collect_set(F.when(F.col("__in"), F.col("model"))).alias("__models"), pick])
    parts = parts.withColumns({"__all": F.col("n"), "n": F.when(F.col("__in"), F.col("n")).otherwise(0)})
    models = F.size(F.array_distinct(F.flatten(F.collect_list("__models")))).alias("__models")
    top = F.when(F.col("__in"), F.struct("n", (-F.col("cluster")).alias("last"), "__models", "__pick"))
    found = entropies_of_parts(
        parts, keys, ["cluster", "__in"], also=[models, F.min("__pick").alias("__pick"), F.sum("__all").alias("__all")],
        more={"__largest": (F.max, top), "__all": (F.sum, F.col("__all"))}, then=["__largest", F.col("__all").alias("total_count")],
    )
    has = ("layer", "total_count", "num_samples", "num_clusters", measure, "__largest")
    named = F.col(group).isNotNull() & F.col("layer").isin([c["layer"] for c in config])
    found = found.groupBy(group).agg(F.collect_list(F.when(named, F.struct(*has))).alias("__l"))
    rows = F.array(*[F.struct(F.lit(c["layer"]).alias("layer"), *[F.lit(float(c[k])).alias(k) for k in ("alpha", "beta", "threshold")]) for c in config])
    met = found.select(group, "__l", F.explode(rows).alias("__c")).select(group, "__l", "__c.*")
    met = met.select("*", F.try_element_at(F.filter("__l", lambda x: x["layer"] == F.col("layer")), F.lit(1)).alias("__f")).drop("__l")
    met = met.select(group, "layer", "alpha", "beta", "threshold", *[F.col(f"__f.{c}").alias(a) for c, a in zip(has[1:], ("total_count", "passed_public_count", "num_clusters", "entropy", "__largest"))])
    total, public = F.coalesce("total_count", F.lit(0)), F.coalesce("passed_public_count", F.lit(0))
    size = F.col("__largest.n")
    last = F.col("layer") == max(c["layer"] for c in config)
    dominates = (size > OF_ALL * total) & (size > OF_PUBLIC * public) & (F.col("__largest.__models") > MODELS)
    decision = F.when(public == 0, "skip_no_samples").when(last | dominates, "stop").otherwise("continue")
    return met.select(
        *keys, total.alias("total_count"), public.alias("passed_public_count"), F.when(public == 0, 0.0).otherwise(F.coalesce("entropy", F.lit(0.0))).alias("entropy"),
        F.when(public == 0, 1.0).otherwise((total - public).cast("double") / total).alias("public_fail_rate"),
        layer_score(F.col("entropy"), total, public, F.col("alpha"), F.col("beta")).alias("score"), "threshold",
        F.coalesce("num_clusters", F.lit(0)).alias("num_clusters"), (-F.col("__largest.last")).alias("top_cluster"), F.coalesce(size, F.lit(0)).alias("top_size"), decision.alias("decision"),
        F.col("__largest.__pick").alias("pick"),
    )


def cascade(layers: DataFrame, group: str = "qid") -> DataFrame:
    """One row per question: the first layer that stops and the sample of its largest cluster; final_layer -1,
    score 0.0 and no source if none stops. `layer_details` lists the layers up to it, all if none stops."""
    stops = F.col("decision") == "stop"
    out = layers.groupBy(group).agg(
        F.min(F.when(stops, F.struct("layer", "pick"))).alias("__s"),
        F.sort_array(F.collect_list(F.struct("layer", "total_count", "passed_public_count", "entropy", "public_fail_rate", "score", "num_clusters", "decision"))).alias("__all"),
    )
    final, pick = F.coalesce("__s.layer", F.lit(-1)), F.col("__s.pick")
    return out.select(
        group, F.coalesce(pick["score"], F.lit(0.0)).alias("final_score"), F.coalesce(pick["passed"], F.lit(False)).alias("final_passed"), final.alias("final_layer"),
        F.coalesce(F.concat_ws("/", pick["model"], pick["pos"].cast("string")), F.lit("")).alias("source"), pick["pos"].alias("selected_pos"),
        F.filter("__all", lambda d: (final < 0) | (d["layer"] <= final)).alias("layer_details"),
    )


def cascade_answers(results: DataFrame, questions: DataFrame, errors: DataFrame | None = None, group: str = "qid") -> DataFrame:
    """One row for each question, with `error`: those of results, and for others what a question without an answer has.

    errors: (group, error), one row for each question that has a fault: it has no answer, whatever results say. A
    question without samples has none either, and no error.
    """
    every = questions.select(group).distinct()
    faults = every.select(group, F.lit(None).cast("string").alias("error")).filter("false") if errors is None else errors.select(group, "error")
    met = every.join(results.join(faults, group, "left_anti"), group, "left").join(faults, group, "left")
    plain = {"final_score": F.lit(0.0), "final_passed": F.lit(False), "final_layer": F.lit(-1), "source": F.lit("")}
    return met.withColumns({c: F.coalesce(c, v) for c, v in plain.items()}).withColumn("layer_details", F.coalesce("layer_details", F.array().cast(results.schema["layer_details"].dataType)))


def cascade_statistics(results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How many questions stop at each layer; the mean final score; the mean entropy of each layer that was reached."""
    stops = results.groupBy("final_layer").agg(F.count(F.lit(1)).alias("questions"))
    score = results.agg(F.count(F.lit(1)).alias("total_questions"), F.avg("final_score").alias("avg_final_score"))
    reached = results.select(F.explode("layer_details").alias("d")).groupBy(F.col("d.layer").alias("layer")).agg(F.avg("d.entropy").alias("avg_entropy"), F.count(F.lit(1)).alias("questions"))
    return stops, score, reached
