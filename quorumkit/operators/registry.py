"""Clustering methods by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import by_key, cluster
from .functional import by_outputs
from .similarity import above, code_bleu_pairs, cosine_links, entails, links_by, ngram_precision_pairs


def embed(samples: DataFrame, vector: str = "embedding", threshold: float = 0.5, algorithm: str = "dfs") -> DataFrame:
    return cluster(samples, cosine_links(samples, vector, threshold), algorithm, whole=True)


def bleu(samples: DataFrame, code: str = "code", threshold: float = 0.7, algorithm: str = "dfs") -> DataFrame:
    return cluster(samples, above(code_bleu_pairs(samples, code), threshold), algorithm, whole=True)


def ngrams(samples: DataFrame, code: str = "code", threshold: float = 0.7, n: int = 1, algorithm: str = "dfs") -> DataFrame:
    return cluster(samples, above(ngram_precision_pairs(samples, code, n), threshold), algorithm, whole=True)


def nlg(samples: DataFrame, verdicts: DataFrame, strict: bool = True, algorithm: str = "dfs") -> DataFrame:
    """verdicts: (qid, a, b, verdict) for both directions of each pair."""
    back = verdicts.select("qid", F.col("a").alias("b"), F.col("b").alias("a"), F.col("verdict").alias("back"))
    links = verdicts.filter("a < b").join(back, ["qid", "a", "b"]).filter(entails(F.col("verdict"), F.col("back"), strict))
    return cluster(samples, links.select("qid", "a", "b"), algorithm, whole=True)


def symbolic(samples: DataFrame, verdicts: DataFrame, algorithm: str = "dfs") -> DataFrame:
    """verdicts: (qid, a, b, equivalent), which need not agree in both directions; a missing one counts as false."""
    links = verdicts.filter("equivalent").select("qid", "a", "b")
    return cluster(samples, links, algorithm, whole=True, **({"directed": True} if algorithm == "dfs" else {}))


def functional(samples: DataFrame, outputs: DataFrame) -> DataFrame:
    """outputs: (qid, pos, test, output)."""
    return by_outputs(samples, outputs)


def equality(samples: DataFrame, key: Sequence[str] = ("ckey",), where: str | None = None, group: str | Sequence[str] = "qid") -> DataFrame:
    """where: a boolean column; samples for which it isn't true are in no cluster."""
    return by_key(samples, key, group, where=where)


METHODS: dict[str, tuple[Callable[..., DataFrame], str]] = {
    "embed": (embed, "cosine of vectors above a threshold"),
    "bleu": (bleu, "CodeBLEU of programs above a threshold"),
    "ngrams": (ngrams, "n-gram precision of texts above a threshold"),
    "nlg_deberta": (nlg, "entailment verdicts of an encoder, both ways"),
    "nlg_llm": (nlg, "entailment verdicts of a language model, both ways"),
    "symbolic": (symbolic, "verdicts of a symbolic checker"),
    "functional": (functional, "equal outputs on generated tests"),
    "functional_vanilla": (functional, "equal outputs on the tests of a generator program"),
    "equality": (equality, "equal keys"),
}


def available_methods() -> list[str]:
    return list(METHODS)


def method_info(name: str) -> dict[str, str]:
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}: one of {', '.join(METHODS)}")
    return {"name": name, "description": METHODS[name][1]}


def register(name: str, method: Callable[..., DataFrame], description: str) -> None:
    """Adds a method: samples (qid, pos, ...) in, the same with `cluster` out."""
    METHODS[name] = (method, description)


def register_similarity(name: str, similarity: Callable[[list, list], np.ndarray], value: str, threshold: float, description: str, symmetric: bool = False) -> None:
    """Adds a method that links samples by a function of one's own (similarity.links_by) on a column of samples; components
    or leaders of the links are its clusters."""

    def method(samples: DataFrame, threshold: float = threshold, algorithm: str = "dfs") -> DataFrame:
        return cluster(samples, links_by(samples, value, similarity, threshold, symmetric), algorithm, whole=True)

    register(name, method, description)


def check_samples(samples: DataFrame, needed: Sequence[str] = ("qid", "pos")) -> DataFrame:
    """samples, if they have the columns; rows without text in a `code` column fail the query."""
    missing = [c for c in needed if c not in samples.columns]
    if missing:
        raise ValueError(f"samples lack {', '.join(missing)}")
    if "code" in samples.columns:
        checked = F.when(F.col("code").isNull(), F.raise_error(F.lit("a sample has no code"))).otherwise(F.col("code"))
        return samples.withColumn("code", checked)
    return samples


def cluster_samples(samples: DataFrame, method: str, **options) -> DataFrame:
    """Clusters of the samples of all questions by a named method; ValueError for an unknown one."""
    method_info(method)
    return METHODS[method][0](check_samples(samples), **options)


def check_metadata(metadata: DataFrame) -> DataFrame:
    """metadata, if it has task_id, prompt and a boolean is_stdin."""
    missing = [c for c in ("task_id", "prompt", "is_stdin") if c not in metadata.columns]
    if missing:
        raise ValueError(f"metadata lacks {', '.join(missing)}")
    if dict(metadata.dtypes)["is_stdin"] != "boolean":
        raise ValueError("is_stdin must be boolean")
    return metadata


def faults(samples: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(qid, error): questions that have a sample without code or, if metadata is given, no row of it with a prompt and
    a flag. One error for each question, of two the first by alphabet."""
    found = [samples.select("qid", F.lit("").alias("error")).filter("false")]
    if "code" in samples.columns:
        found.append(samples.filter(F.col("code").isNull()).select("qid", F.lit("a sample has no code").alias("error")))
    if metadata is not None:
        whole = check_metadata(metadata).dropna(subset=["task_id", "prompt", "is_stdin"]).select(F.col("task_id").alias("qid"))
        found.append(samples.select("qid").join(whole, "qid", "left_anti").select("qid", F.lit("the question has no metadata").alias("error")))
    return reduce(DataFrame.unionByName, found).groupBy("qid").agg(F.min("error").alias("error"))


def cluster_sound(samples: DataFrame, method: str, metadata: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Clusters of the questions without faults, and the faults: one bad question doesn't end the others."""
    errors = faults(samples, metadata)
    return cluster_samples(samples.join(errors.select("qid"), "qid", "left_anti"), method, **options), errors
