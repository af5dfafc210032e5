"""Runs over folders of saved rounds and results: python -m quorumkit entropy | evaluate | cascade | baselines."""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.entropy import MEASURES
from .operators.registry import available_methods
from .operators.selection import METHODS, statistics
from .plans.runs import baseline_sweep, cascade_sweep, entropy_sweep, evaluation_run
from .sources import readers, writers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quorumkit", description=__doc__)
    runs = top.add_subparsers(dest="run", required=True)
    entropy = runs.add_parser("entropy", help="entropies of all questions, models and difficulties")
    entropy.add_argument("rounds", help="folder of saved rounds")
    entropy.add_argument("results", help="folder for the results")
    entropy.add_argument("--methods", nargs="+", default=["bleu"], choices=available_methods())
    entropy.add_argument("--options", type=json.loads, default={}, help="JSON: options of each method")
    entropy.add_argument("--rounds-used", type=readers.parse_rounds, default=list(range(20)), help="such as 0,1,2")
    entropy.add_argument("--difficulty", default="*")
    entropy.add_argument("--model", default="*")
    entropy.add_argument("--norm", action="store_true", help="take normalised log probabilities")
    evaluation = runs.add_parser("evaluate", help="areas, operating points and correlations of saved results")
    evaluation.add_argument("results", help="folder of results")
    evaluation.add_argument("reports", help="folder for the reports")
    for name, text in (("cascade", "a cascade of layers"), ("baselines", "single picks, votes and pass at n, over the first layer")):
        one = runs.add_parser(name, help=text)
        one.add_argument("rounds", help="folder of saved rounds")
        one.add_argument("configuration", help="JSON file of layers")
        one.add_argument("results", help="folder for the results")
        one.add_argument("--difficulty", default="*")
        one.add_argument("--seed", type=int, default=0)
        one.add_argument("--metadata", help="JSON file of questions; those without a row in it are errors")
        if name == "cascade":
            one.add_argument("--method", default="equality", choices=available_methods())
            one.add_argument("--options", type=json.loads, default={}, help="JSON: options of the method")
            one.add_argument("--measure", default="DSE", choices=MEASURES)
        else:
            one.add_argument("--methods", nargs="+", default=list(METHODS), choices=METHODS)
    return top


def select(spark: SparkSession, asked: argparse.Namespace) -> None:
    """Cascade: one row per question in full/, the report in report/. Baselines: one row per question and method in answers/,
    totals in statistics/. Both: what the run was made with in config/."""
    found = readers.config(spark, asked.configuration)
    metadata = readers.questions(spark, asked.metadata) if asked.metadata else None
    rows = readers.rounds(spark, asked.rounds, asked.difficulty, wanted=readers.wanted_of(found, None if asked.run == "cascade" else 1))
    if asked.run == "cascade":
        results, clustered = cascade_sweep(rows, found, asked.method, metadata, asked.measure, asked.seed, **asked.options)
        writers.full_rows(results).write.mode("overwrite").json(f"{asked.results}/full")
        writers.cascade_rows(results, clustered).write.mode("overwrite").json(f"{asked.results}/report")
    else:
        out = baseline_sweep(rows, found, asked.methods, metadata=metadata, seed=asked.seed)
        out.write.mode("overwrite").partitionBy("method").json(f"{asked.results}/answers")
        for method in asked.methods:
            statistics(out.filter(F.col("method") == method)).coalesce(1).write.mode("overwrite").json(f"{asked.results}/statistics/{method}")
    line = writers.experiment(found, {k: v for k, v in vars(asked).items() if v is not None}, datetime.now(timezone.utc).isoformat())
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{asked.results}/config")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    asked = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("quorumkit").getOrCreate()
    if asked.run == "entropy":
        rows = readers.rounds(spark, asked.rounds, asked.difficulty, asked.model, [(None, k) for k in asked.rounds_used])
        methods = {m: asked.options.get(m, {}) for m in asked.methods}
        parameters = {"methods": methods, "rounds": asked.rounds_used, "norm": asked.norm, "difficulty": asked.difficulty, "model": asked.model}
        parameters["timestamp"] = datetime.now(timezone.utc).isoformat()
        writers.write_results(entropy_sweep(rows, methods, asked.rounds_used, asked.norm), asked.results, parameters)
        return
    if asked.run in ("cascade", "baselines"):
        return select(spark, asked)
    areas, correlations = evaluation_run(readers.results(spark, asked.results))
    writers.write_sorted(writers.evaluation_rows(areas), f"{asked.reports}/evaluation")
    writers.write_sorted(writers.operating_rows(areas), f"{asked.reports}/operating_points")
    writers.write_sorted(writers.correlation_rows(correlations), f"{asked.reports}/correlation")


if __name__ == "__main__":
    main()
