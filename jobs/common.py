"""What the jobs share: configurations, sessions and logs."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession


def config_of(spark: SparkSession, path: str | None, known: dict) -> dict:
    """The settings of a job: those known, with what the JSON file at `path` says instead; ValueError for others."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if unknown := set(found) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return known | found


def parser(doc: str, *paths: str) -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=doc, formatter_class=argparse.RawDescriptionHelpFormatter)
    for path in paths:
        out.add_argument(path)
    out.add_argument("--config", help="a JSON file with settings")
    return out


def session(name: str) -> SparkSession:
    """The command line's session, which it stops at the end."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s: %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()
