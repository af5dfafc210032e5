"""Readers of saved samples, metadata, results, caches and configurations; all schemas are explicit."""

from __future__ import annotations

import json
import re
import zlib
from base64 import b64decode
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.traces import final_samples, first_last
from ..session import ship

TRACE = "array<struct<code:string,prompt_tokens:int,completion_tokens:int,logprob:double,norm_logprob:double>>"
ROUND = f"question_id string, debug_trace {TRACE}, is_passed_public boolean, passed boolean, score double"
ROUND_KEYS = "difficulty string, model string, round_id int"
QUESTION = "task_id string, prompt string, is_stdin boolean"
RESULT = "problem_id string, num_samples int, cluster_ids array<int>, num_clusters int, PE_MC double, PE_Rao double, SE double, DSE double, avg_score double, scores array<double>"
CACHE = "task_id string, question_id string, is_stdin boolean, generated_tests array<struct<input:string,output:string,testtype:string>>, version long"
PROBLEM = "question_id string, question_title string, question_content string, starter_code string, difficulty string, contest_date timestamp, public_test_cases string, private_test_cases string, metadata string"
CONFIG = "layers_count int, layers array<struct<layer_idx:int,samples:map<string,array<int>>,alpha:double,beta:double,threshold:double>>"
TESTS = "array<struct<input:string,output:string,testtype:string>>"


def _paths(spark: SparkSession, *patterns: str, folders: bool = True) -> list[str]:
    """The folders, or else the files, that some pattern matches, in whatever file system they are."""
    found = []
    for pattern in patterns:
        at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found += [str(x.getPath()) for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or [] if x.isDirectory() == folders]
    return found


def _literal(name: str) -> str:
    """A pattern that matches a name alone."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", name)


def _folder(spark: SparkSession, column: str, value: str | int) -> str:
    """A pattern for the folder that partitionBy(column) makes for a value."""
    return f"{column}={_literal(spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value)))}"


def _plain(part: Column) -> Column:
    """A part of a path as it was before it was put into a URI."""
    return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def _path_parts(*names: str) -> list[Column]:
    """The names of the folders above a file, outermost first, with or without `name=` before them."""
    parts = F.split(F.regexp_replace(F.input_file_name(), r"[?#].*$", ""), "/")
    out = []
    for i, name in enumerate(names):
        part = _plain(F.element_at(parts, i - len(names) - 1))
        value = _plain(F.substr(part, F.lit(len(name) + 2)))
        out.append(F.when(~F.startswith(part, F.lit(f"{name}=")), part).when(value != "__HIVE_DEFAULT_PARTITION__", value).alias(name))
    return out


def line_order() -> Column:
    """Orders rows that were just read by file, place in the file, and line."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("line"))


def _json(spark: SparkSession, schema: str, paths: list[str], glob: str, base: str | None = None) -> DataFrame:
    read = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("allowNonNumericNumbers", True)
    read = read if base is None else read.option("basePath", base)
    return read.option("pathGlobFilter", glob).json(paths)


#: Rounds to read: (model, round) pairs, of which a model of None stands for every model.
Wanted = Sequence[tuple[str | None, int]]


def rounds(spark: SparkSession, folder: str, difficulty: str = "*", model: str = "*", wanted: Wanted | None = None) -> DataFrame:
    """Saved rounds: their rows with difficulty, model, round_id.

    They lie in <difficulty>/<model>/round_<k>.jsonl (or .json), or as writers.write_rounds leaves them, in
    difficulty=<d>/model=<m>/round_id=<k>/. Blank lines and lines that are no JSON are skipped; numbers may be NaN or
    Infinity. A folder without rounds gives no rows. Only files of wanted rounds are listed and read, all if `wanted` is
    None; in the second layout filters on the three columns leave out files too. difficulty and model: names, or "*".
    """
    flat, deep = round_paths(spark, folder, difficulty, model, wanted)
    out = spark.createDataFrame([], f"{ROUND}, {ROUND_KEYS}") if not (flat or deep) else None
    if flat:
        number = F.regexp_extract(F.input_file_name(), r"round_(\d+)\.jsonl?$", 1).try_cast("int").alias("round_id")
        out = _json(spark, ROUND, flat, "round_*.json*").select("*", *_path_parts("difficulty", "model"), number)
    if deep:
        rows = _json(spark, f"{ROUND}, {ROUND_KEYS}", deep, "*.json*", folder).drop("batch")
        out = rows if out is None else out.unionByName(rows)
    return out.filter("question_id IS NOT NULL")


def round_paths(spark: SparkSession, folder: str, difficulty: str = "*", model: str = "*", wanted: Wanted | None = None) -> tuple[list[str], list[str]]:
    """The files of the first layout and the folders of the second that hold the wanted rounds, as patterns that match one each."""
    flat, deep = [], []
    for m, k in {(model if m is None else m, k) for m, k in wanted} if wanted is not None else [(model, None)]:
        if m != model and model != "*":
            continue
        names = [x if x == "*" else _literal(x) for x in (difficulty, m)]
        flat += _paths(spark, *[f"{folder}/{'/'.join(names)}/round_{'*' if k is None else k}.{kind}" for kind in ("json", "jsonl")], folders=False)
        parts = [f"{c}=*" if x in ("*", None) else _folder(spark, c, x) for c, x in (("difficulty", difficulty), ("model", m), ("round_id", k))]
        deep += _paths(spark, f"{folder}/{'/'.join(parts)}")
    return sorted({_literal(p) for p in flat if "/model=" not in p}), sorted({_literal(p) for p in deep})


def wanted_of(found: dict, layers: int | None = None) -> list[tuple[str, int]]:
    """The rounds that a configuration names, in its first layers or in all."""
    return [(m, r) for x in found["layers"][:layers] for m, ids in x["samples"].items() for r in ids]


def model_samples(rows: DataFrame, round_ids: Sequence[int]) -> DataFrame:
    """Final samples of the given rounds, with `pos` in the order of the list; traces without steps are dropped."""
    chosen = _listed(rows.sparkSession, [(i, r) for i, r in enumerate(round_ids)], "__i int, round_id int")
    kept = final_samples(rows.join(F.broadcast(chosen), "round_id"))
    w = Window.partitionBy("difficulty", "model", "question_id").orderBy("__i")
    return kept.withColumn("pos", F.row_number().over(w) - 1).drop("__i", "debug_trace").withColumnRenamed("question_id", "qid")


def ensemble_samples(rows: DataFrame, models: Sequence[str], round_ids: Sequence[int]) -> DataFrame:
    """Final samples of model i at round i, with `pos`; the lists must be equally long."""
    if len(models) != len(round_ids):
        raise ValueError("models and rounds must be equally long")
    chosen = _listed(rows.sparkSession, [(i, m, r) for i, (m, r) in enumerate(zip(models, round_ids))], "__i int, model string, round_id int")
    kept = final_samples(rows.join(F.broadcast(chosen), ["model", "round_id"]))
    w = Window.partitionBy("difficulty", "question_id").orderBy("__i")
    return kept.withColumn("pos", F.row_number().over(w) - 1).drop("__i", "debug_trace").withColumnRenamed("question_id", "qid")


def _listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def padded_ensemble(models: Sequence[str], round_ids: Sequence[int]) -> list[str]:
    """A list of models as long as the rounds: cut, or continued with its last one."""
    return [*models, *[models[-1]] * max(0, len(round_ids) - len(models))][: len(round_ids)]


def parse_rounds(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Question metadata from one JSON array; of a repeated task_id the last counts."""
    rows = spark.read.schema(QUESTION).option("multiLine", True).json(path).withColumn("__k", line_order())
    last = F.max_by(F.struct("prompt", "is_stdin"), "__k").alias("q")
    return rows.filter("task_id IS NOT NULL").groupBy("task_id").agg(last).select("task_id", "q.*")


def with_questions(samples: DataFrame, metadata: DataFrame | None, group: str = "qid") -> DataFrame:
    """Samples with prompt and is_stdin; empty and false where there is no metadata."""
    if metadata is None:
        return samples.withColumns({"prompt": F.lit(""), "is_stdin": F.lit(False)})
    met = samples.join(metadata.withColumnRenamed("task_id", group), group, "left")
    return met.withColumns({"prompt": F.coalesce("prompt", F.lit("")), "is_stdin": F.coalesce("is_stdin", F.lit(False))})


def question_ids(rows: DataFrame, column: str = "question_id") -> DataFrame:
    """Distinct ids as text, in order."""
    return rows.select(F.col(column).cast("string").alias("qid")).filter("qid IS NOT NULL").distinct().orderBy("qid")


def config(spark: SparkSession, path: str) -> dict:
    """A cascade configuration; ValueError unless it has all its keys and as many layers as it says."""
    rows = spark.read.schema(CONFIG).option("multiLine", True).json(path).toJSON().take(2)
    if len(rows) != 1:
        raise ValueError("a configuration is one JSON object")
    return check_config(json.loads(rows[0]))


def check_config(found: dict) -> dict:
    for key in ("layers_count", "layers"):
        if key not in found:
            raise ValueError(f"the configuration lacks {key}")
    if found["layers_count"] != len(found["layers"]):
        raise ValueError("layers_count doesn't match the layers")
    for layer in found["layers"]:
        for key in ("layer_idx", "samples", "alpha", "beta", "threshold"):
            if key not in layer:
                raise ValueError(f"a layer lacks {key}")
    return found


def config_rows(found: dict) -> list[dict]:
    """What operators.selection.cascade_layers takes."""
    return [{"layer": x["layer_idx"], "alpha": x["alpha"], "beta": x["beta"], "threshold": x["threshold"]} for x in found["layers"]]


def layer_rows(spark: SparkSession, found: dict) -> DataFrame:
    """(layer, model, round_id, k) for every sample that the configuration names."""
    rows = [(x["layer_idx"], m, r, k) for x in found["layers"] for k, (m, r) in enumerate((m, r) for m, ids in x["samples"].items() for r in ids)]
    return _listed(spark, rows, "layer int, model string, round_id int, k int")


def layer_samples(rows: DataFrame, found: dict) -> DataFrame:
    """Samples of every layer, log probabilities 0.0 if unknown, with `source` and `pos`; one scan for all questions and layers."""
    wanted = F.broadcast(layer_rows(rows.sparkSession, found))
    kept = final_samples(rows.join(wanted, ["model", "round_id"]), missing=0.0)
    w = Window.partitionBy("question_id", "layer").orderBy("k")
    out = kept.withColumn("source", F.concat("model", F.lit("/round_"), F.col("round_id").cast("string"))).withColumn("pos", F.row_number().over(w) - 1)
    return out.drop("debug_trace", "k").withColumnRenamed("question_id", "qid")


def baseline_samples(rows: DataFrame, found: dict) -> DataFrame:
    """First and last codes of the samples of the first layer."""
    wanted = F.broadcast(layer_rows(rows.sparkSession, found).filter(F.col("layer") == found["layers"][0]["layer_idx"]))
    kept = first_last(rows.join(wanted, ["model", "round_id"]))
    w = Window.partitionBy("question_id").orderBy("k")
    out = kept.withColumn("source", F.concat("model", F.lit("/round_"), F.col("round_id").cast("string"))).withColumn("pos", F.row_number().over(w) - 1)
    return out.withColumn("score", F.coalesce("score", F.lit(0.0))).drop("debug_trace", "k").withColumnRenamed("question_id", "qid")


def results(spark: SparkSession, folder: str, difficulty: str = "*", model: str = "*", method: str = "*") -> DataFrame:
    """Entropy results below <difficulty>/<model>/<method>/, in result.jsonl or as writers.write_results leaves them,
    with the three names as columns. A folder without results gives no rows; only files of the names given are listed and read."""
    names = {"difficulty": difficulty, "model": model, "method": method}
    flat = _paths(spark, f"{folder}/{'/'.join(x if x == '*' else _literal(x) for x in names.values())}/result.jsonl", folders=False)
    deep = _paths(spark, f"{folder}/{'/'.join(f'{c}=*' if x == '*' else _folder(spark, c, x) for c, x in names.items())}")
    kind = RESULT + "".join(f", {n} string" for n in names)
    out = spark.createDataFrame([], kind) if not (flat or deep) else None
    if flat:
        out = _json(spark, RESULT, list(map(_literal, flat)), "result.jsonl").select("*", *_path_parts(*names))
    if deep:
        rows = _json(spark, kind, list(map(_literal, deep)), "*.json*", folder)
        out = rows if out is None else out.unionByName(rows)
    return out


def cache_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a cache as they are stored; `version` is null in lines without one, and `bucket` is there where
    writers.append_tests has written."""
    return spark.read.schema(CACHE).option("mode", "DROPMALFORMED").json(path)


def test_cache(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, is_stdin, generated_tests): the line of each key with the highest version, lines without one first, then
    the last line, of several files that of the last name; empty ids and empty lists are left out."""
    rows = cache_lines(spark, path).withColumn("__k", F.struct(F.coalesce("version", F.lit(-1)), line_order()))
    return last_tests(rows, "__k")


def last_tests(rows: DataFrame, order: str) -> DataFrame:
    """The last list of tests of each (task_id, is_stdin); question_id is an old name of task_id."""
    named = rows.withColumn("task_id", F.coalesce(F.nullif("task_id", F.lit("")), F.nullif("question_id", F.lit("")))).filter("task_id IS NOT NULL")
    last = named.groupBy("task_id", F.coalesce("is_stdin", F.lit(False)).alias("is_stdin")).agg(F.max_by("generated_tests", order).alias("generated_tests"))
    return last.filter(F.size("generated_tests") > 0)


def problems(spark: SparkSession, path: str, difficulty: str | None = None, start: str | None = None, end: str | None = None, last: bool = False) -> DataFrame:
    """Benchmark entries as JSON lines, of one difficulty and between two dates, both included; with `last`, of those
    that share a question_id the last line counts, as in maps of their tests."""
    rows = spark.read.schema(PROBLEM).json(path)
    rows = last_entries(rows, line_order()) if last else rows
    if difficulty:
        rows = rows.filter(F.col("difficulty") == difficulty)
    if start:
        rows = rows.filter(F.col("contest_date") >= F.lit(start).cast("timestamp"))
    return rows.filter(F.col("contest_date") <= F.lit(end).cast("timestamp")) if end else rows


def decode_private(text: str | None) -> str:
    """Tests from base64 of zlib of JSON text, or from plain JSON; '[]' if undecodable. Pickled payloads are refused."""
    if not text:
        return "[]"
    for read in (lambda t: t, lambda t: zlib.decompress(b64decode(t, validate=True)).decode()):
        try:
            found = json.loads(read(text))
        except (ValueError, zlib.error, UnicodeDecodeError):
            continue
        found = json.loads(found) if isinstance(found, str) else found
        return json.dumps(found) if isinstance(found, list) else "[]"
    return "[]"


def examples(rows: DataFrame) -> DataFrame:
    """Problems as (task_id, prompt, entry_point, canonical_solution, is_stdin, public_tests, test)."""
    ship(rows.sparkSession)

    @F.pandas_udf("string")
    def decoded(texts: pd.Series) -> pd.Series:
        return pd.Series([decode_private(t) for t in texts], dtype=object)

    from ..functions.text import has_test_type

    return rows.select(
        F.col("question_id").alias("task_id"), F.col("question_content").alias("prompt"), F.col("starter_code").alias("entry_point"), F.lit("").alias("canonical_solution"),
        has_test_type(F.col("public_test_cases"), "stdin").alias("is_stdin"), F.from_json("public_test_cases", TESTS).alias("public_tests"), F.from_json(decoded("private_test_cases"), TESTS).alias("test"),
    )


def last_entries(rows: DataFrame, order: Column) -> DataFrame:
    """The last of the problems that share a question_id, by `order` (see line_order)."""
    kept = rows.withColumn("__k", order)
    return kept.groupBy("question_id").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), "__k").alias("r")).select("r.*")


def tests_of(rows: DataFrame, column: str = "public_tests") -> DataFrame:
    """(task_id, test_no, test): one row per test."""
    return rows.select("task_id", F.posexplode(column).alias("test_no", "test"))


def with_both_tests(rows: DataFrame) -> DataFrame:
    """Examples that have public and private tests."""
    return rows.filter((F.size("public_tests") > 0) & (F.size("test") > 0))
