"""Tests in the text that a model has generated; Arrow-batched."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import as_json, objects, strict, tolerant


def unfenced(text: str) -> str:
    """The text without the fence around it and the fence's language."""
    bare = text.strip().strip("`").lstrip()
    return bare.removeprefix("json").strip()


def _ended(text: str) -> str:
    return text if text.endswith("\n") else f"{text}\n"


def _stdin_tests(entries: list, output_needed: bool, clean: bool) -> list[dict]:
    out = []
    for entry in entries:
        if not isinstance(entry, dict) or "input" not in entry or (output_needed and "output" not in entry):
            continue
        given, wanted = str(entry["input"]), str(entry.get("output", ""))
        if clean:  # generators leave quotes and commas behind
            given, wanted = given.rstrip(' \n",'), wanted.rstrip(' \n",')
        out.append({"input": _ended(given), "output": "" if clean and not wanted else _ended(wanted), "testtype": "stdin"})
    return out


def _blocks(text: str) -> list[dict]:
    """What stands before and after the one `Output:` in each part that `Input:` begins."""
    out = []
    for part in text.split("Input:"):
        given, mark, wanted = part.partition("Output:")
        if mark and "Output:" not in wanted:
            out.append({"input": f"{given.strip()}\n", "output": f"{wanted.strip()}\n", "testtype": "stdin"})
    return out


def parse_tests(text: str | None, stdin: bool, output_needed: bool = False, fix_quotes: bool = True) -> list[dict]:
    """Tests in generated text, as dicts with input, output and testtype; [] where nothing can be read.

    Fences around the text are dropped. Tests for standard input come as an array or in blocks of `Input:` and
    `Output:`; their texts end with a line feed. Others come as an array, as objects with input and output one after
    another, whatever they hold, or one object a line; numbers may be sums and powers, and those too large to be
    worked out stay as text. output_needed skips entries without an output; fix_quotes also reads Python literals.
    """
    if not text:
        return []
    bare, read = unfenced(text), tolerant if fix_quotes else strict
    array = read(bare) if bare.startswith("[") and bare.endswith("]") else None
    entries = array[0] if array and isinstance(array[0], list) else None
    if stdin:
        if entries is None:
            return [] if fix_quotes and bare[:1] + bare[-1:] == "[]" else _blocks(text)
        return _stdin_tests(entries, output_needed, fix_quotes)
    if entries is None and bare[:1] + bare[-1:] != "[]":
        entries = [x for x in objects(bare) if "input" in x and "output" in x] if fix_quotes or "'" not in bare else []
        if not entries:
            entries = [found[0] for line in bare.splitlines() if line.strip() and (found := read(line.strip()))]
    return [{**x, "testtype": "functional"} for x in entries or [] if isinstance(x, dict)]


def parse_tests_of(text: Column, stdin: Column, output_needed: bool = False, fix_quotes: bool = True) -> Column:
    """array<struct<input, output, testtype>>; inputs and outputs that aren't texts are JSON."""
    as_text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)

    @F.pandas_udf("array<struct<input:string,output:string,testtype:string>>")
    def run(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        rows = [parse_tests(t, bool(k), output_needed, fix_quotes) for t, k in zip(texts, kinds)]
        return pd.Series([[{"input": as_text(t.get("input")), "output": as_text(t.get("output")), "testtype": t["testtype"]} for t in r] for r in rows])

    return run(text, stdin)


def quotes_to_json_of(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else as_json(t) for t in texts], dtype=object)

    return run(text)
