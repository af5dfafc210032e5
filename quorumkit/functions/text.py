"""Column functions on generated text: code blocks, values, tests, feedback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings that mark a program that reads standard input.
STDIN_MARKS = ("sys.stdin", "input(", "__name__ == \"__main__\"", "if __name__")
#: White space that strip() removes, as a Java character class.
BLANK = r"[\s\x1c-\x1f\x85   -     　]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", "")


def _longest(found: Column) -> Column:
    """The longest of some texts, the first of equal ones."""
    return F.aggregate(found, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


#: Patterns of fenced blocks, in the order in which they are tried.
FENCES = (r"(?s)```python\s*\n(.*?)```", r"(?s)```(?:.*?)\n(.*?)```", r"(?s)<code>(.*?)</code>")


def code_block(text: Column) -> Column:
    """The longest fenced block marked python, else the longest of any mark, else the longest <code> element, else the text; stripped."""
    kinds = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in FENCES]
    out = text
    for found in reversed(kinds):
        out = F.when(F.size(found) > 0, _longest(found)).otherwise(out)
    return strip(out)


def first_fence(text: Column) -> Column:
    """What stands in the first fence marked python, else between the first and last fence, else the text; stripped."""
    t = strip(text)
    python, fence = F.instr(t, "```python"), F.instr(t, "```")
    start = python + 9
    after = F.substring(t, start, F.length(t))
    close = F.instr(after, "```")
    last = F.length(t) - F.instr(F.reverse(t), "```") - 1  # position of the last fence
    inside = F.substring(t, fence + 3, last - fence - 3)
    return F.when((python > 0) & (close > 0), strip(F.substring(after, F.lit(1), close - 1))).when((python == 0) & (fence > 0) & (last > fence + 2), strip(inside)).otherwise(t)


def value_json(text: Column) -> Column:
    """A value as JSON text: arrays and objects as they are, then whole numbers, then decimals, else a string without outer quotes."""
    t = strip(text)
    nested = F.when(t.rlike(r"\A[\[{]"), F.to_json(F.try_parse_json(t)))
    whole = F.when(t.rlike(r"\A[+-]?\d+(?:_\d+)*\z"), F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[_+]", ""), r"\A(-?)0+(?=\d)", "$1"), r"\A-0\z", "0"))
    number = F.when(t.rlike(r"\A[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"), F.to_json(F.to_variant_object(F.array(F.expr("0D") + t.try_cast("double")))))
    plain = F.regexp_replace(t, r"\A[\"']+|[\"']+\z", "")
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), F.lit('"'))
    return F.coalesce(nested, whole, F.regexp_replace(number, r"\A\[|\]\z", ""), quoted)


def functional_inputs(text: Column) -> Column:
    """The arguments of an extracted test, as JSON texts: `name=value` parts between commas, else one value per line."""
    parts = F.filter(F.transform(F.split(text, ","), strip), lambda p: p.contains("="))
    named = F.transform(parts, lambda p: value_json(F.regexp_replace(p, r"(?s)\A[^=]*=", "")))
    lines = F.transform(F.filter(F.transform(F.split(text, "\n"), strip), lambda p: p != ""), value_json)
    return F.when(text.contains("="), named).otherwise(lines)


def stdin_output(text: Column) -> Column:
    """An expected output, stripped, without a trailing dash."""
    t = strip(text)
    return F.when(t.endswith("-"), F.regexp_replace(F.regexp_replace(t, r"-\z", ""), rf"{BLANK}+\z", "")).otherwise(t)


def signature_name(text: Column) -> Column:
    """The last word before the first parenthesis."""
    return F.element_at(F.split(strip(F.split_part(text, F.lit("("), F.lit(1))), r"\s+"), -1)


def code_type(text: Column) -> Column:
    """'stdin' if the code reads standard input, else 'functional'."""
    found = F.lit(False)
    for mark in STDIN_MARKS:
        found = found | text.contains(mark)
    return F.when(found, "stdin").otherwise("functional")


def prompt_key(text: Column) -> Column:
    return F.md5(text)


def file_name(text: Column, default: str = "all") -> Column:
    """Safe for file names; the default where null."""
    return F.coalesce(F.translate(text, "/\\", "__"), F.lit(default))


def alias(name: Column, names: dict[str, str]) -> Column:
    """A short name's long one; a name without one stays."""
    if not names:
        return name
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, name), name)


def temperature(base: float, index: Column) -> Column:
    """The temperature of a round: 0.01 more each."""
    return F.lit(base) + F.lit(0.01) * index


def has_test_type(tests_json: Column, kind: str) -> Column:
    tests = F.from_json(tests_json, "array<struct<testtype:string>>")
    return F.coalesce(F.exists(tests, lambda t: t["testtype"] == kind), F.lit(False))


# The wording and layout of what follows, on which digests of prompts depend.
def debug_feedback(prompt: Column, code: Column, tests: Column) -> Column:
    """The problem, the code and each test's outcome; details for failed ones. tests: array of struct(passed, message, input, output)."""
    one = lambda t, i: F.concat(
        F.lit("\nTest "), (i + 1).cast("string"), F.lit(": "),
        F.when(t["passed"], "✓ PASS\n").otherwise(
            F.concat(
                F.lit("✗ FAIL\nInput: "), F.coalesce(t["input"], F.lit("N/A")), F.lit("\nExpected: "), F.coalesce(t["output"], F.lit("N/A")),
                F.lit("\nError: "), F.coalesce(t["message"], F.lit("None")), F.lit("\n"),
            )
        ),
    )
    closing = "\n# Task\nAnalyze why your code failed and provide a corrected version. Focus on fixing the specific test failures shown above."
    return F.concat(
        F.lit("# Problem\n"), prompt, F.lit("\n\n# Your Previous Code\n```python\n"), code, F.lit("\n```\n\n# Test Results\n"),
        F.array_join(F.transform(tests, one), ""), F.lit(closing),
    )


# The wording and layout of what follows, on which digests of prompts depend.
def test_feedback(index: Column, given: Column, expected: Column, actual: Column, passed: Column, message: Column, seconds: Column) -> Column:
    """One test's outcome as labelled lines."""
    failed = F.concat(F.lit("Status: FAILED ✗\n"), F.when(F.length(message) > 0, F.concat(F.lit("Error: "), message, F.lit("\n"))).otherwise(""))
    time = F.when(seconds.isNotNull(), F.format_string("Time: %.3fs\n", seconds)).otherwise("")
    return F.concat(
        F.lit("[Test "), index.cast("string"), F.lit("]\nInput: "), given, F.lit("\nExpected: "), expected, F.lit("\nActual: "), actual, F.lit("\n"),
        F.when(passed, "Status: PASSED ✓\n").otherwise(failed), time,
    )


# The wording and layout of what follows, on which digests of prompts depend.
def debug_case(given: Column, expected: Column, actual: Column, passed: Column, message: Column, seconds: Column, stdin: Column) -> Column:
    """One test case between rules, for debugging."""
    rule = "-" * 50 + "\n"
    head = F.when(stdin, F.concat(F.lit("Input (stdin):\n"), given, F.lit("\nExpected Output (stdout):\n"), expected)).otherwise(F.concat(F.lit("Input: "), given, F.lit("\nExpected Output: "), expected))
    return F.concat(
        F.lit("\n" + rule), head, F.lit("\nActual Output: "), actual, F.lit("\nStatus: "), F.when(passed, "PASS").otherwise("FAIL"), F.format_string("\nTime: %.3fs\n", seconds),
        F.when(passed, "").otherwise(F.concat(F.lit("Error: "), F.coalesce(message, F.lit("None")), F.lit("\n"))), F.lit(rule),
    )


# The wording and layout of what follows, on which digests of prompts depend.
def results_summary(tests: Column) -> Column:
    """Passed of all, and the failed ones' messages. tests: array of struct(passed, message)."""
    rule = "=" * 50
    passed = F.size(F.filter(tests, lambda t: t["passed"]))
    lines = F.array_join(
        F.transform(F.filter(F.transform(tests, lambda t, i: F.struct(i.alias("i"), t["passed"].alias("passed"), t["message"].alias("message"))), lambda t: ~t["passed"]), lambda t: F.concat(F.lit("  - Test "), t["i"].cast("string"), F.lit(": "), F.coalesce(t["message"], F.lit("None")), F.lit("\n"))), ""
    )
    return F.concat(
        F.lit(f"\n{rule}\nTest Results Summary\n{rule}\nPassed: "), passed.cast("string"), F.lit("/"), F.size(tests).cast("string"), F.lit("\n"),
        F.when(passed < F.size(tests), F.concat(F.lit("\nFailed tests:\n"), lines)).otherwise(""), F.lit(f"{rule}\n"),
    )
