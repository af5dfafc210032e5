"""Likeness of two programs by the published CodeBLEU recipe: n-grams, keyword-weighted n-grams, syntax, data flow.

Syntax and data flow are read from Python's own syntax tree; implementations on other parsers may differ
in these two parts.
"""

from __future__ import annotations

import ast
import keyword
import re
from collections import Counter
from collections.abc import Iterable
from hashlib import md5
from math import exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ORDER, SMOOTHING, KEYWORD_WEIGHT, OTHER_WEIGHT = 4, 0.1, 1.0, 0.2


def _grams(tokens: list[str], n: int) -> Counter:
    return Counter(zip(*(tokens[i:] for i in range(n))))


def _score(reference: list[str], candidate: list[str], shares: list[tuple[float, float]]) -> float:
    """The geometric mean of shares (matched, all) with a penalty for brevity; 0 if no single token matches."""
    if not candidate or not shares[0][0]:
        return 0.0
    mean = sum(log((m or SMOOTHING) / max(t, SMOOTHING if m else 1.0)) for m, t in shares) / len(shares)
    return min(1.0, exp(1 - len(reference) / len(candidate))) * exp(mean)


def ngram_match(reference: list[str], candidate: list[str]) -> float:
    """BLEU: clipped precision of the candidate's n-grams."""
    shares = []
    for n in range(1, ORDER + 1):
        have, want = _grams(candidate, n), _grams(reference, n)
        shares.append((float((have & want).total()), float(max(1, have.total()))))
    return _score(reference, candidate, shares)


def weighted_match(reference: list[str], candidate: list[str]) -> float:
    """Clipped recall of the reference's n-grams, single tokens weighted by whether they are keywords."""
    weight = lambda g: KEYWORD_WEIGHT if keyword.iskeyword(g[0]) else OTHER_WEIGHT
    shares = []
    for n in range(1, ORDER + 1):
        have, want = _grams(candidate, n), _grams(reference, n)
        w = weight if n == 1 else lambda g: 1.0
        shares.append((sum(w(g) * c for g, c in (have & want).items()), sum(w(g) * c for g, c in want.items()) or 1.0))
    return _score(reference, candidate, shares)


def _parsed(code: str) -> ast.AST | None:
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _subtrees(tree: ast.AST | None) -> Counter:
    """The shapes of all inner nodes: node types only, no names or values."""
    found: Counter = Counter()

    def shape(node: ast.AST) -> str:
        parts = [shape(x) for x in ast.iter_child_nodes(node) if not isinstance(x, (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop))]
        text = f"({type(node).__name__}{' ' if parts else ''}{' '.join(parts)})"
        if parts:
            found[text] += 1
        return text

    if tree is not None:
        shape(tree)
    return found


def _flows(tree: ast.AST | None) -> Counter:
    """(variable, where its value comes from) of assignments, loops and arguments; names numbered by first use."""
    found: Counter = Counter()
    if tree is None:
        return found
    numbers: dict[str, int] = {}
    number = lambda name: numbers.setdefault(name, len(numbers))
    names = lambda node: [x.id for x in ast.walk(node) if isinstance(x, ast.Name)]
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign):
            pairs = [(t, node.value) for t in node.targets]
        elif isinstance(node, (ast.AugAssign, ast.AnnAssign, ast.NamedExpr)) and node.value is not None:
            pairs = [(node.target, node.value)]
        elif isinstance(node, (ast.For, ast.comprehension)):
            pairs = [(node.target, node.iter)]
        else:
            continue
        for target, value in pairs:
            sources = [number(s) for s in names(value)]
            for t in names(target):
                found[number(t), tuple(sources)] += 1
    return found


def _share(reference: Counter, candidate: Counter) -> float:
    return (reference & candidate).total() / reference.total() if reference else 0.0


def code_bleu(reference: str, candidate: str) -> float:
    """The mean of the four parts; 0.0 for anything that fails."""
    try:
        a, b = reference.split(), candidate.split()
        x, y = _parsed(reference), _parsed(candidate)
        return (ngram_match(a, b) + weighted_match(a, b) + _share(_subtrees(x), _subtrees(y)) + _share(_flows(x), _flows(y))) / 4
    except (RecursionError, MemoryError, OverflowError):
        return 0.0


def both_ways(first: str | None, second: str | None) -> float:
    if first is None or second is None:
        return 0.0
    return (code_bleu(first, second) + code_bleu(second, first)) / 2


def shapes(code: str | None) -> tuple[Counter, Counter] | None:
    """Subtrees and flows of a program; None if it can't be read."""
    if code is None:
        return None
    tree = _parsed(code)
    try:
        return _subtrees(tree), _flows(tree)
    except (RecursionError, MemoryError, OverflowError):
        return None


def features(code: str | None) -> tuple[bool, list[dict]]:
    """Whether a program can be read, and its subtrees ('t') and flows ('f') with their counts. Shapes go by their MD5."""
    known = shapes(code)
    if known is None:
        return False, []
    return True, [{"kind": kind, "k": md5(repr(k).encode()).hexdigest(), "c": c} for kind, found in zip("tf", known) for k, c in found.items()]


def features_of(code: Column) -> Column:
    """struct<sound, found>: features() of each program, which is parsed once."""

    @F.pandas_udf("sound boolean, found array<struct<kind:string,k:string,c:int>>")
    def run(codes: pd.Series) -> pd.DataFrame:
        made = [features(c) for c in codes]
        return pd.DataFrame({"sound": [x for x, _ in made], "found": pd.Series([y for _, y in made], dtype=object)})

    return run(code)


#: What programs may share: words that are keywords and others, n-grams of 2 to 4 words, subtrees, flows. Words are split as Spark's \\s does.
KINDS = ("k1", "o1", *[f"g{n}" for n in range(2, ORDER + 1)], "t", "f")
WORDS = re.compile("[^ \t\n\x0b\f\r]+")
#: Different items of a question that are compared at once.
ITEMS = 1 << 15


def counted(codes: Iterable[str | None]) -> Counter:
    """(kind, item) of programs with their counts, kinds by their place in KINDS; a program that can't be read has none."""
    out: Counter = Counter()
    for code in codes:
        known = shapes(code)
        if known is None:
            continue
        words = WORDS.findall(code)
        out.update((0 if keyword.iskeyword(w) else 1, w) for w in words)
        for n in range(2, ORDER + 1):
            out.update((n, g) for g in zip(*(words[i:] for i in range(n))))
        for kind, found in zip((ORDER + 1, ORDER + 2), known):
            for k, c in found.items():
                out[kind, k] += c
    return out


def shared_counts(samples: list[Counter]) -> tuple[np.ndarray, np.ndarray]:
    """How many items of each kind each sample has, and how many each two share (in the order of np.triu_indices)."""
    n, places = len(samples), {}
    for s in samples:
        for k in s:
            places.setdefault(k, len(places))
    kinds = np.fromiter((k for k, _ in places), np.int64, len(places))
    row = np.repeat(np.arange(n), [len(s) for s in samples])
    at = np.fromiter((places[k] for s in samples for k in s), np.int64, row.size)
    count = np.fromiter((c for s in samples for c in s.values()), np.float64, row.size)
    totals, shared = np.zeros((n, len(KINDS))), np.zeros((n * (n - 1) // 2, len(KINDS)))
    for lo in range(0, len(places), ITEMS):
        own = slice(None) if len(places) <= ITEMS else (at >= lo) & (at < lo + ITEMS)
        here = kinds[lo : lo + ITEMS]
        table, of = np.zeros((n, here.size)), np.zeros((here.size, len(KINDS)))
        table[row[own], at[own] - lo], of[np.arange(here.size), here] = count[own], 1.0
        totals += table @ of
        end = 0
        for i in range(n - 1):
            begin, end = end, end + n - 1 - i
            shared[begin:end] += np.minimum(table[i], table[i + 1 :]) @ of
    return totals, shared


def shared_of(place: Column, code: Column) -> Column:
    """struct<totals, pairs> of the programs of a question: what each place has, and what each two places i < j share.

    Programs that have the same place are one sample with the counts of all, and its pairs are repeated for each.
    """
    counts = ", ".join(f"{k}: int" for k in KINDS)

    @F.arrow_udf(f"struct<totals: array<struct<{counts}>>, pairs: array<struct<i: int, j: int, {counts}>>>")
    def run(places: pa.Array, codes: pa.Array) -> pa.Array:
        totals, pairs, sizes = [], [], []
        for own, texts in zip(places.to_pylist(), codes.to_pylist()):
            n = max(own, default=-1) + 1
            samples: list[list] = [[] for _ in range(n)]
            for p, text in zip(own, texts):
                samples[p].append(text)
            have, shared = shared_counts([counted(x) for x in samples])
            i, j = np.triu_indices(n, 1)
            rows = np.fromiter(map(len, samples), np.int64, n)
            found = np.column_stack((i, j, shared)).astype(np.int32).repeat(rows[i] * rows[j], axis=0)
            totals.append(have.astype(np.int32))
            pairs.append(found)
            sizes.append((n, len(found)))

        def lists(parts: list[np.ndarray], names: tuple[str, ...], ends: np.ndarray) -> pa.Array:
            flat = np.concatenate(parts) if parts else np.zeros((0, len(names)), np.int32)
            values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(len(names))], names)
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), values)

        ends = np.cumsum(np.array(sizes, np.int64).reshape(-1, 2), axis=0)
        both = [lists(totals, KINDS, ends[:, 0]), lists(pairs, ("i", "j", *KINDS), ends[:, 1])]
        return pa.StructArray.from_arrays(both, ["totals", "pairs"])

    return run(place, code)
