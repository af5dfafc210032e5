"""Pairs of samples of a question and how alike they are."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from keyword import kwlist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codebleu import KEYWORD_WEIGHT, ORDER, OTHER_WEIGHT, SMOOTHING, features_of, shared_of
from ..session import ship

#: Samples of a question that are compared pair by pair; larger questions are cut into tiles of about so many samples.
PAIRS_LIMIT, TILE = 64, 1024
#: Programs of a question that one row takes: up to 496 pairs, so that a batch of such rows stays small.
PROGRAMS_LIMIT = 32
#: Cosines this near to the threshold are added up once more, in the order of the vectors' numbers.
MARGIN = 1e-9


def pairs(samples: DataFrame, value: str, group: str = "qid", pos: str = "pos") -> DataFrame:
    """(group, a, b, x, y): each two samples of a question once, a before b.

    The samples are never gathered by the driver: columns that take little of a file look small to a planner, however many rows they have.
    """
    left = samples.select(group, F.col(pos).alias("a"), F.col(value).alias("x"))
    right = samples.select(group, F.col(pos).alias("b"), F.col(value).alias("y"))
    return left.join(right.hint("merge"), group).filter("a < b")


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_pairs(samples: DataFrame, vector: str, group: str = "qid", pos: str = "pos") -> DataFrame:
    """(group, a, b, similarity); a vector of zeros is alike to none (0)."""
    normed = samples.withColumn("__n", F.sqrt(_dot(F.col(vector), F.col(vector)))).withColumn("__v", F.struct(F.col(vector).alias("v"), F.col("__n").alias("n")))
    both = pairs(normed, "__v", group, pos)
    return both.select(group, "a", "b", F.coalesce(F.try_divide(_dot(F.col("x.v"), F.col("y.v")), F.col("x.n") * F.col("y.n")), F.lit(0.0)).alias("similarity"))


def cosine_of(x: np.ndarray, y: np.ndarray) -> float:
    """The cosine as cosine_pairs() adds it up: number after number."""
    dot, own, other = (float(np.cumsum(v)[-1]) for v in (x * y, x * x, y * y))
    return dot / (np.sqrt(own) * np.sqrt(other))


def near_rows(x: np.ndarray, y: np.ndarray, threshold: float, same: bool = False, steps: Sequence[float] = (0.25, 0.5)) -> tuple[np.ndarray, np.ndarray, int]:
    """Places (i, j) of rows whose cosine is above the threshold, and how many whole products that took. With `same`, x and y
    are the same rows: only places with i < j.

    Of unit vectors the first numbers are multiplied first: the rest adds no more than the product of the lengths of the
    rests (Cauchy and Schwarz). Rows that reach the threshold with nobody are left out of the next step. Of what is left
    the whole products are taken; those near the threshold are added up once more as cosine_of() does.
    """
    a, b = (v / np.sqrt((v * v).sum(axis=1, keepdims=True)) for v in (x, y))
    rows, cols = np.arange(len(x)), np.arange(len(y))
    for share in steps:
        k = int(share * x.shape[1])
        if not (k and rows.size and cols.size):
            continue
        p, q = a[rows], b[cols]
        rest = [np.sqrt(np.maximum(0.0, (v[:, k:] ** 2).sum(axis=1))) for v in (p, q)]
        open_ = p[:, :k] @ q[:, :k].T + np.outer(*rest) > threshold - MARGIN
        if same:
            open_ &= rows[:, None] < cols
        rows, cols = rows[open_.any(axis=1)], cols[open_.any(axis=0)]
    cosine = a[rows] @ b[cols].T
    near = cosine > threshold - MARGIN
    i, j = np.nonzero(near & (rows[:, None] < cols) if same else near)
    sure = cosine[i, j] > threshold + MARGIN
    for k in np.flatnonzero(~sure):
        sure[k] = cosine_of(x[rows[i[k]]], y[cols[j[k]]]) > threshold
    return rows[i[sure]], cols[j[sure]], int(rows.size * cols.size)


#: Finds links between two tiles: (values, values, positions, positions, same tile) -> places (i, j).
Find = Callable[[pa.Array, pa.Array, np.ndarray, np.ndarray, bool], tuple[np.ndarray, np.ndarray]]


def _tiled(rows: DataFrame, group: str, pos: str, find: Find, tile: int, alike: Column | None = None) -> DataFrame:
    """(group, a, b), a before b: what `find` finds among the samples (group, pos, v) of a question, two tiles at a time.

    Samples are dealt into tiles of about `tile` by a hash of their position; each two tiles of a question meet in one
    call, and each with itself. alike: only samples with equal values of it meet. Positions are whole numbers.
    """
    ship(rows.sparkSession)
    sizes = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles")).select(F.col(group).alias("__q"), "tiles")
    met = rows.join(sizes, F.col(group).eqNullSafe(F.col("__q"))).select(F.col(group).alias("q"), F.struct(F.col(pos).cast("long").alias("p"), "v").alias("r"), "tiles", (F.lit(0) if alike is None else alike).alias("d"))
    dealt = met.groupBy("q", "d", F.pmod(F.xxhash64("r.p"), F.col("tiles")).alias("own"), "tiles").agg(F.collect_list("r").alias("rows"))
    meets = dealt.withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    meets = meets.select("q", "d", F.least("own", "w").alias("s"), F.greatest("own", "w").alias("t"), "rows")

    def run(key: tuple, part: pa.Table) -> pa.Table:
        tiles, same = [t.values for t in part.column("rows")], key[2].as_py() == key[3].as_py()
        low = high = np.zeros(0, np.int64)
        if len(tiles) == (1 if same else 2):  # else the other tile has no rows
            place = [t.field("p").to_numpy() for t in tiles]
            i, j = find(tiles[0].field("v"), tiles[-1].field("v"), place[0], place[-1], same)
            low, high = np.minimum(place[0][i], place[-1][j]), np.maximum(place[0][i], place[-1][j])
        return pa.table({"q": pa.array([key[0].as_py()] * len(low), part.schema.field("q").type), "a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64())})

    at = rows.schema[pos].dataType
    found = meets.groupBy("q", "d", "s", "t").applyInArrow(run, f"q {rows.schema[group].dataType.simpleString()}, a long, b long")
    return found.select(F.col("q").alias(group), F.col("a").cast(at).alias("a"), F.col("b").cast(at).alias("b"))


def cosine_links(samples: DataFrame, vector: str, threshold: float, group: str = "qid", pos: str = "pos", limit: int = PAIRS_LIMIT, tile: int = TILE) -> DataFrame:
    """(group, a, b): the pairs above a threshold of at least 0, as above(cosine_pairs()) gives them, a before b.

    Questions of up to `limit` samples make their pairs. Of larger ones two tiles of samples at a time meet in a task,
    which multiplies them as matrices and leaves out rows that a part of their numbers shows to be far from all others.
    Vectors that are null, of zeros, or hold a null or a number that isn't finite are near none there, nor are those of
    different lengths. Positions are whole numbers, one sample each; a question without an id has no pairs.
    """
    if threshold < 0:
        return above(cosine_pairs(samples, vector, group, pos), threshold).select(group, "a", "b")
    sizes = samples.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    large = sizes.filter((F.col("__n") > limit) & F.col(group).isNotNull()).select(group)
    if large.isEmpty():
        return above(cosine_pairs(samples, vector, group, pos), threshold).select(group, "a", "b")
    small = above(cosine_pairs(samples.join(large, group, "left_anti"), vector, group, pos), threshold).select(group, "a", "b")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    rows = samples.join(large, group, "left_semi").select(group, pos, F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & ~bad)

    def find(x: pa.Array, y: pa.Array, p: np.ndarray, q: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        return near_rows(*(v.flatten().to_numpy().reshape(len(v), -1) for v in (x, y)), threshold, same)[:2]

    return small.unionByName(_tiled(rows, group, pos, find, tile, F.size("v")))


def links_by(samples: DataFrame, value: str, similarity: Callable[[list, list], np.ndarray], threshold: float, symmetric: bool = False, group: str = "qid", pos: str = "pos", tile: int = TILE) -> DataFrame:
    """(group, a, b): pairs of samples of a question that a function of one's own finds above a threshold, a before b.

    similarity takes two lists of values, null ones as None, and gives a matrix: row i and column j say how like the
    i-th of the first is to the j-th of the second, where the first stands before the second in its question. A function
    that is the same both ways is called once for each two tiles, any other twice. It runs where Spark runs it, so what
    it needs must be there or come with it. NaN is not above a threshold.
    """

    def find(x: pa.Array, y: pa.Array, p: np.ndarray, q: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        one, other = x.to_pylist(), y.to_pylist()
        found = np.asarray(similarity(one, other), np.float64).reshape(len(one), len(other))
        if not symmetric:
            back = np.asarray(similarity(other, one), np.float64).reshape(len(other), len(one))
            found = np.where(p[:, None] < q, found, back.T)
        return np.nonzero((found > threshold) & (p[:, None] < q if same else True))

    return _tiled(samples.select(group, pos, F.col(value).alias("v")), group, pos, find, tile)


def matrix(similar: DataFrame, samples: DataFrame, group: str = "qid", pos: str = "pos") -> DataFrame:
    """Both halves and a diagonal of ones, as rows (group, a, b, similarity)."""
    mirrored = similar.select(group, F.col("b").alias("a"), F.col("a").alias("b"), "similarity")
    own = samples.select(group, F.col(pos).alias("a"), F.col(pos).alias("b"), F.lit(1.0).alias("similarity"))
    return similar.select(group, "a", "b", "similarity").unionByName(mirrored).unionByName(own)


def above(similar: DataFrame, threshold: float) -> DataFrame:
    """Pairs strictly above the threshold."""
    return similar.filter(F.col("similarity") > threshold)


def tokens(code: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(code, r"\s+"), lambda t: t != "")


def ngrams(words: Column, n: int) -> Column:
    """Texts of n words in a row. The words are a lambda's argument, so that they are made once a row and not for every
    n-gram, and are taken one by one: a slice would copy all of them for every n-gram."""

    def of(w: Column) -> Column:
        last = F.size(w) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(words), of), 0)


def ngram_precision_pairs(samples: DataFrame, code: str, n: int = 1, group: str = "qid", pos: str = "pos", limit: int = PAIRS_LIMIT) -> DataFrame:
    """(group, a, b, similarity): the clipped n-gram precision of each text against the other, averaged over both directions.

    Counts of n-grams meet by equality, so only shared n-grams make rows; a text without n-grams scores 0. Where no
    question has more than `limit` samples, texts are shuffled once, by question: the samples that have an n-gram are
    gathered and make their pairs; all have a null one, whose pairs carry the totals. Else counts meet by joins.
    """
    if (samples.groupBy(group).count().agg(F.max("count")).first()[0] or 0) <= limit:
        return _precision_by_question(samples, code, n, group, pos)
    grams = samples.select(group, F.col(pos).alias("p"), F.explode(ngrams(tokens(F.col(code)), n)).alias("g")).groupBy(group, "p", "g").agg(F.count(F.lit(1)).alias("c"))
    sizes = grams.groupBy(group, "p").agg(F.sum("c").alias("t"))
    left, right = grams.select(group, F.col("p").alias("a"), "g", F.col("c").alias("ca")), grams.select(group, F.col("p").alias("b"), "g", F.col("c").alias("cb"))
    shared = left.join(right, [group, "g"]).filter("a < b").groupBy(group, "a", "b").agg(F.sum(F.least("ca", "cb")).alias("m"))
    every = pairs(samples, pos, group, pos).select(group, "a", "b")
    met = every.join(shared, [group, "a", "b"], "left").join(sizes.select(group, F.col("p").alias("a"), F.col("t").alias("ta")), [group, "a"], "left")
    met = met.join(sizes.select(group, F.col("p").alias("b"), F.col("t").alias("tb")), [group, "b"], "left")
    return met.select(group, "a", "b", _mean_precision("m", "ta", "tb"))


def _mean_precision(m: str, ta: str, tb: str) -> Column:
    matched = F.coalesce(F.col(m), F.lit(0)).cast("double")
    share = lambda t: F.coalesce(F.try_divide(matched, F.col(t).cast("double")), F.lit(0.0))
    return ((share(ta) + share(tb)) / 2).alias("similarity")


def _precision_by_question(samples: DataFrame, code: str, n: int, group: str, pos: str) -> DataFrame:
    """ngram_precision_pairs() of questions of few samples. Repeated rows of a sample make repeated pairs, with common counts."""
    rows = samples.filter(F.col(group).isNotNull() & F.col(pos).isNotNull()).select(group, F.col(pos).alias("p"), code).repartition(group)
    rows = rows.select(group, "p", ngrams(tokens(F.col(code)), n).alias("gs"))
    own = F.struct(F.lit(None).cast("string").alias("g"), F.size("gs").cast("long").alias("t"))
    rows = rows.select(group, "p", F.inline(F.array_append(F.transform("gs", lambda g: F.struct(g.alias("g"), F.lit(0).cast("long").alias("t"))), own)))
    counts = rows.groupBy(group, "p", "g").agg(F.count(F.lit(1)).alias("c"), F.sum("t").alias("t"))
    met = counts.groupBy(group, "g").agg(F.collect_list(F.struct("p", "c", "t")).alias("all")).filter(F.size("all") > 1)
    met = met.select(group, "g", "all", F.explode("all").alias("x"))
    met = met.select(group, "g", "x", F.explode(F.filter("all", lambda y: y["p"] > F.col("x.p"))).alias("y"))
    every = lambda c: F.max(F.when(F.col("g").isNull(), c))
    shared = F.sum(F.when(F.col("g").isNotNull(), F.least("x.c", "y.c")).otherwise(0)).alias("m")
    both = met.groupBy(group, F.col("x.p").alias("a"), F.col("y.p").alias("b")).agg(shared, every(F.col("x.t")).alias("ta"), every(F.col("y.t")).alias("tb"), every(F.col("x.c") * F.col("y.c")).alias("rows"))
    repeated = both.withColumn("r", F.explode(F.array_repeat(F.lit(True), F.col("rows").cast("int"))))
    return repeated.select(group, "a", "b", _mean_precision("m", "ta", "tb"))


def _parts(code: Column, n: int) -> Column:
    return F.transform(ngrams(code, n), lambda g: F.struct(F.lit(f"g{n}").alias("kind"), g.alias("k"), F.lit(1).alias("c")))


#: What CodeBLEU counts: n-grams, subtrees, flows, and words by their weight.
COUNTS = (*[f"g{n}" for n in range(1, ORDER + 1)], "t", "f", "w1")


def code_bleu_parts(samples: DataFrame, code: str, group: str = "qid", pos: str = "pos", limit: int = PROGRAMS_LIMIT) -> DataFrame:
    """(group, a, b, ngram, weighted, tree, flow): the four parts of CodeBLEU, each the mean of both directions, each pair once.

    A program is parsed once. Where a question has no more than `limit` samples, only texts are shuffled, by question, and a
    row of all its programs makes its pairs. In larger ones n-grams, subtrees and flows are rows with counts, which meet
    those of the question's other programs by equality. A null text, or one that is too deep to read, has 0 in every
    part; one that doesn't parse has no subtrees and flows. A question without an id has no pairs.
    """
    ship(samples.sparkSession)
    known = samples.filter(F.col(group).isNotNull() & F.col(pos).isNotNull())
    large = known.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select(group)
    if large.isEmpty():
        met = _shared_by_question(known, code, group, pos)
    else:
        met = _shared_by_question(known.join(large, group, "left_anti"), code, group, pos).unionByName(_shared_by_joins(known.join(large, group, "left_semi"), code, group, pos))
    both = lambda part: (part("a", "b") + part("b", "a")) / 2
    share = lambda kind: lambda one, other: F.coalesce(F.try_divide(F.col(kind), F.col(f"{one}{kind}")), F.lit(0.0))
    return met.select(group, "a", "b", both(_ngram_match).alias("ngram"), both(_weighted_match).alias("weighted"), both(share("t")).alias("tree"), both(share("f")).alias("flow"))


def _shared_by_question(samples: DataFrame, code: str, group: str, pos: str) -> DataFrame:
    """(group, a, b, COUNTS of both, of a and of b) for questions of few samples, of which each is one row.

    Texts are dealt into a fixed number of parts: adaptive execution would merge what is little to read, but long to parse.
    """
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = samples.select(group, pos, code).repartition(parts, group).groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(code).alias("c")))).alias("all"))
    rows = rows.select(group, F.array_distinct("all.p").alias("at"), "all")
    place = F.transform("all.p", lambda p: F.array_position("at", p).cast("int") - 1)
    rows = rows.select(group, "at", place.alias("place"), F.col("all.c").alias("codes"))
    rows = rows.select(group, "at", shared_of(F.col("place"), F.col("codes")).alias("m")).select(group, "at", "m.totals", F.inline("m.pairs"))

    def counts(prefix: str, of: Callable[[str], Column]) -> list[Column]:
        made = {"g1": of("k1") + of("o1"), "w1": KEYWORD_WEIGHT * of("k1") + OTHER_WEIGHT * of("o1")}
        return [(made[c] if c in made else of(c)).cast("double").alias(f"{prefix}{c}") for c in COUNTS]

    own = lambda place: lambda c: F.get("totals", F.col(place))[c]
    return rows.select(group, F.get("at", F.col("i")).alias("a"), F.get("at", F.col("j")).alias("b"), *counts("", F.col), *counts("a", own("i")), *counts("b", own("j")))


def _shared_by_joins(samples: DataFrame, code: str, group: str, pos: str) -> DataFrame:
    """_shared_by_question() for questions of any size. All that the rows of programs are needed for reads one exchange
    of them, and no join is made by the driver."""
    read = samples.select(group, F.col(pos).alias("p"), tokens(F.col(code)).alias("t"), features_of(F.col(code)).alias("f"))
    read = read.select(group, "p", F.when(F.col("f.sound"), F.col("t")).otherwise(F.array().cast("array<string>")).alias("t"), F.col("f.found").alias("found"))
    rows = read.select(group, "p", F.explode(F.concat("found", *[_parts(F.col("t"), n) for n in range(1, ORDER + 1)])).alias("x")).select(group, "p", "x.*")
    rows = rows.filter("kind IS NOT NULL AND k IS NOT NULL").groupBy(group, "p", "kind", "k").agg(F.sum("c").alias("c"))  # as joins ask, so that all sides are alike
    weight = F.when((F.col("kind") == "g1") & F.col("k").isin(kwlist), KEYWORD_WEIGHT).otherwise(F.when(F.col("kind") == "g1", OTHER_WEIGHT).otherwise(1.0))
    rows = rows.withColumn("w", weight * F.col("c")).repartition(group, "k")
    of = lambda value: [F.sum(F.when(F.col("kind") == k, value)).alias(k) for k in COUNTS[:-1]]
    weighed = lambda value: F.sum(F.when(F.col("kind") == "g1", value)).alias("w1")
    totals = rows.groupBy(group, "p").agg(*of(F.col("c")), weighed(F.col("w")))
    left, right = (rows.select(group, "kind", "k", F.col("p").alias(n), F.col("c").alias(f"c{n}"), F.col("w").alias(f"w{n}")) for n in "ab")
    shared = left.join(right.hint("merge"), [group, "kind", "k"]).filter("a < b").groupBy(group, "a", "b").agg(*of(F.least("ca", "cb")), weighed(F.least("wa", "wb")))
    met = pairs(samples, pos, group, pos).select(group, "a", "b").join(shared.hint("merge"), [group, "a", "b"], "left")
    for n in "ab":
        met = met.join(totals.select(group, F.col("p").alias(n), *[F.col(c).alias(f"{n}{c}") for c in COUNTS]).hint("merge"), [group, n], "left")
    return met.select(group, "a", "b", *[F.coalesce(f"{n}{c}", F.lit(0)).cast("double").alias(f"{n}{c}") for n in ("", "a", "b") for c in COUNTS])


def _mean_share(reference: str, candidate: str, shares: Sequence[tuple[Column, Column]]) -> Column:
    """The geometric mean of (matched, all) with a penalty for brevity; 0 if no single token matches."""
    logs = [F.log(F.when(m > 0, m).otherwise(SMOOTHING) / F.greatest(t, F.when(m > 0, SMOOTHING).otherwise(1.0))) for m, t in shares]
    total, size = sum(logs[1:], logs[0]) / len(logs), F.col(f"{candidate}g1")
    brief = F.least(F.lit(1.0), F.exp(1 - F.try_divide(F.col(f"{reference}g1"), size)))
    return F.when((size > 0) & (shares[0][0] > 0), brief * F.exp(total)).otherwise(0.0)


def _ngram_match(reference: str, candidate: str) -> Column:
    return _mean_share(reference, candidate, [(F.col(f"g{n}"), F.greatest(F.lit(1.0), F.col(f"{candidate}g{n}"))) for n in range(1, ORDER + 1)])


def _weighted_match(reference: str, candidate: str) -> Column:
    names = ["w1", *[f"g{n}" for n in range(2, ORDER + 1)]]
    return _mean_share(reference, candidate, [(F.col(n), F.when(F.col(f"{reference}{n}") > 0, F.col(f"{reference}{n}")).otherwise(1.0)) for n in names])


def code_bleu_pairs(samples: DataFrame, code: str, group: str = "qid", pos: str = "pos") -> DataFrame:
    """(group, a, b, similarity): CodeBLEU, the mean of code_bleu_parts(), averaged over both directions, each pair once."""
    return code_bleu_parts(samples, code, group, pos).select(group, "a", "b", ((F.col("ngram") + F.col("weighted") + F.col("tree") + F.col("flow")) / 4).alias("similarity"))


#: Verdicts of a pair: contradiction, neutral, entailment.
CONTRADICTION, NEUTRAL, ENTAILMENT = 0, 1, 2


def verdict_of(probabilities: Column) -> Column:
    """The likeliest of three verdicts, the first of equal ones."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def entailment_score(probabilities: Column, mode: str = "strict") -> Column:
    """strict: P(entailment); exclude_neutral: P(e) / (P(e) + P(c)); half_neutral: P(e) + P(n) / 2."""
    c, n, e = (F.element_at(probabilities, i) for i in (1, 2, 3))
    modes = {"strict": e, "exclude_neutral": F.try_divide(e, e + c), "half_neutral": e + n / 2}
    if mode not in modes:
        raise ValueError(f"unknown mode {mode!r}")
    return modes[mode]


def entails(forth: Column, back: Column, strict: bool = True) -> Column:
    """strict: both directions entail; relaxed: neither contradicts and they aren't both neutral."""
    if strict:
        return (forth == ENTAILMENT) & (back == ENTAILMENT)
    return (forth != CONTRADICTION) & (back != CONTRADICTION) & ~((forth == NEUTRAL) & (back == NEUTRAL))


def parse_verdict(response: Column) -> Column:
    """A verdict from the first 30 characters of a response, in lower case; neutral if it names none."""
    head = F.left(F.lower(response), F.lit(30))
    return F.when(head.contains("entailment"), ENTAILMENT).when(head.contains("neutral"), NEUTRAL).when(head.contains("contradiction"), CONTRADICTION).otherwise(NEUTRAL)


# The wording of the prompt, on which the keys of cached responses depend.
def verdict_prompt(question: Column, first: Column, second: Column) -> Column:
    return F.concat(
        F.lit('We are evaluating answers to the question "'), question, F.lit('"\nHere are two possible answers:\nPossible Answer 1: '), first, F.lit("\nPossible Answer 2: "), second,
        F.lit("\nDoes Possible Answer 1 semantically entail Possible Answer 2? Respond only with entailment, contradiction, or neutral.\nResponse:"),
    )


def cached_verdicts(asked: DataFrame, cache: DataFrame, cache_only: bool = False) -> DataFrame:
    """asked (prompt) with `verdict` from cache (key, response), keyed by md5; a prompt that isn't cached
    has a null verdict, or fails the query if `cache_only`."""
    keyed = asked.withColumn("key", F.md5("prompt"))
    met = keyed.join(cache.dropDuplicates(["key"]), "key", "left")
    verdict = F.when(F.col("response").isNotNull(), parse_verdict(F.col("response")))
    if cache_only:
        verdict = F.when(F.col("response").isNull(), F.raise_error(F.lit("no cached response for a prompt")).cast("int")).otherwise(verdict)
    return met.select(*asked.columns, "key", verdict.alias("verdict"))
