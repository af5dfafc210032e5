"""Toxicity by gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import arrow_rows, settle

#: Most labelled rows that words and trees are learned from; words learned from them.
SAMPLE, LEARNED = 20_000, 300
#: Lengths of stems; least number of toxic texts with a learned word, least likelihood ratio, and least
#: share of toxic ones among the texts that hold it.
STEMS, LEAST_TEXTS, LEAST_G, LEAST_SHARE = (4, 5, 6, 7), 8, 25.0, 0.5
#: Rows of an Arrow batch of texts.
ARROW_ROWS = 500
#: Trees, their depth, learning rate, bins of a feature, least rows of a leaf.
TREES, DEPTH, RATE, BINS, LEAF = 80, 3, 0.15, 64, 10
PRIOR = 2.0
#: Parts of the labelled rows, each scored for calibration by trees that haven't seen it.
FOLDS = 4
#: Characters between an insult and a pronoun that count as near.
NEAR_CHARS = 30

# Common insults and pronouns of address in English, German, French and Spanish.
INSULTS = """
idiot moron stupid dumb fool loser clown trash garbage scum pathetic worthless disgusting useless imbecile cretin jerk
bastard bitch asshole shit fuck fucking crap freak creep coward liar pig rat vermin filth filthy ugly fat disgrace
dumbass dickhead retard retarded whore slut psycho lunatic weirdo hate kill
idioten dumm dummkopf trottel depp arschloch scheisse scheiße mistkerl drecksau wichser abschaum versager ekelhaft wertlos
imbécile crétin connard salaud salope merde débile abruti bouffon ordure minable dégoûtant
idiota estúpido estúpida imbécil tonto basura escoria inútil payaso perdedor asqueroso mierda cabrón gilipollas pendejo
""".split()
PRONOUNS = """
you your yours yourself u ur
du dich dir dein deine ihr euch
tu te toi ton tes vous votre vos
usted ustedes ti tus vosotros
""".split()
#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$€", "oieastase")

FEATURES = (
    "insults insult_kinds insult_density learned learned_density disguised near_share near address_density "
    "upper_share caps_words marks other_marks elongated inner_marks digits repeated log_words"
).split()
SPACED = re.compile(r"(?<!\w)\w(?:[.\-_*]\w){2,}(?!\w)")


def crc_fold(id_col: str) -> Column:
    """crc32 of the id as text, mod 5; 0 is held out."""
    return F.crc32(F.col(id_col).cast("string")) % 5


class Featurizer:
    """Dense features of texts; `learned` are further words and stems that count like insults, in features of their own."""

    def __init__(self, learned: list[str] = ()) -> None:
        self.words = ahocorasick.Automaton()
        stems = [w[:-1] for w in learned if w.endswith("*")]
        for kind, words in ((2, [w for w in learned if not w.endswith("*")]), (3, stems), (1, PRONOUNS), (0, INSULTS)):
            for w in words:
                self.words.add_word(w, (kind, len(w), w))
        self.words.make_automaton()
        classes = np.zeros((256, 4))
        for b in range(256):
            c = chr(b)
            classes[b] = (b < 128 and c.isupper(), b < 128 and c.isalpha(), b < 128 and c.isdigit(), c in "!?")
        self.classes = classes
        self.other = np.array([float(chr(b) in "#$%&*@^~|<>=+_\\/") for b in range(256)])

    def _hits(self, text: str) -> list[tuple[int, int, str]]:
        """(kind, start, word) of whole words found, and of words that begin with a stem."""
        out = []
        for end, (kind, n, word) in self.words.iter(text):
            start = end - n + 1
            if (not start or not text[start - 1].isalnum()) and (kind == 3 or end + 1 == len(text) or not text[end + 1].isalnum()):
                out.append((kind, start, word))
        return out

    def one(self, text: str) -> list[float]:
        low = text.lower()
        words = text.split()
        n = max(1, len(words))
        hits = self._hits(low)
        insults = [(s, w) for k, s, w in hits if k == 0]
        address = np.array([s for k, s, _ in hits if k == 1])
        learned = len({s for k, s, _ in hits if k >= 2})
        plain = {s for s, _ in insults}
        bare = low.translate(DISGUISE)
        disguised = sum(k == 0 and s not in plain for k, s, _ in self._hits(bare)) if bare != low else 0
        disguised += sum(re.sub(r"[.\-_*]", "", m).translate(DISGUISE) in INSULT_SET for m in SPACED.findall(low))
        rude = {s for k, s, _ in hits if k != 1}
        near = sum(bool(np.abs(address - s).min() <= NEAR_CHARS) for s in rude) if address.size else 0
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        count = np.bincount(data, minlength=256)
        upper, letters, digits, marks = count @ self.classes
        size = max(1, data.size)
        letter = self.classes[data, 1] > 0
        blank = data <= 32
        inner = int((letter[:-2] & ~letter[1:-1] & ~blank[1:-1] & (data[1:-1] < 128) & letter[2:]).sum()) if data.size > 2 else 0
        same = data[1:] == data[:-1]
        long_ = int((same[2:] & same[1:-1] & same[:-2] & ~blank[3:]).sum()) if data.size > 3 else 0
        return [
            len(insults), len({w for _, w in insults}), len(insults) / n, learned, learned / n, disguised,
            near / max(1, len(rude)), near, address.size / n,
            upper / max(1, letters), sum(map(str.isupper, words)) / n, marks / n, float(count @ self.other) / size, long_ / size, inner / n, digits / size,
            1 - len(set(words)) / n, log(1 + len(words)),
        ]


INSULT_SET = frozenset(INSULTS)


def _pooled(blocks: list[tuple[float, float, float, float]]) -> list[tuple[float, ...]]:
    """Blocks (sum of values, weight, sum of raw scores, rows), joined where a mean isn't above the one before it."""
    out: list[tuple[float, ...]] = []
    for block in blocks:
        out.append(block)
        while len(out) > 1 and out[-2][0] * out[-1][1] >= out[-1][0] * out[-2][1]:
            last = out.pop()
            out[-1] = tuple(a + b for a, b in zip(out[-1], last))
    return out


class Trees:
    """Boosted trees for 0/1 labels on binned features, with a calibrated score."""

    def __init__(self) -> None:
        self.base, self.trees, self.xs, self.ys = 0.0, [], np.array([0.0]), np.array([0.0])

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> Trees:
        w = np.ones(len(y)) if w is None else w
        p = min(max(float((y * w).sum() / w.sum()), 1e-4), 1 - 1e-4)
        self.base, self.trees = log(p / (1 - p)), []
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        raw = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            g, h = w * (y - p), w * p * (1 - p)
            node, tree = np.zeros(len(y), np.int64), []
            for depth in range(DEPTH):
                many = 1 << depth
                best, choice = np.zeros(many), np.full((many, 2), -1)
                for f in range(x.shape[1]):
                    at = node * BINS + binned[:, f]
                    sg, sh, sn = (np.bincount(at, v, many * BINS).reshape(many, BINS).cumsum(axis=1) for v in (g, h, None))
                    tg, th, tn = sg[:, -1:], sh[:, -1:], sn[:, -1:]
                    gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                    gain = np.where((sn >= LEAF) & (tn - sn >= LEAF), gain, 0)[:, :-1]
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(many), k]
                    better = top > best + 1e-9
                    best[better], choice[better] = top[better], np.stack([np.full(many, f), k], axis=1)[better]
                splits = [(int(f), float(edges[f][k]) if f >= 0 and k < len(edges[f]) else float("inf")) if f >= 0 else (0, float("inf")) for f, k in choice]
                tree.append(splits)
                feature, limit = np.array([f for f, _ in splits]), np.array([t for _, t in splits])
                node = 2 * node + (x[np.arange(len(y)), feature[node]] > limit[node])
            sums = [np.bincount(node, v, 1 << DEPTH) for v in (g, h)]
            leaves = RATE * sums[0] / (sums[1] + 1)
            self.trees.append((tree, leaves))
            raw += leaves[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, each = np.full(len(x), self.base), np.arange(len(x))
        for tree, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for splits in tree:
                feature, limit = np.array([f for f, _ in splits]), np.array([t for _, t in splits])
                node = 2 * node + (x[each, feature[node]] > limit[node])
            out += leaves[node]
        return out

    def calibrate(self, raw: np.ndarray, y: np.ndarray) -> Trees:
        """Isotonic regression of labels on raw scores. Neighbours out of order are pooled; each pool's mean is drawn to
        the mean of all labels as by PRIOR rows; pools whose drawn means are out of order are pooled once more, each
        with the weight of its rows and PRIOR."""
        order = np.argsort(raw, kind="stable")
        first = _pooled([(float(t), 1.0, float(r), 1.0) for r, t in zip(raw[order], y[order])])
        prior = PRIOR * float(y.mean())
        pools = _pooled([(total + prior, rows + PRIOR, at, rows) for total, rows, at, _ in first])
        self.xs = np.array([at / rows for _, _, at, rows in pools])
        self.ys = np.array([total / weight for total, weight, _, _ in pools])
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated score; a hundredth of it is the plain logistic score, which keeps pooled rows in order."""
        raw = self.raw(x)
        plain = 1 / (1 + np.exp(-np.clip(raw, -50, 50)))
        return np.clip(0.99 * np.interp(raw, self.xs, self.ys) + 0.01 * plain, 0, 1) if self.trees else np.full(len(x), float(self.ys[0]))


def training_rows(labels: DataFrame, label_col: str, id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, y): at most `sample` labelled ids outside the held-out fold, those with the least hashes."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).filter(crc_fold(id_col) != 0)
    known = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def learn_words(texts: DataFrame, ones: int, rows: int, words: int = LEARNED) -> list[str]:
    """The words, and stems (as `stem*`, the first letters of longer words), that stand out most in texts
    with y = 1 against y = 0. texts: (y, text), of `rows` labels of which `ones` are 1. They are ranked
    by the likelihood ratio of the numbers of distinct texts that hold them; at least LEAST_TEXTS and
    LEAST_SHARE of these have y = 1."""
    if not 0 < ones < rows:
        return []
    bare = F.transform(F.split(F.lower("text"), r"[\s|]+"), lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    held = texts.groupBy(F.xxhash64("text").alias("h")).agg(F.max("y").alias("y"), F.min("text").alias("text"))
    held = held.select("y", F.filter(F.array_distinct(bare), lambda w: F.length(w) > 2).alias("w"))

    def stems(k: int) -> Column:
        return F.transform(F.filter("w", lambda w: F.length(w) > k), lambda w: F.concat(F.left(w, F.lit(k)), F.lit("*")))

    counts = held.select("y", F.explode(F.array_distinct(F.concat("w", *map(stems, STEMS)))).alias("w")).groupBy("w").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
    counts = counts.filter(F.col("a") >= LEAST_TEXTS)
    p, a, b = ones / rows, F.col("a"), F.col("n") - F.col("a")
    ratio = 2 * (a * F.log(a / (F.col("n") * p)) + F.when(b > 0, b * F.log(b / (F.col("n") * (1 - p)))).otherwise(0))
    found = counts.select("w", "a", "n", ratio.alias("g")).filter((F.col("g") >= LEAST_G) & (a >= LEAST_SHARE * F.col("n")) & (a > F.col("n") * p))
    return [r["w"] for r in found.orderBy(F.col("g").desc(), "w").limit(words).collect()]


def features(docs: DataFrame, learned: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f): the features of each row; a null text counts as empty."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer(learned)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = pa.array([make.one(t) for t in part.column("text").to_pylist()], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), made], names=["doc_id", "f"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, f array<float>")


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees on all rows, calibrated on what each of FOLDS parts of them gets from trees on the other
    parts; the mean label where there is only one."""
    model = Trees()
    if not len(y) or y.min() == y.max():
        model.ys = np.array([float(y.mean()) if len(y) else 0.0])
        return model
    raw, part = np.zeros(len(y)), np.zeros(len(y), np.int64)
    for label in (0, 1):  # each part gets its share of both labels
        own = np.flatnonzero(y == label)
        part[own] = np.arange(own.size) % FOLDS
    for k in range(FOLDS):
        if (part == k).any():
            raw[part == k] = Trees().fit(x[part != k], y[part != k]).raw(x[part == k])
    return model.fit(x, y).calibrate(raw, y)


def score_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Only whole texts are scored. Words and trees are learned from at most `sample` labelled rows whose
    crc32(id) mod 5 is not 0; held_out marks the others. An id labelled twice counts as its larger
    label; null ids or labels teach nothing, and a document with a null id is not held out. A null text
    counts as empty. Without labels of both kinds every score is the mean label, 0 if there is none.
    Repeated rows each have a row; an empty table gives none; other columns are not read.
    """
    known = settle(training_rows(labels, label_col, id_col, sample))  # bounded by `sample`: small enough to broadcast
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    taught = plain.join(F.broadcast(known), "doc_id")
    total = known.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    learned = learn_words(taught.select("y", "text"), *total)
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        made = settle(features(docs, learned, id_col, text_col))
    rows = made.join(F.broadcast(known), "doc_id").select("doc_id", "y", "f").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    x = np.array([r["f"] for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))
    model = fit(x, np.array([r["y"] for r in rows], dtype=np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("f").flatten(), dtype=np.float64).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    scored = made.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(crc_fold("doc_id") == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
