"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, row_key, settle

#: Lines of a window.
WINDOW = 3


def _windows(keyed: DataFrame) -> DataFrame:
    """(k1, k2, a, b, p): two hashes and the line positions of each window of non-blank lines."""
    hashed = F.transform(
        F.split("text", "\n", -1),
        lambda x, i: F.struct(i.alias("p"), F.xxhash64(F.trim(x)).alias("a"), F.xxhash64(F.lit(1), F.trim(x)).alias("b"), (F.trim(x) == "").alias("blank")),
    )
    lines = keyed.select("k1", "k2", F.filter(hashed, lambda s: ~s["blank"]).alias("s")).filter(F.size("s") >= WINDOW)
    runs = [F.slice("s", k + 1, F.size("s") - (WINDOW - 1)) for k in range(WINDOW)]
    rows = lines.select("k1", "k2", F.explode(F.arrays_zip(*[r.alias(f"r{k}") for k, r in enumerate(runs)])).alias("w"))
    at = [F.col("w").getField(f"r{k}") for k in range(WINDOW)]
    return rows.select(
        "k1", "k2", F.xxhash64(*[s["a"] for s in at]).alias("a"), F.xxhash64(*[s["b"] for s in at]).alias("b"), F.array(*[s["p"] for s in at]).alias("p")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with later copies of passages removed from the text, plus `n_lines`, `removed_lines`, `removed_spans`.

    A text is cut at line feeds. Each three consecutive non-blank lines, spaces at their ends ignored,
    are a window. The first occurrence of a window, by id (null last) and position, stays; every line
    that a later occurrence covers goes, and adjacent covered lines make one span [first, last].
    So the first copy of every line always stays. A null or empty text has no window (null stays null),
    nor has one of fewer than three non-blank lines. Rows with equal id and text count as one document
    and end alike. An empty table gives no rows. Input columns of the three names are replaced.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    windows = _windows(docs.select(*row_key(id_col, text), text.alias("text")))
    place = F.struct("k1", "k2", F.col("p")[0].alias("p"))
    firsts = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last")))
    firsts = settle(firsts.drop("last"))  # so that both sides of the join are dealt anew and a hot window can be split
    later = windows.join(firsts, ["a", "b"]).filter(place != F.col("first")).select("k1", "k2", F.explode("p").alias("p"))
    covered = later.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("p")).alias("__gone"))
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "removed_lines", "removed_spans")]
    k1, k2, lines, gone = beside(docs, "k1", "k2", "lines", "gone")
    covered = covered.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("__gone").alias(gone))
    cut = F.when(F.col(f"`{text_col}`").isNotNull(), F.split(text, "\n", -1)).alias(lines)
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], *[c.alias(n) for c, n in zip(row_key(id_col, text), (k1, k2))], cut)
    met = keyed.join(covered, [k1, k2], "left")
    size = F.coalesce(F.size(lines), F.lit(0))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    rest = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.col(lines)[i]), "\n"))
    begins = F.filter(gone, lambda p, i: (i == 0) | (F.col(gone)[F.greatest(i - 1, F.lit(0))] != p - 1))
    ends = F.filter(gone, lambda p, i: (i == F.size(gone) - 1) | (F.col(gone)[F.least(i + 1, F.size(gone) - 1)] != p + 1))
    spans = F.coalesce(F.arrays_zip(begins.alias("first"), ends.alias("last")), F.array().cast("array<struct<first:int,last:int>>"))
    return met.select(
        *[F.when(F.col(f"`{text_col}`").isNotNull(), rest).alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        F.when(F.col(lines).isNull(), 0).otherwise(size).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("removed_lines"),
        spans.alias("removed_spans"),
    )
