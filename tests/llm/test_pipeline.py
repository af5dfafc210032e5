"""Each stage of the pipeline against what its input asks for."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest

from quorumkit.llm.mixing import mix_report
from quorumkit.llm.quality_lm import classify

from ..conftest import SF
from .test_similar import brute


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{base}/{k}")
        before, docs = docs, spark.read.parquet(f"{base}/{k}")
        out.append((before, docs))
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix_sources", "sentencepiece"]


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality(spark, stages):
    before, after = stages[0]
    kept = {r.doc_id for r in classify(before, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.kept}
    assert {r.doc_id for r in after.collect()} == kept and 0 < len(kept) < before.count()


def test_exact(stages):
    before, after = stages[1]
    last = {}
    for r in before.collect():
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert sorted(r.doc_id for r in after.collect()) == sorted(last.values())


def test_near(stages):
    before, after = stages[2]
    assert {r.doc_id for r in after.collect()} == set(brute({r.doc_id: r.text for r in before.collect()}).values())


def test_mix(stages):
    before, after = stages[3]
    words = {r.doc_id: r.text.split() for r in before.collect()}
    taken = Counter()
    for r in after.collect():
        got = r.text.split()
        taken[r.doc_id] += len(got)
        assert r.n_chars == len(r.text) and Counter(got) <= Counter(words[r.doc_id])
    assert {r.doc_id: r.taken for r in mix_report(before).collect() if r.taken} == dict(taken)


def test_tokens(stages):
    import sentencepiece

    from quorumkit.llm.queries import tokenizer_path

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    before, after = stages[4]
    assert Counter(tuple(r.ids) for r in after.collect()) == Counter(tuple(library.encode(r.text)) for r in before.collect())
    assert all(r.agrees and r.n_tokens == len(r.ids) for r in after.collect())


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[4][1].count()


def test_only_the_last_input_stays(spark):
    from quorumkit.llm.common import checkpoint_path

    jvm = spark._jvm.org.apache.hadoop.fs.Path
    base = checkpoint_path(spark)
    listed = lambda: {str(x.getPath()) for x in jvm(base).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm(f"{base}/pipeline-*/*"))}
    before = listed()
    out = corpus_pipeline.run(spark, SF)
    assert [x.rsplit("/", 1)[-1] for x in listed() - before] == ["3-mix_sources"] and out.count() > 0


def folder_of(spark, tmp_path, rows) -> str:
    """Tables with an odd set of documents, whose further columns have names that stages use themselves."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k1 string, block int, label double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1) for r in rows if r[0] is not None and r[0] < 40], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_odd_documents(spark, tmp_path):
    rows = [(k, f"word{k} and other words of text {k}", "en", f"s{k % 2}", 9, "x", k, 0.5) for k in range(40)]
    rows += [rows[0], rows[0], (50, None, None, None, None, None, None, None), (51, "", "en", "s0", 0, "", 0, 0.0), (52, " \n", None, "s1", 2, "", 0, 0.0), (None, "no id here", "en", None, 1, "", 0, 0.0), (None, None, None, None, None, None, None, None)]
    rows += [(60, "long " * 20_000, "en", "s0", 5, "a", 1, 1.0), (61, "same text", "en", "s0", 1, "a", 1, 1.0), (62, "same text", "de", "s1", 1, "b", 2, 2.0)]
    folder = folder_of(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    assert docs.filter("text IS NULL").count() == 0 and docs.filter("text = 'same text'").count() >= 0
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256", "agrees"] and all(r.agrees and r.n_tokens == len(r.ids) for r in got.collect())


def test_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder_of(spark, tmp_path, [])).count() == 0
