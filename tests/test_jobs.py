"""The jobs: against SQL, over input that grows, after failures, with odd rows and empty tables."""

from __future__ import annotations

import json
import logging

import pytest
from pyspark.sql import functions as F

from jobs import answer_chats, common, follow_entropies, queries
from quorumkit.functions.text import prompt_key
from quorumkit.operators import entropy

from .conftest import SF, same_as_sql


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_as_sql(spark, duck, name):
    same_as_sql(spark, duck, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("job", [follow_entropies, answer_chats])
def test_config_files(spark, tmp_path, job):
    name = job.__name__.rsplit(".", 1)[-1]
    assert common.config_of(spark, f"{common.__file__.rsplit('/', 1)[0]}/{name}.json", {k: None for k in job.SETTINGS}) == job.SETTINGS
    (tmp_path / "c.json").write_text(json.dumps({"buckets": 3}))
    assert common.config_of(spark, str(tmp_path / "c.json"), job.SETTINGS) == job.SETTINGS | {"buckets": 3}
    (tmp_path / "c.json").write_text(json.dumps({"bucket": 3}))
    with pytest.raises(ValueError, match="bucket"):
        common.config_of(spark, str(tmp_path / "c.json"), job.SETTINGS)


# -- follow_entropies ---------------------------------------------------------------------------------


@pytest.fixture
def places(tmp_path):
    return [str(tmp_path / n) for n in ("events", "out", "checkpoint")]


def expected(events) -> dict:
    """What an entropy run over all samples gives."""
    rows = follow_entropies.taken(events, follow_entropies.SETTINGS)
    return {r.question: r for r in entropy.entropies(rows.withColumnRenamed("answer", "cluster"), "logprob", ["question"]).collect()}


def same(got, want) -> None:
    got = {r.question: r for r in got.collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        for c in entropy.MEASURES:
            assert r[c] == pytest.approx(want[k][c], abs=1e-9) or (r[c] is None and want[k][c] is None)
        assert (r.num_samples, r.num_clusters) == (want[k].num_samples, want[k].num_clusters)


def reads(caplog) -> list[int]:
    out = [r.args[1] for r in caplog.records if r.name == "follow_entropies" and "samples" in r.msg]
    caplog.clear()
    return out


def test_growing_input(spark, places, caplog):
    """Two runs over input that grows: the second reads the new files only, and a third reads nothing."""
    caplog.set_level(logging.INFO)
    events = spark.read.parquet(f"{SF}/events.parquet")
    first, second = events.filter("event_id % 3 = 0"), events.filter("event_id % 3 <> 0")
    first.coalesce(1).write.parquet(places[0])
    same(follow_entropies.run(spark, *places), expected(first))
    assert reads(caplog) == [first.count()]
    second.repartition(2).write.mode("append").parquet(places[0])
    same(follow_entropies.run(spark, *places, {"files_per_batch": 1}), expected(events))
    got = reads(caplog)
    assert len(got) == 2 and sum(got) == second.count()
    before = sorted(follow_entropies.read(spark, places[1]).collect())
    assert sorted(follow_entropies.run(spark, *places).collect()) == before and reads(caplog) == []


def test_only_touched_buckets_are_written(spark, places):
    config = {"buckets": 4}
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.coalesce(1).write.parquet(places[0])
    files = lambda: {r.file for r in spark.read.parquet(f"{places[1]}/uncertainty").select(F.col("_metadata.file_path").alias("file")).distinct().collect()}
    follow_entropies.run(spark, *places, config)
    before = files()
    one = events.limit(1).collect()[0].user_id
    events.filter(F.col("user_id") == one).coalesce(1).write.mode("append").parquet(places[0])
    same(follow_entropies.run(spark, *places, config), expected(events.unionByName(events.filter(F.col("user_id") == one))))
    assert len(before) == 4 and len(before & files()) == 3


@pytest.mark.parametrize("broken", ["refresh", "overwrite"])
def test_a_failed_batch_counts_once(spark, places, monkeypatch, broken):
    """A run that ends between its writes, or in the middle of one, and is started again."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.filter("event_id % 2 = 0").coalesce(1).write.parquet(places[0])
    follow_entropies.run(spark, *places)
    events.filter("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(places[0])

    def stop(*a):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(follow_entropies, broken, stop)
        with pytest.raises(Exception, match="lost"):
            follow_entropies.run(spark, *places)
    same(follow_entropies.run(spark, *places), expected(events))


def test_odd_samples(spark, places):
    kind = "event_id long, user_id long, event_type string, value double, batch string, bucket string"
    rows = [(1, 1, "a", 100.0, "x", "y"), (1, 1, "a", 100.0, "x", "y"), (2, 1, None, None, None, None), (3, None, "a", 1.0, "", ""), (7, 2, None, 5.0, "", ""), (8, 3, "b", 1.0, "", ""), (9, 3, "a", 1.0, "", ""), (10, 4, "", 90_000.0, "", "")]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(places[0])
    got = {r.question: r for r in follow_entropies.run(spark, *places).collect()}
    assert {k: (r.top_answer, round(r.top_share, 6), r.num_samples, r.num_clusters) for k, r in got.items()} == {1: ("a", 0.666667, 3, 2), 2: (None, 1.0, 1, 1), 3: ("a", 0.5, 2, 2), 4: ("", 1.0, 1, 1)}
    assert got[2].PE_MC is None and got[1].PE_MC == pytest.approx(1.0) and got[4].PE_MC == pytest.approx(900.0)


def test_no_samples(spark, places):
    empty = spark.read.parquet(f"{SF}/events.parquet").filter("false")
    empty.write.parquet(places[0])
    assert follow_entropies.run(spark, *places).count() == 0
    empty.write.mode("append").parquet(places[0])
    out = follow_entropies.run(spark, *places)
    assert out.count() == 0 and out.columns[0] == "question"


def test_patterns():
    assert follow_entropies.pattern("s3a://b/events.parquet/") == "s3a://b/events.parque[t]"
    assert follow_entropies.pattern("/a/*.parquet") == "/a/*.parquet"


# -- answer_chats -------------------------------------------------------------------------------------


def test_chats_rerun_and_grow(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    chats, out = str(tmp_path / "chats"), str(tmp_path / "out")
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    part = turns.filter("conv_id % 3 <> 0")
    part.write.parquet(chats)
    first = sorted(answer_chats.run(spark, chats, out).collect())
    assert first == sorted(answer_chats.run(spark, chats, out).collect())
    turns.filter("conv_id % 3 = 0").write.mode("append").parquet(chats)
    grown = sorted(answer_chats.run(spark, chats, out).collect())
    other = sorted(answer_chats.run(spark, f"{SF}/conversations.parquet", str(tmp_path / "fresh")).collect())
    assert grown == other and [r.args[0] for r in caplog.records if r.name == "answer_chats" and "turns" in r.msg] == [part.count()] * 2 + [turns.count()] * 2
    assert sum(r.num_samples for r in grown) == turns.filter("role = 'assistant'").select("conv_id").distinct().count()


def test_odd_chats(spark, tmp_path):
    kind = "conv_id long, turn long, role string, text string, cluster int, bucket int"
    same = "one two three"
    rows = [(0, 1, "assistant", "early"), (0, 3, "assistant", f"```python\n{same}\n```"), (0, 3, "assistant", None), (1, 1, "assistant", f" {same} \n"), (2, 1, "assistant", "other words here"), (2, 1, "user", same)]
    rows += [(3, 0, "user", "unanswered"), (8, 1, "assistant", None), (9, 1, "assistant", ""), (None, 1, "assistant", same), (16, 1, None, same)]
    spark.createDataFrame([(*r, 5, 6) for r in rows], kind).write.parquet(str(tmp_path / "chats"))
    got = {r.qid: r for r in answer_chats.run(spark, str(tmp_path / "chats"), str(tmp_path / "out"), {"review_above": 0.5}).collect()}
    assert {k: (r.sample, r.answer, r.steps, r.votes, r.num_clusters, r.review) for k, r in got.items()} == {0: (0, same, 3, 2, 2, True), 1: (8, "", 1, 1, 2, True)}
    asked = spark.read.parquet(str(tmp_path / "out" / "requests")).withColumn("right", prompt_key(F.col("prompt")) == F.col("key")).collect()
    assert sorted((r.qid, r.direction, r.right) for r in asked) == [(0, "back", True), (0, "forth", True), (1, "back", True), (1, "forth", True)]
    assert any("Answer 1: one two three" in r.prompt and "Answer 2: other words here" in r.prompt for r in asked if r.direction == "forth")


def test_no_chats(spark, tmp_path):
    spark.read.parquet(f"{SF}/conversations.parquet").filter("false").write.parquet(str(tmp_path / "chats"))
    for _ in range(2):
        assert answer_chats.run(spark, str(tmp_path / "chats"), str(tmp_path / "out")).count() == 0


def test_command_lines(tmp_path, monkeypatch, spark):
    """The command line makes a session and stops it; what it runs is the function."""
    calls = []

    class Session:
        def stop(self):
            calls.append("stop")

    for job, paths in ((follow_entropies, ["a", "b", "c"]), (answer_chats, ["a", "b"])):
        monkeypatch.setattr(job, "session", lambda name: Session())
        monkeypatch.setattr(job, "run", lambda s, *a: calls.append(a))
        job.main(paths)
    assert calls == [("a", "b", "c", follow_entropies.SETTINGS), "stop", ("a", "b", answer_chats.SETTINGS), "stop"]
