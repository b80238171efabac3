"""The run on events: taken up again after a loss, made again only where something changed."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions.providers import Scripted
from tessera.plans import events, stages
from tessera.sources import dialogue


class Counted:
    """Models that leave a file a call, so that a second call of a prompt is seen."""

    def __init__(self, folder):
        self.folder = str(folder)

    def models(self, judge=None):
        def count(kind, f):
            folder = self.folder

            def reply(prompt):
                import uuid

                open(f"{folder}/{kind}-{uuid.uuid4().hex}", "w").close()
                return f(prompt)

            return Scripted(reply)

        def cut(prompt):
            lines = json.loads(prompt[prompt.index("\n{") + 1 :])
            return json.dumps({"topic_boundaries": [{"boundary_index": int(k), "reason": "said"} for k, v in lines.items() if v.startswith("user:")]})

        def relevant(prompt):
            return json.dumps({"results": [{"doc_id": int(k), "score": 5} for k in json.loads(prompt[prompt.index("\n{") + 1 :])]})

        return events.Models(
            count("segment", cut),
            count("sufficient", lambda p: '{"result": 1}'),
            count("relevant", relevant),
            count("answer", lambda p: json.dumps({"answer": str(len(p))})),
            judge or count("judge", lambda p: '{"rating": 50}'),
        )

    def calls(self):
        import os
        from collections import Counter

        return Counter(re.match("[a-z]+", x)[0] for x in os.listdir(self.folder))


@pytest.fixture()
def turns(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"The ship number {t % 3} of port {c} sails at noon tomorrow. We talk about the rope and the sail number {t}.") for c in range(3) for t in range(13)]
    return dialogue.from_table(spark.createDataFrame([*rows, (9, 0, "user", " "), (9, 1, "assistant", None)], "conv_id long, turn long, role string, text string"))


def rows(out):
    return {k: sorted(map(repr, map(tuple, t.collect()))) for k, t in out.items()}


def test_a_run_is_taken_up_again(spark, tmp_path, turns, monkeypatch):
    (tmp_path / "calls").mkdir()
    counted = Counted(tmp_path / "calls")
    whole = rows(events.run(turns, str(tmp_path / "whole"), counted.models(), text_over=0.8, sentence_over=0.8))
    once = counted.calls()
    assert len(whole["segments"]) > 15 and whole["edges"] and len(whole["rated"]) == 22 and once["answer"] and once["judge"]
    assert max(int(re.search(r"\d+", x)[0]) for x in whole["nodes"]) == 9

    (tmp_path / "again").mkdir()
    lost = Counted(tmp_path / "again")
    real = events.expand_text

    def fails(*a, **b):
        raise RuntimeError("lost")

    monkeypatch.setattr(events, "expand_text", fails)
    with pytest.raises(RuntimeError):
        events.run(turns, str(tmp_path / "r"), lost.models(), text_over=0.8, sentence_over=0.8)
    monkeypatch.setattr(events, "expand_text", real)
    kept = {(x.stage, x.fingerprint) for x in stages.Stages(spark, str(tmp_path / "r")).manifest().collect()}
    assert {s for s, _ in kept} == set(whole) - {"found", "rated", "summary"}
    assert rows(events.run(turns, str(tmp_path / "r"), lost.models(), text_over=0.8, sentence_over=0.8)) == whole
    assert lost.calls() == once
    assert kept <= {(x.stage, x.fingerprint) for x in stages.Stages(spark, str(tmp_path / "r")).manifest().collect()}
    assert rows(events.run(turns, str(tmp_path / "r"), lost.models(), text_over=0.8, sentence_over=0.8)) == whole and lost.calls() == once


def test_only_what_changed_is_made(spark, tmp_path, turns):
    (tmp_path / "calls").mkdir()
    counted, path = Counted(tmp_path / "calls"), str(tmp_path / "r")
    events.run(turns, path, counted.models())
    first = {x.stage: x.fingerprint for x in stages.Stages(spark, path).manifest().collect()}
    before = counted.calls()
    events.run(turns, path, counted.models(), sentence_over=0.95)
    second = [x.stage for x in stages.Stages(spark, path).manifest().collect() if x.fingerprint != first[x.stage]]
    assert sorted(second) == ["edges", "found", "rated", "summary"]
    assert counted.calls()["segment"] == before["segment"]
    more = turns.unionByName(spark.createDataFrame([(1, 0, 13, "assistant", "A last word.")], turns.schema))
    out = events.run(more, path, counted.models())
    assert out["lines"].count() == turns.count() + 1
    assert counted.calls()["segment"] == before["segment"] + 1  # only the dialogue that grew is segmented again
    assert events.run(turns, path, counted.models())["lines"].count() == turns.count()


def test_checksum(spark):
    t = spark.createDataFrame([(i, f"t{i}", None) for i in range(50)], "a int, b string, c double")
    assert stages.checksum(t) == stages.checksum(t.repartition(7).orderBy(F.desc("b")))
    assert len({stages.checksum(x) for x in (t, t.limit(0), t.unionByName(t.limit(1)), t.where("a <> 3"), t.withColumn("a", F.col("a") + (F.col("a") == 7).cast("int")), t.withColumnRenamed("b", "d"))}) == 6


def test_checksum_of_many_rows(spark):
    """The sum of a million hashes does not fit a long, shifted or not."""
    many = spark.range(3_000_000)
    assert stages.checksum(many) == stages.checksum(many.repartition(3)) != stages.checksum(many.where("id > 0"))


def test_tokens_of_the_segmentation(spark, tmp_path, turns):
    (tmp_path / "calls").mkdir()
    out = events.run(turns, str(tmp_path / "r"), Counted(tmp_path / "calls").models())
    t = out["tokens"].first()
    assert (t.stage, t.calls, t.errors) == ("boundaries", 4, 0) and t.input_tokens > 500 and t.average == (t.input_tokens + t.output_tokens) / 4
    empty = events.run(turns.limit(0), str(tmp_path / "e"), Counted(tmp_path / "calls").models())
    assert all(out.count() == 0 for name, out in empty.items() if name != "tokens")
