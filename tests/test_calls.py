"""Calls are made once, kept, and read from where they were written."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import providers
from tessera.functions.callstore import CallStore
from tessera.operators import chunking
from tessera.plans import answer


class Random:
    """Never answers alike; leaves a file for every call."""

    def __init__(self, folder, key):
        self.folder, self.key = str(folder), key

    def reply(self, prompt):
        open(os.path.join(self.folder, uuid.uuid4().hex), "w").close()
        return json.dumps({self.key: int(uuid.uuid4().int % 100) if self.key == "rating" else uuid.uuid4().hex})


@pytest.fixture()
def asked(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 5, f"question {i % 40}", "truth", "text") for i in range(60)], "q_id int, label int, question string, truth string, context string")
    a, j = tmp_path / "answers", tmp_path / "ratings"
    a.mkdir(), j.mkdir()
    return rows, a, j, CallStore(spark, str(tmp_path / "store"))


def test_each_prompt_is_asked_once(spark, asked):
    rows, a, j, store = asked
    out = answer.answer_and_rate(rows, Random(a, "answer"), Random(j, "rating"), store=store)
    got = sorted(map(tuple, out.select("q_id", "question", "answer", "status", "rating").collect()))
    assert len(os.listdir(a)) == 40 and len(os.listdir(j)) == 40
    assert len(got) == 60 and all(x[3] == "ok" and x[4] is not None for x in got)
    assert len({(x[1], x[2], x[4]) for x in got}) == 40  # a question has one answer and one rating
    assert sorted(map(tuple, out.select("q_id", "question", "answer", "status", "rating").collect())) == got
    assert answer.scores_by_category(out).agg(F.sum("n")).first()[0] == 60
    assert len(os.listdir(a)) == 40 and len(os.listdir(j)) == 40  # nothing is asked by evaluating it again
    assert [(x["stage"], x["calls"], x["errors"]) for x in store.observed] == [("answers", 40, 0), ("ratings", 40, 0)]
    ledger = {x.stage: x for x in store.ledger({"answers": "call_id", "ratings": "call_id"}).collect()}
    for seen in store.observed:
        kept = ledger[seen["stage"]]
        assert (kept.calls, kept.errors, kept.input_tokens, kept.output_tokens) == (seen["calls"], seen["errors"], seen["input_tokens"], seen["output_tokens"])
        assert kept.average == (seen["input_tokens"] + seen["output_tokens"]) / 40


def test_a_rerun_asks_nothing(spark, asked):
    rows, a, j, store = asked
    run = lambda s, r: sorted(map(tuple, answer.answer_and_rate(r, Random(a, "answer"), Random(j, "rating"), store=s).select("q_id", "answer", "rating").collect()))
    first = run(store, rows.where("q_id < 20"))
    assert len(os.listdir(a)) == 20
    again = CallStore(spark, store.path)
    assert [x for x in run(again, rows) if x[0] < 20] == first
    assert len(os.listdir(a)) == 40 and [x["calls"] for x in again.observed] == [20, 20]
    third = CallStore(spark, store.path)
    run(third, rows)
    assert len(os.listdir(a)) == len(os.listdir(j)) == 40 and [x["calls"] for x in third.observed] == [0, 0]


def test_waves_survive_a_failure_and_errors_are_asked_again(spark, tmp_path):
    rows = spark.range(50).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    store = CallStore(spark, str(tmp_path / "s"))
    kept = store.extend
    bad = tmp_path / "bad"

    def third_wave_fails(todo, key, ask, stage, schema, waves):
        count = [0]

        def once(missing):
            count[0] += 1
            if count[0] == 3:
                raise RuntimeError("lost")
            return ask(missing)

        return kept(todo, key, once, stage, schema, waves)

    store.extend = third_wave_fails
    bad.write_text("")
    upper = providers.Scripted(lambda p: p.upper() if not (p == "p7" and os.path.exists(bad)) else 1 / 0)
    with pytest.raises(RuntimeError):
        providers.call(rows, upper, store=store, waves=4)
    before = sum(x["calls"] for x in store.observed)
    assert 0 < before < 50
    store.extend = kept
    got = {x.prompt: (x.response, x.status) for x in providers.call(rows, upper, store=store, waves=4).collect()}
    assert got.pop("p7") == (None, "error") and got == {f"p{i}": (f"P{i}", "ok") for i in range(50) if i != 7}
    assert sum(x["calls"] for x in store.observed) - 50 <= 1  # only the failed prompt may have been asked twice
    bad.unlink()
    more = CallStore(spark, store.path)
    assert {x.prompt: x.response for x in providers.call(rows, upper, store=more).collect()}["p7"] == "P7"
    assert [x["calls"] for x in more.observed] == [1]


def test_edges_of_calls(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, "x")], "i int, prompt string")
    got = {x.i: (x.response, x.status) for x in providers.call(rows, providers.Scripted(lambda p: p + "!")).collect()}
    assert got == {1: (None, "error"), 2: ("!", "ok"), 3: ("x!", "ok"), 4: ("x!", "ok")}
    assert providers.call(rows.limit(0), providers.Scripted(str.upper)).count() == 0
    vectors = CallStore(spark, str(tmp_path / "v"))
    for calls in (2, 0):
        e = providers.embed(rows.withColumn("prompt", F.concat("prompt", F.col("i").cast("string"))), providers.ScriptedEmbedder(lambda t: [float(len(t))]), "prompt", 1, store=vectors)
        assert {x.i: x.vec for x in e.collect()} == {1: [0.0], 2: [1.0], 3: [2.0], 4: [2.0]}
        assert vectors.observed[-1]["calls"] == (3 if calls else 0)


def test_lines_reach_the_model_in_order(spark):
    """Twelve turns: 2 comes before 10."""
    def reply(prompt):
        keys = list(json.loads(prompt[prompt.index("\n{") + 1 :]))
        assert keys == [str(k) for k in range(12)]
        return json.dumps({"topic_boundaries": [{"boundary_index": 2, "reason": "a"}, {"boundary_index": 10, "reason": "b"}]})

    lines = spark.createDataFrame([(1, k, f"line {k}") for k in reversed(range(12))], "conv_id int, turn int, line string")
    numbered = chunking.numbered_lines(lines, ["conv_id"], "turn", "line")
    assert sorted(x.boundary for x in answer.boundaries(numbered, providers.Scripted(reply)).collect()) == [2, 10]


def test_rows_are_evaluated_once(spark, asked):
    """What questions are joined from is evaluated once for answers, ratings and the result, and prompts in buckets are not dealt again."""
    rows, a, j, store = asked
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(q):
        seen.add(1)
        return f"text {q % 3}"

    out = answer.answer_and_rate(rows.withColumn("context", text("q_id")), Random(a, "answer"), Random(j, "rating"), store=store)
    assert out.where("rating is not null").count() == 60 and seen.value == 60
    held = providers.bucketed(rows.withColumn("k", F.sha2("question", 256)), "prompts", "k", buckets=providers.tasks(spark))
    plan = held.select("k", "question").repartition(providers.tasks(spark), "k").dropDuplicates(["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
