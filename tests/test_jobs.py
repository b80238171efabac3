"""The jobs: runs over growing input, failures, reruns, and their SQL."""

import json
import os
import random
import subprocess
import sys

import duckdb
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from jobs import evaluate_methods, ingest_memory, registered
from tessera.functions import providers

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCHEMA = "conv_id long, turn long, role string, text string"
WORDS = "storm harbour tide rope sail anchor deck mast wind wave".split()


def same(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.fixture(scope="module")
def dialogues():
    """Turns of 40 dialogues; one of them is a third of all rows, and some turns are blank."""
    r = random.Random(4)
    out = []
    for c in range(40):
        for t in range(150 if c == 7 else r.randrange(1, 9)):
            text = " \n" if r.random() < 0.05 else " ".join(r.choices(WORDS, k=r.randrange(2, 9)))
            out.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    return out


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def files(out, part):
    return {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{out}/memory/part={part}") for f in fs if f.startswith("part-")}


def whole(spark, rows, rounds=1, over=0.5):
    """What one run over all turns must give."""
    got = ingest_memory.memory(spark.createDataFrame(rows, SCHEMA), rounds, over).withColumn("part", F.pmod("conv_id", F.lit(16)).cast("int"))
    return same(map(tuple, got.select(*[c.split()[0] for c in ingest_memory.MEMORY.split(", ")]).collect()))


def test_growing_input(spark, tmp_path, dialogues):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    early = [x for x in dialogues if x[0] % 3 and x[1] < 3]
    put(spark, src, early)
    run = lambda **s: ingest_memory.run(spark, str(src), out, mark, s)
    assert same(map(tuple, run().collect())) == whole(spark, early)

    untouched = {p: files(out, p) for p in range(16) if p not in {c % 16 for c in (1, 5, 39, 100)}}
    news = [(1, 50, "user", "rope rope sail"), (5, 1, "user", "a turn that was said anew"), (39, 99, "user", "sail"), (100, 0, "user", "storm"), (None, 3, "user", "no dialogue"), (4, None, "user", "no place")]
    put(spark, src, news)
    now = [x for x in early if x[:2] != (5, 1)] + news[:4]
    second = run()
    assert same(map(tuple, second.collect())) == whole(spark, now)
    assert {p: files(out, p) for p in untouched} == untouched  # parts without new turns are left as they are
    taken = spark.read.parquet(f"{out}/turns/batch=1")
    assert sorted((x.conv_id, x.turn) for x in taken.collect()) == [(1, 50), (5, 1), (39, 99), (100, 0)]

    put(spark, src, [x for x in dialogues if x not in early and x[0] < 20])
    put(spark, src, [x for x in dialogues if x not in early and x[0] >= 20])
    third = run(files_per_batch=1)
    late = [x for x in dialogues if x not in early]
    replaced = {x[:2] for x in late}
    assert same(map(tuple, third.collect())) == whole(spark, [x for x in now if x[:2] not in replaced] + late)
    assert sorted(x for x in os.listdir(f"{out}/turns") if x.startswith("batch")) == ["batch=0", "batch=1", "batch=2", "batch=3"]

    before = {p: files(out, p) for p in range(16)}
    assert same(map(tuple, run().collect())) == same(map(tuple, third.collect())) and {p: files(out, p) for p in range(16)} == before


def test_a_lost_run_is_made_good(spark, tmp_path, dialogues, monkeypatch):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    some = [x for x in dialogues if x[0] < 6]
    put(spark, src, some)
    ingest_memory.run(spark, str(src), out, mark)
    more = [(c, 60 + t, "user", "anchor deck mast") for c in range(4) for t in range(3)]
    put(spark, src, more)
    kept, lost = ingest_memory.memory, []

    def fails(*a):
        lost.append(1)
        raise RuntimeError("lost")

    monkeypatch.setattr(ingest_memory, "memory", fails)
    with pytest.raises(StreamingQueryException):
        ingest_memory.run(spark, str(src), out, mark)
    monkeypatch.setattr(ingest_memory, "memory", kept)
    put(spark, src, [(5, 70, "user", "later")])
    got = ingest_memory.run(spark, str(src), out, mark)
    assert lost and same(map(tuple, got.collect())) == whole(spark, [*some, *more, (5, 70, "user", "later")])


def test_methods_replace_their_own_partition(spark, tmp_path, dialogues):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, src, [x for x in dialogues if x[0] < 12])
    first = evaluate_methods.run(spark, src, out, {"methods": {"turn": 1, "double": 2}})
    rows = {m: same(map(tuple, first.where(F.col("method") == m).collect())) for m in ("turn", "double")}
    asked = sum(len(fs) for _, _, fs in os.walk(f"{out}/calls"))
    assert rows["turn"] and rows["double"]

    class Silent:
        def reply(self, prompt):
            raise AssertionError("asked again")

    kinds = dict(evaluate_methods.KINDS)
    evaluate_methods.KINDS.update(quote=lambda: Silent(), overlap=lambda: Silent())
    try:
        again = evaluate_methods.run(spark, src, out, {"methods": {"double": 2}})
    finally:
        evaluate_methods.KINDS.update(kinds)
    assert {m: same(map(tuple, again.where(F.col("method") == m).collect())) for m in rows} == rows
    assert asked <= sum(len(fs) for _, _, fs in os.walk(f"{out}/calls"))
    summary = {(x.method, x.category): x.n for x in spark.read.parquet(f"{out}/summary").collect()}
    assert sum(summary.values()) == again.where("rating is not null").count()


def test_baselines():
    ask = providers.PROMPTS["answer"].format(question="who?", context="\nuser: one two\nassistant: three")
    assert json.loads(providers.Quote().reply(ask)) == {"answer": "user: one two"}
    rate = lambda truth, answer: json.loads(providers.Overlap().reply(providers.PROMPTS["judge_0_100"].format(question="q", truth=truth, answer=answer)))
    assert rate("One two", "user: one") == {"rating": 50} and rate("", "x") == {} and rate("a b c", "C b a") == {"rating": 100}


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_sql(spark, name):
    df = registered.QUERIES[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(registered.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    assert same(map(tuple, df.select(*cols).collect())) == same(want.select(*cols).fetchall())


@pytest.mark.parametrize("job, more", [("ingest_memory", ["--checkpoint", "mark"]), ("evaluate_methods", [])])
def test_command_line(spark, tmp_path, dialogues, job, more):
    put(spark, tmp_path / "in", [x for x in dialogues if x[0] < 4])
    with open(f"{ROOT}/jobs/{job}.json") as f:
        (tmp_path / "c.json").write_text(json.dumps(json.load(f) | {"parts": 4, "k": 2}))
    args = ["--turns", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--config", str(tmp_path / "c.json"), *[str(tmp_path / x) if not x.startswith("-") else x for x in more]]
    done = subprocess.run([sys.executable, f"{ROOT}/jobs/{job}.py", *args], capture_output=True, text=True, timeout=300, env={**os.environ, "SPARK_LOCAL_DIRS": str(tmp_path)})
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"tessera.jobs.{job}" in done.stderr
    assert spark.read.parquet(str(tmp_path / "out" / ("memory" if job == "ingest_memory" else "rated"))).count() > 0
