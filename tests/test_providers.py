"""Providers over a local HTTP server, embeddings in batches, token counts, stored JSON."""

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tessera.functions import providers
from tessera.plans import answer, experiment
from tessera.sources import dialogue


@pytest.fixture(scope="module")
def server():
    """Answers chats with the prompt reversed and embeddings with lengths, in any order; every third request fails."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((body, self.headers["Authorization"]))
            if len(seen) % 3 == 0:
                self.send_error(503)
                return
            if "messages" in body:
                out = {"choices": [{"message": {"content": body["messages"][0]["content"][::-1]}}]}
            else:
                out = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/", seen
    s.shutdown()


def test_remote_chat(spark, server, monkeypatch):
    url, seen = server
    monkeypatch.setenv("CHAT_API_KEY", "k")
    assert [providers.Remote(url, "m", wait=0.01).reply(x) for x in ("abc", "def", "ghi")] == ["cba", "fed", "ihg"]
    assert seen[0] == ({"model": "m", "messages": [{"role": "user", "content": "abc"}], "temperature": 0.0}, "Bearer k")
    providers.Remote(url, "m", wait=0.01, temperature=None).reply("x")
    assert "temperature" not in seen[-1][0]
    rows = spark.createDataFrame([(i, f"p{i % 4}") for i in range(9)], "i int, prompt string")
    got = providers.call(rows, providers.Remote(url, "m", wait=0.01, retries=5)).collect()
    assert {(x.prompt, x.response, x.status) for x in got} == {(f"p{k}", f"{k}p", "ok") for k in range(4)} and len(got) == 9
    dead = providers.call(rows, providers.Remote("http://127.0.0.1:1/", "m", wait=0.01, timeout=1)).collect()
    assert {(x.response, x.status) for x in dead} == {(None, "error")}


def test_remote_embeddings(spark, server):
    rows = spark.createDataFrame([(1, "one"), (2, " three "), (3, "  "), (4, None), (5, "one"), (6, "x" * 99)], "i int, t string")
    got = {x.i: (list(x.vec), x.embed_status) for x in providers.embed(rows, providers.RemoteEmbedder(server[0], "m", wait=0.01, retries=5), "t", 2, budget=10).collect()}
    assert got == {1: ([3, 1], "ok"), 2: ([5, 1], "ok"), 3: ([0, 0], "blank"), 4: ([0, 0], "blank"), 5: ([3, 1], "ok"), 6: ([99, 1], "ok")}


def test_embedding_failures_and_batches(spark):
    class Picky:
        def embed(self, texts):
            if "bad" in texts:
                raise TimeoutError
            if "short" in texts:
                return []
            assert len(texts) == 1 or sum(len(t) for t in texts) * 0.74 <= 8 + len(texts)
            return [[1.0] for _ in texts]

    rows = spark.createDataFrame([(t,) for t in ("bad", "short", "long" * 9, "fine")], "t string").coalesce(1)
    got = {x.t: (x.vec, x.embed_status) for x in providers.embed(rows, Picky(), "t", 1, budget=4).collect()}
    assert got["bad"] == (None, "error") and got["short"] == (None, "error") and got["fine"] == ([1.0], "ok") and got["long" * 9] == ([1.0], "ok")
    assert providers.embed(rows.limit(0), Picky(), "t", 1).count() == 0


def test_cache_and_report(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "prompt string")
    first = providers.call(rows, providers.Scripted(str.upper))
    assert [tuple(x) for x in providers.report(first).collect()] == [(2, 2, 2, 2.0)]
    cache = first.where("prompt = 'a'").select("call_id", F.lit("kept").alias("response")).distinct()
    assert {(x.prompt, x.response) for x in providers.call(rows, providers.Scripted(str.upper), cache=cache).collect()} == {("a", "kept"), ("b", "B")}
    assert [tuple(x) for x in providers.report(first.limit(0)).collect()] == [(0, 0, 0, 0.0)]


def test_exact_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["hello world", "", None, "Straße 漢字 " * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for t in texts]
    for count in (providers.exact_tokens(path), providers.exact_tokens("/no/such/file", path)):
        assert [x[0] for x in rows.coalesce(1).select(count(F.col("t"))).collect()] == want


def test_json_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é"), (2, None)], "a int, b string")
    dialogue.write_json(rows, str(tmp_path / "j"))
    assert sorted(map(tuple, dialogue.read_json(spark, str(tmp_path / "j"), "a int, b string").collect())) == [(1, "é"), (2, None)]
    (tmp_path / "bad.json").write_text('{"a": 1}\nnot json\n')
    assert {x.a for x in dialogue.read_json(spark, str(tmp_path / "bad.json"), "a int").collect()} == {1, None}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        dialogue.read_json(spark, str(tmp_path / "none"), "a int").collect()


def test_judge_scales(spark):
    rows = spark.createDataFrame([("q", "t", "a")], "question string, truth string, answer string")
    assert answer.judge(rows, providers.Scripted(lambda p: '{"rating": 1}'), "0-1").first().rating == 1
    assert answer.judge(rows, providers.Scripted(lambda p: '{"rating": "x"}')).first().rating is None
    with pytest.raises(ValueError):
        answer.judge(rows, providers.Scripted(str), "0-5")


def test_experiment_writes_its_stages(spark, tmp_path):
    t = spark.createDataFrame([(c, 0, k, "user" if k % 2 == 0 else "assistant", f"words of turn {k} here") for c in (1, 2) for k in range(6)], "conv_id long, session_ord int, turn_ord long, speaker string, text string")
    out = experiment.run(t, str(tmp_path / "x"), providers.Scripted(lambda p: '{"answer": "yes"}'), providers.Scripted(lambda p: '{"rating": 50}'))
    assert sorted(os.listdir(tmp_path / "x")) == ["chunks", "edges", "nodes", "rated", "retrieved"]
    assert {(x.category, x.rating, x.n) for x in out["summary"].collect()} == {("multi-hop", 50.0, 3), ("temporal", 50.0, 3)}
    assert out["chunks"].count() == 6 and out["rated"].where("answer = 'yes' and status = 'ok'").count() == 6


def test_experiment_files_do_not_grow_with_conversations(spark, tmp_path):
    """A stage of 60 conversations has no more files than tasks write, and each conversation lies in one."""
    t = spark.range(240).selectExpr("id div 4 AS conv_id", "0 AS session_ord", "id % 4 AS turn_ord", "if(id % 2 = 0, 'user', 'assistant') AS speaker", "concat('words of turn ', id) AS text")
    out = experiment.run(t, str(tmp_path / "x"), providers.Scripted(lambda p: '{"answer": "yes"}'), providers.Scripted(lambda p: '{"rating": 50}'))
    for stage in ("chunks", "edges", "nodes", "rated", "retrieved"):
        files = [f for _, _, held in os.walk(tmp_path / "x" / stage) for f in held if f.endswith(".parquet")]
        assert 0 < len(files) <= 4
        assert out[stage].groupBy("conv_id").agg(F.countDistinct("_metadata.file_name").alias("n")).where("n > 1").isEmpty()
    assert out["chunks"].select("conv_id").distinct().count() == 60


def test_segments_by_prediction(spark):
    """Similarities 1, ..., 1, 2/3, 1/3, 0, 1, ... are smoothed to a valley one before the change, so the cut is at the eighth turn."""
    same, other = "the cat sat on the mat again today", "stock prices fell sharply in tokyo"
    said = [same] * 8 + [other] * 8
    t = spark.createDataFrame([(1, k, f"u: {x}.") for k, x in enumerate(said)], "conv_id int, turn int, line string")
    s = t.select("conv_id", "turn", F.lit(0).alias("p"), F.col("line").alias("sentence"))
    got = experiment.segment_by_prediction(t, s, providers.Scripted(lambda p: p[p.rindex("\n") + 1 :])).orderBy("segment").collect()
    assert [x.n_lines for x in got] == [7, 9] and got[1].chunk.startswith(f"u: {same}.\nu: {other}.")


def test_prompts_and_encodings_are_held_in_small_parts():
    """A batch of 1,000 prompts is answered in parts, and texts are encoded one by one: what a task holds does not grow with its batch."""
    import pandas as pd
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(1000))), pa.array([f"p{i}" for i in range(1000)]), pa.array(range(1000), pa.int64())], ["call_id", "__p", "input_tokens"])
    parts = list(providers._answers(iter([batch]), providers.Scripted(lambda p: None if p == "p7" else str(1 // (p != "p3"))), 4))
    assert len(parts) > 1 and max(x.num_rows for x in parts) <= providers.HELD
    whole = pa.Table.from_batches(parts).to_pydict()
    assert whole["call_id"] == [str(i) for i in range(1000)] and whole["status"].count("error") == 1 and whole["response"].count(None) == 2

    class Single:
        def encode(self, text, add_special_tokens):
            return text.split()

    assert providers._lengths(Single(), pd.Series(["a b", None, ""])).tolist() == [2, 0, 0]
