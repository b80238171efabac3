"""Incremental forms on small streams."""

from tessera.operators import chunking
from tessera.streaming.incremental import append_edges, sessions
from tessera.streaming.packing import pack_stream


def test_sessions_of_a_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:05:00"), (9, "2024-01-03 00:00:00")]
    table = spark.createDataFrame(rows, "user_id int, ts string").selectExpr("user_id", "cast(ts as timestamp) AS ts")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = sessions(stream).writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r.user_id, r.n) for r in spark.table("sess").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]  # user 9's session is still open
    assert sorted((r.user_id, r.n) for r in sessions(table).collect()) == [*got, (9, 1)]


def test_edges_of_new_nodes(spark, tmp_path):
    add = append_edges(str(tmp_path / "g"), 0.5)
    schema = "conv_id int, node int, v array<float>"
    add(spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.9, 0.1]), (1, 5, [1.0, 0.0])], schema), 0)
    add(spark.createDataFrame([(0, 2, [1.0, 0.0]), (0, 3, [0.0, 1.0])], schema), 1)
    add(spark.createDataFrame([(0, 2, [1.0, 0.0]), (0, 3, [0.0, 1.0])], schema), 1)  # a replayed batch
    add(spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.9, 0.1]), (1, 5, [1.0, 0.0])], schema), 0)
    assert spark.read.parquet(str(tmp_path / "g/nodes")).count() == 5
    got = sorted((r.conv_id, r.src, r.dst) for r in spark.read.parquet(str(tmp_path / "g/edges")).collect())
    assert got == [(0, 0, 1), (0, 0, 2), (0, 1, 2)]


def test_packing_a_stream_in_batches(spark, tmp_path):
    """Three batches give the chunks of the whole table, the last of each key once the watermark is past its end."""
    import random

    r = random.Random(6)
    rows = [(c, t, " ".join(["word"] * r.randrange(1, 30)), f"2024-01-01 {t // 10:02d}:{t % 10 * 5:02d}:00") for c in range(6) for t in range(60)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, t string, at string").selectExpr("conv_id", "turn", "t", "length(t) AS cost", "cast(at AS timestamp) AS ts")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")

    def run():
        q = pack_stream(stream, "conv_id", "turn", "t", "cost", "ts", 300, sep=1, late="3 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    for part in ("turn < 21", "turn >= 21 and turn < 40 and conv_id <> 3", "turn >= 40 or turn >= 21 and conv_id = 3"):
        table.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = run()
    whole = sorted(map(tuple, chunking.pack(table.select("conv_id", "turn", "t", "cost"), ["conv_id"], "turn", "t", "cost", 300, sep=1).collect()))
    assert set(got) < set(whole) and len(whole) - len(got) == 6  # all but the open chunks
    later = spark.createDataFrame([(99, 0, "end", "2024-01-03 00:00:00")], "conv_id long, turn long, t string, at string").selectExpr("conv_id", "turn", "t", "length(t) AS cost", "cast(at AS timestamp) AS ts")
    later.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert [x for x in run() if x[0] != 99] == whole
