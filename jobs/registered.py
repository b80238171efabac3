"""The jobs as queries: each runs twice into one new folder, and returns what stands there after the second run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import evaluate_methods, ingest_memory
from tessera.catalogue import CHUNKS2, EMBED, QUESTIONS, ranked_sql
from tessera.plans.storage import checkpoint_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_ingest_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory graph of all conversations, taken by a file stream (a pattern, as the table may be one file or a folder of files)."""
    at = _folder(spark, "job1")
    for _ in range(2):
        out = ingest_memory.run(spark, f"{sf_dir}/conversations.parquet*", f"{at}/out", f"{at}/checkpoint")
    return out.select("conv_id", "kind", "node", "other", "weight", "text", "n", F.col("part").cast("int").alias("part"))


def job2_evaluate_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question, answered and rated for three ways to chunk."""
    at = _folder(spark, "job2")
    for _ in range(2):
        out = evaluate_methods.run(spark, f"{sf_dir}/conversations.parquet", at)
    return out.select("method", "conv_id", "turn", "answer", "status", "rating")


_MEMORY_SQL = f"""WITH {CHUNKS2}, {EMBED.format(name='ne', ids='conv_id, block', text='chunk', source='chunks')},
edges AS (SELECT a.conv_id, a.block AS i, b.block AS j, round(sum(a.weight * b.weight), 6) AS w FROM ne a JOIN ne b ON a.conv_id = b.conv_id AND a.bucket = b.bucket AND a.block < b.block GROUP BY ALL HAVING round(sum(a.weight * b.weight), 6) > 0.5),
m AS (SELECT conv_id, 'dialogue' AS kind, NULL::BIGINT AS node, NULL::BIGINT AS other, NULL::DOUBLE AS weight, NULL::VARCHAR AS text, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1
  UNION ALL SELECT conv_id, 'node', block, NULL, NULL, chunk, length(chunk) FROM chunks UNION ALL SELECT conv_id, 'edge', i, j, w, NULL, NULL FROM edges)
SELECT conv_id, kind, CAST(node AS BIGINT) AS node, CAST(other AS BIGINT) AS other, weight, text, CAST(n AS BIGINT) AS n, CAST(conv_id % 16 AS INTEGER) AS part FROM m"""


def _rated_sql() -> str:
    line = lambda c: f"trim(regexp_replace({c}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
    rows = " UNION ALL ".join(
        f"""(WITH {ranked_sql(2 * rounds)}, ctx AS (SELECT conv_id, turn, string_agg(chunk, chr(10) ORDER BY rk) AS context FROM ranked WHERE rk <= 3 GROUP BY ALL)
SELECT '{method}' AS method, qs.conv_id, qs.turn, truth, split_part(coalesce(context, ''), chr(10), 1) AS answer FROM qs LEFT JOIN ctx USING (conv_id, turn))"""
        for method, rounds in (("turn", 1), ("double", 2), ("session", 100))
    )
    return f"""WITH q0 AS (SELECT * FROM (WITH {QUESTIONS} SELECT * FROM qs)),
qs AS (SELECT conv_id, turn, {line("question")} AS question, {line("answer")} AS truth FROM q0),
a AS ({rows}),
w AS (SELECT *, list_distinct(regexp_extract_all(lower(coalesce(truth, '')), '[a-z]+')) AS want, list_distinct(regexp_extract_all(lower(answer), '[a-z]+')) AS said FROM a)
SELECT method, conv_id, turn, answer, 'ok' AS status, CASE WHEN len(want) > 0 THEN CAST(1 + 99 * len(list_intersect(want, said)) // len(want) AS DOUBLE) END AS rating FROM w"""


QUERIES = {f.__name__: f for f in (job1_ingest_memory, job2_evaluate_methods)}
ORACLES = {"job1_ingest_memory": _MEMORY_SQL, "job2_evaluate_methods": _rated_sql()}
