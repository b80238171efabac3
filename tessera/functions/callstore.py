"""A durable table of model responses, written before anything reads it.

Each stage of calls has a folder of Parquet rows keyed by the hash of what was asked.
``extend`` asks only for keys that have no good answer there, appends the answers in
one job, and reads the table back. So whatever is built on an answer, however often
it is evaluated, sees the same one; a rerun on the same path asks nothing again; and a
run that fails keeps the waves that it has written. Appends are idempotent: what is
appended is what was missing, and of two rows of one key (two runs at once, an error
that was asked again) one good row counts.

Totals of what a job asked come from ``DataFrame.observe`` in the pass that writes;
``ledger`` gives the totals of all that is stored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.plans.storage import checkpoint_dir, tasks


class CallStore:
    """Responses by stage under ``path``; without a path a folder of its own in the shared folder, for one run."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or f"{checkpoint_dir(spark)}/calls-{uuid.uuid4().hex}"
        self.observed: list[dict] = []  # stage, calls, errors, input_tokens, output_tokens of every job of this object

    def _folder(self, stage: str) -> str:
        return f"{self.path}/stage={stage}"

    def stored(self, stage: str, schema: str) -> DataFrame:
        """All rows of a stage as they were appended; before the first an empty table is made."""
        self.spark.createDataFrame([], schema).write.mode("ignore").parquet(self._folder(stage))
        return self.spark.read.schema(schema).parquet(self._folder(stage))

    def extend(self, todo: DataFrame, key: str, ask: Callable[[DataFrame], DataFrame], stage: str, schema: str, waves: int = 1) -> DataFrame:
        """The stage's rows, one a key, after ``ask`` has answered those of ``todo`` without a good one.

        ``ask`` turns rows of todo into rows of ``schema``: the key (a hash as text),
        status (``ok`` if it is good), input_tokens, output_tokens and others. todo is
        dealt by key once, or not at all if it is in ``storage.tasks`` buckets by it, and
        of rows of one key one is asked. Work goes in ``waves`` by the key, each a job of its own
        whose rows stay if a later one fails.
        """
        n = tasks(self.spark)
        for w in range(waves):
            good = self.stored(stage, schema).where("status = 'ok'").select(key)
            part = todo if waves == 1 else todo.where(F.pmod(F.xxhash64(key), F.lit(waves)) == w)
            seen = Observation(f"{stage}-{uuid.uuid4().hex}")
            total = lambda c: F.coalesce(F.sum(c), F.lit(0))
            made = ask(part.repartition(n, key).join(good, key, "left_anti").dropDuplicates([key])).observe(
                seen, F.count("*").alias("calls"), total(F.expr("int(status <> 'ok')")).alias("errors"), total(F.col("input_tokens")).alias("input_tokens"), total(F.col("output_tokens")).alias("output_tokens")
            )
            made.write.mode("append").parquet(self._folder(stage))
            self.observed.append({"stage": stage, **seen.get})
        return self._one_each(self.stored(stage, schema), key)

    @staticmethod
    def _one_each(rows: DataFrame, key: str) -> DataFrame:
        others = [c for c in rows.columns if c != key]
        best = F.min(F.struct((F.col("status") != "ok").alias("bad"), *others)).alias("best")
        return rows.groupBy(key).agg(best).select(key, *[F.col(f"best.{c}") for c in others])

    def ledger(self, stages: dict[str, str]) -> DataFrame:
        """stage, calls, errors, input_tokens, output_tokens, average of the stored answers; ``stages``: key column by stage."""
        out = None
        for stage, key in stages.items():
            rows = self._one_each(self.stored(stage, f"{key} string, status string, input_tokens long, output_tokens long"), key)
            total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
            t = rows.agg(F.count("*").alias("calls"), total(F.expr("int(status <> 'ok')")).alias("errors"), total(F.col("input_tokens")).alias("input_tokens"), total(F.col("output_tokens")).alias("output_tokens"))
            t = t.select(F.lit(stage).alias("stage"), "*", ((F.col("input_tokens") + F.col("output_tokens")) / F.greatest(F.lit(1), "calls")).alias("average"))
            out = t if out is None else out.unionByName(t)
        if out is None:
            raise ValueError("no stages")
        return out
