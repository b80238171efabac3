"""Stages of a run that can be taken up again: each is a table, known by what it was made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "stage string, fingerprint string, schema string, rows long"


def checksum(rows: DataFrame) -> str:
    """A fingerprint of a table's columns and rows, whatever their order and partitions (map columns do not count)."""
    names = [c for c, kind in rows.dtypes if not kind.startswith("map")]
    h = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    got = rows.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).alias("s")).first()
    return hashlib.sha256(repr((rows.dtypes, tuple(got))).encode()).hexdigest()


class Stages:
    """Tables under ``path``, one folder a stage and fingerprint, and a manifest of the whole ones.

    A stage's fingerprint covers its name, its parameters and the fingerprints of the
    stages it is made from; the first ones name a checksum of their input among their
    parameters. A stage in the manifest is read and not made. The manifest gets its row
    after the stage's table is whole, so what a lost run left half is made again. Other
    parameters make other folders, and lead back to the old ones if they come again.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.marks: dict[str, str] = {}
        self.made: list[str] = []  # the stages that this object has made and not found
        spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(f"{path}/manifest")
        self._whole = {(r.stage, r.fingerprint): r.schema for r in self.manifest().collect()}  # a row a stage and set of parameters

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")

    def keep(self, stage: str, make: Callable[[], DataFrame], *after: str, by: str | None = None, **params) -> DataFrame:
        """The stage's table, made from the stages ``after`` it names, partitioned by the column ``by``."""
        mark = hashlib.sha256(json.dumps([stage, params, [self.marks[a] for a in after]], sort_keys=True).encode()).hexdigest()
        self.marks[stage] = mark
        folder = f"{self.path}/{stage}/{mark[:20]}"
        if (stage, mark) not in self._whole:
            rows = make()
            fields = [f for f in rows.schema.fields if f.name != by] + [f for f in rows.schema.fields if f.name == by]
            schema = T.StructType(fields).json()
            writer = rows.write.mode("overwrite")
            (writer.partitionBy(by) if by else writer).parquet(folder)
            n = self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(folder).count()
            self.spark.createDataFrame([(stage, mark, schema, n)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
            self._whole[stage, mark] = schema
            self.made.append(stage)
        return self.spark.read.schema(T.StructType.fromJson(json.loads(self._whole[stage, mark]))).parquet(folder)
