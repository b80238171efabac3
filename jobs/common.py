"""What the jobs' command lines share."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def config(name: str, path: str | None = None, **given) -> dict:
    """The job's config file (the one beside it, or another), with what is given on top."""
    return json.loads(Path(path or Path(__file__).with_name(f"{name}.json")).read_text()) | {k: v for k, v in given.items() if v is not None}


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"tessera.jobs.{name}")


def session(name: str) -> SparkSession:
    """For command lines only: the jobs themselves are given a session."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def stored(spark: SparkSession, path: str, schema: str, *parts: str) -> DataFrame:
    """A table as a job left it; before its first run an empty one is made there."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*parts).parquet(path)
    return spark.read.schema(schema).parquet(path)
