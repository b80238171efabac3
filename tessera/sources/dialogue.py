"""Sources and sinks: nested dialogue JSON to normalised tables, graphs to Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "array<struct<speaker:string,text:string,dia_id:string,img_url:string,query:string>>"
QA = "array<struct<question:string,answer:string,category:int,evidence:array<string>>>"


def read_dialogues(spark: SparkSession, path: str, lines: bool = False, id_key: str | None = None) -> DataFrame:
    """conv_id, conversation (map of JSON values by key), qa: one row per dialogue.

    The keys of a conversation are data, so it is read as a map and not as a struct.
    A file is a JSON array (one task a file), or with ``lines`` has a dialogue a line
    and is cut between tasks. ``id_key``: the key of the dialogue's own number or name,
    which is the same however the files are cut; without it conv_id is any number.
    """
    schema = T.StructType([T.StructField("conversation", T.MapType(T.StringType(), T.StringType())), T.StructField("qa", T.StringType())])
    if id_key is not None:
        schema = schema.add(id_key, T.StringType())
    raw = spark.read.option("multiLine", not lines).option("mode", "PERMISSIVE").schema(schema).json(path)
    own = F.monotonically_increasing_id() if id_key is None else F.col(f"`{id_key}`")
    return raw.select(own.alias("conv_id"), "conversation", F.from_json("qa", QA).alias("qa"))


def sessions(dialogues: DataFrame) -> DataFrame:
    """conv_id, session_ord, session_key, date_time, turns: ``session_*`` keys paired with their ``_date_time``."""
    entries = F.map_entries("conversation")
    dated = F.filter(entries, lambda e: e["key"].startswith("session_") & e["key"].endswith("_date_time"))
    rows = dialogues.select("conv_id", "conversation", F.posexplode(dated).alias("session_ord", "e"))
    key = F.regexp_replace(F.col("e.key"), "_date_time$", "")
    turns = F.coalesce(F.from_json(F.try_element_at("conversation", key), TURN), F.array().cast(TURN))
    return rows.select("conv_id", F.col("session_ord").cast("int"), key.alias("session_key"), F.col("e.value").alias("date_time"), turns.alias("turns"))


def turns(sessions_: DataFrame) -> DataFrame:
    return sessions_.select("conv_id", "session_ord", "date_time", F.posexplode("turns").alias("turn_ord", "t")).select("conv_id", "session_ord", "turn_ord", "date_time", "t.*")


def questions(dialogues: DataFrame) -> DataFrame:
    """conv_id, q_ord, question, answer, category, evidence of the questions that have an answer."""
    rows = dialogues.select("conv_id", F.posexplode("qa").alias("q_ord", "q")).select("conv_id", "q_ord", "q.*")
    return rows.where(F.col("answer").isNotNull())


def from_table(conversations: DataFrame) -> DataFrame:
    """The test bed's conversations as turns: one conversation is one session, without images."""
    return conversations.select("conv_id", F.lit(0).alias("session_ord"), F.col("turn").alias("turn_ord"), F.col("role").alias("speaker"), "text")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows that do not parse become nulls; a missing path is the reader's error."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def markdown(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One ``| key | 0.1234 | ... |`` line per row."""
    cells = [F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("")) for c in columns]
    return table.select(key, F.concat(F.lit("| "), F.concat_ws(" | ", F.col(key), *cells), F.lit(" |")).alias("line"))
