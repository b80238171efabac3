"""Joins that dialogues need: time of a chunk, evidence of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import remove_image, strip, strip_speaker
from tessera.operators.chunking import first_line, ordered_join
from tessera.operators.ordering import numbered


def session_bodies(turns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, session_ord, date_time, body: a session's stripped texts, joined by line ends."""
    rows = turns.withColumn("__t", strip(F.col("text")))
    return rows.groupBy(*keys, "session_ord", "date_time").agg(ordered_join("turn_ord", "__t", "\n").alias("body"))


def _word_pairs(words: Column) -> Column:
    """Hashes of the distinct pairs of neighbouring words."""
    at = F.sequence(F.lit(1), F.size(words) - 1)
    return F.when(F.size(words) > 1, F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1)))))


def holders(anchors: DataFrame, bodies: DataFrame, key: str, own: list[str], direct: int = 16) -> DataFrame:
    """own, __s: the sessions (__s) of its key that may contain an anchor, none that does left out.

    anchors: key, own, anchor; bodies: key, __s, body. Of an anchor, every word but the
    first and the last must be a word of the body, so each pair of neighbours among
    them must be one of the body's. The pair that fewest sessions of the key have looks
    up the sessions; if no session has one of the pairs, none contains the anchor.
    Anchors of fewer than four words, and those of keys of at most ``direct`` sessions
    (where an index costs more than it saves), are looked for in every session of their
    key; null ones are nowhere.
    """
    few = bodies.groupBy(key).agg((F.count("*") <= direct).alias("__few"))
    words = F.split("anchor", " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    a = anchors.where("anchor is not null").join(few, key).withColumn("__pairs", F.when(~F.col("__few"), _word_pairs(inner)))
    every = a.where("__pairs is null").select(*own).join(bodies.select(key, "__s"), key).select(*own, "__s")
    many = bodies.join(few.where("not __few"), key)
    index = many.select(key, "__s", F.explode(_word_pairs(F.split("body", " "))).alias("__p"))
    held = index.groupBy(key, "__p").agg(F.count("*").alias("__n"))
    asked = a.where("__pairs is not null").select(*own, F.explode("__pairs").alias("__p")).join(held, [key, "__p"], "left")
    rarest = asked.groupBy(*own).agg(F.min(F.struct(F.coalesce("__n", F.lit(0)), "__p")).alias("__r")).select(*own, F.col("__r.__p").alias("__p"))
    return rarest.join(index, [key, "__p"]).select(*own, "__s").unionByName(every)


def attach_times(chunks: DataFrame, bodies: DataFrame, key: str = "conv_id", ids: tuple[str, ...] = ("session_ord", "block"), direct: int = 16) -> DataFrame:
    """chunks with ``timestamp``: the time of the conversation's first session that contains the chunk's anchor.

    (key, ids) tell chunks apart. The anchor is the chunk's first line without its
    image and speaker. Sessions are looked up by the anchor's rarest pair of words
    (``holders``), then tested; nothing found gives null.
    """
    own = [key, *ids]
    c = chunks.withColumn("anchor", strip_speaker(remove_image(first_line(F.col("chunk")))))
    named = bodies.select(key, F.col("session_ord").alias("__s"), "date_time", "body")
    found = holders(c.select(*own, "anchor"), named, key, own, direct)
    hit = found.join(c.select(*own, "anchor"), own).join(named, [key, "__s"]).where(F.contains("body", "anchor"))
    first = hit.groupBy(*own).agg(F.min_by("date_time", "__s").alias("timestamp"))
    return c.join(first, own, "left")


def resolve_evidence(qa: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, q_ord, evidence texts in order; questions without any are dropped."""
    ids = qa.where("answer is not null and answer <> ''").select("conv_id", "q_ord", "question", F.posexplode("evidence").alias("ev_ord", "dia_id"))
    hit = ids.join(turns.select("conv_id", "dia_id", "text"), ["conv_id", "dia_id"])
    return hit.groupBy("conv_id", "q_ord", "question").agg(F.transform(F.array_sort(F.collect_list(F.struct("ev_ord", "text"))), lambda x: x["text"]).alias("evidence"))


def questions(turns: DataFrame, spread: bool = False) -> DataFrame:
    """conv_id, turn_ord, question, answer: every user turn and the turn after it (null if none follows).

    ``spread``: conversations may be of any length; the next turn comes by a join on its place and not by a window.
    """
    if spread:
        at = numbered(turns.select("conv_id", "turn_ord", "speaker", "text"), ["conv_id"], ["turn_ord"])
        after = at.select("conv_id", (F.col("rn") - 1).alias("rn"), F.col("text").alias("answer"))
        rows = at.where("speaker = 'user'").join(after, ["conv_id", "rn"], "left")
    else:
        rows = turns.withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn_ord"))).where("speaker = 'user'")
    return rows.select("conv_id", "turn_ord", F.col("text").alias("question"), "answer")
