"""Column expressions over dialogue text: rendering, clean-up, sentence splitting, JSON extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, marks and factors that texts are read by.
SPACE = " \t\n\r\x0b\x0c"
SPEAKER_LINE = r"^([^:]+):\s*(.*)$"
SPEAKER_NAME = r"^[A-Za-z_ ]+:\s*"
IMAGE = r"(?i),?image:[^,\n]*"
EXAM_QUESTION = r"(?s)Now Answer the Question:\s*(.*?)\n[A-D]\."
TURN_ENDS, SPOKEN_ENDS, PLAIN_ENDS = ".?!？", ".?!。！？", ".?!。！？;；"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])"
FENCED_JSON, FENCED, BRACES = r"(?is)```json(.*?)```", r"(?s)```(.*?)```", r"(?s)(\{.*?\})"
TOKENS_PER_CHAR = 0.74


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def is_blank(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) == 0


def estimated_tokens(c: Column) -> Column:
    """ceil(0.74 * characters): the default, model-free token count."""
    return F.ceil(F.length(c) * F.lit(TOKENS_PER_CHAR).cast("double")).cast("bigint")


def turn_line(speaker: Column, text: Column) -> Column:
    """``speaker: text`` as chunkers join turns."""
    return F.concat(speaker, F.lit(": "), text)


def turn_with_image(speaker: Column, text: Column, img_url: Column, query: Column) -> Column:
    """``speaker:text``, stripped, with ``,image:query`` if the turn shares an image."""
    image = F.when(img_url.isNotNull() & query.isNotNull(), F.concat(F.lit(",image:"), query)).otherwise("")
    return F.concat(F.coalesce(speaker, F.lit("")), F.lit(":"), strip(F.coalesce(text, F.lit(""))), image)


def timed(ts: Column, content: Column, sep: str = " ") -> Column:
    """``time:... content:...``; a missing time is rendered as None."""
    return F.concat(F.lit("time:"), F.coalesce(ts, F.lit("None")), F.lit(sep + "content:"), content)


def chunk_text(v: Column) -> Column:
    """The text of a chunk given as a variant: the field ``chunk`` of an object (empty without it), else the value itself as text."""
    inner = F.coalesce(F.try_variant_get(v, "$.chunk", "string"), F.lit(""))
    return F.when(_is_object(v), inner).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("None")))


def chunk_time(v: Column) -> Column:
    """The time of a chunk given as a variant: the field ``timestamp`` of an object (empty without it, null if it is null), empty for other values."""
    there = F.try_variant_get(v, "$.timestamp", "variant").isNotNull()
    inner = F.when(there, F.try_variant_get(v, "$.timestamp", "string")).otherwise("")
    return F.when(_is_object(v), inner).otherwise("")


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def strip_speaker(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPEAKER_NAME, ""))


def remove_image(c: Column) -> Column:
    return strip(F.regexp_replace(c, IMAGE, ""))


def exam_question(c: Column) -> Column:
    """The question between its heading and the first option; null without one."""
    return F.when(c.rlike(EXAM_QUESTION), strip(F.regexp_extract(c, EXAM_QUESTION, 1)))


def _rendered(pieces: Column, speaker: Column | None, sep: str) -> Column:
    """Stripped pieces with their end marks; pieces that are only a mark go."""
    full = F.filter(pieces, lambda p: F.length(strip(F.substring(p, F.lit(1), F.length(p) - 1))) > 0)
    body = lambda p: F.concat(strip(F.substring(p, F.lit(1), F.length(p) - 1)), F.right(p, F.lit(1)))
    if speaker is None:
        return F.transform(full, body)
    return F.transform(full, lambda p: F.concat(speaker, F.lit(sep), body(p)))


def _pieces(c: Column, marks: str) -> Column:
    """Pieces that end with one of the marks. Splitting behind marks is linear even in long texts without any."""
    return F.filter(F.split(c, f"(?<=[{marks}])"), lambda p: F.instr(F.lit(marks), F.right(p, F.lit(1))) * F.length(p) > 0)


def turn_sentences(line: Column, min_chars: int = 0) -> Column:
    """Sentences of one rendered line as an array.

    ``speaker:sentence`` for each terminated sentence of a speaker line; any other
    line stays whole. Unterminated tails go. ``min_chars`` counts what is rendered.
    """
    speaker, content = F.regexp_extract(line, SPEAKER_LINE, 1), F.regexp_extract(line, SPEAKER_LINE, 2)
    out = F.when(line.rlike(SPEAKER_LINE), _rendered(_pieces(content, TURN_ENDS), speaker, ":")).otherwise(F.array(line))
    return F.filter(out, lambda s: F.length(s) >= min_chars) if min_chars else out


def graph_sentences(rows: DataFrame, keys: list[str], text: str, min_chars: int = 30) -> DataFrame:
    """keys, line_idx, piece_idx, sentence: sentences of chunks, line by line; lines without a speaker also end at semicolons.

    Lines and pieces are exploded, so each expression is evaluated once per row.
    """
    lines = rows.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("line_idx", "__l")).withColumn("__l", strip(F.col("__l"))).where(F.length("__l") > 0)
    spoken = F.col("__l").rlike(SPEAKER_LINE)
    lines = lines.withColumn("__lead", F.when(spoken, F.concat(F.regexp_extract("__l", SPEAKER_LINE, 1), F.lit(": "))).otherwise(""))
    pieces = F.when(spoken, _pieces(F.regexp_extract("__l", SPEAKER_LINE, 2), SPOKEN_ENDS)).otherwise(_pieces(F.col("__l"), PLAIN_ENDS))
    p = lines.select(*keys, "line_idx", "__lead", F.posexplode(pieces).alias("piece_idx", "__p"))
    p = p.withColumn("__b", strip(F.substring("__p", F.lit(1), F.length("__p") - 1))).where(F.length("__b") > 0)
    out = p.select(*keys, "line_idx", "piece_idx", F.concat("__lead", "__b", F.right("__p", F.lit(1))).alias("sentence"))
    return out.where(F.length("sentence") >= min_chars)


def split_sentences(text: Column) -> Column:
    """Pieces for sentence-preserving packing: at sentence ends before a capital, else at line ends."""
    # as the element of an array, so that the pattern runs once a text and not in the condition and in the result
    lines = F.split(text, "\n")
    return F.transform(F.array(F.split(text, SENTENCE_END)), lambda pieces: F.when(F.size(pieces) > 1, pieces).otherwise(lines))[0]


def extract_json(c: Column) -> Column:
    """Tolerant JSON extraction to a variant: fenced json block, any fenced block, the whole text, the first {...}."""
    block1 = F.nullif(strip(F.regexp_extract(c, FENCED_JSON, 1)), F.lit(""))
    block2 = F.nullif(strip(F.regexp_extract(c, FENCED, 1)), F.lit(""))
    brace = F.nullif(F.regexp_extract(c, BRACES, 1), F.lit(""))
    return F.coalesce(*[F.try_parse_json(x) for x in (block1, block2, c, brace)])


def json_field(parsed: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(parsed, path, kind)
