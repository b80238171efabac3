"""Fill-in-middle transformation of documents.

A text is cut into units (a run of A-Z and a-z, or one other code point). Two places
between units, drawn from the document's own digest, part it into prefix, middle and
suffix, which are written in the order prefix-suffix-middle (psm) or
suffix-prefix-middle (spm), each led by its mark; some documents stay plain. Draws
depend on the seed and the doc_id alone, so neither partitions nor retries change them.

An Arrow-batched pandas UDF does a batch of rows at a time: a regex's ``finditer``
fills a compact array with the ends of the units, two look-ups in it give the cuts.
There is no shuffle, and a task holds one batch of rows.

Defined results: a null or empty text is empty, has no units and is plain; so is a
text that holds a mark itself (it could not be rebuilt) and a row without a doc_id
(it has no draws). Repeated rows are transformed alike. Columns of the documents pass
through whatever their names; only one named like a column of the result is replaced.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# The units of a text and the marks of its parts.
UNIT = "[A-Za-z]+|[^A-Za-z]"
MARKS = ("<P>", "<S>", "<M>")

RESULT = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


@cache
def _unit() -> regex.Pattern:
    return regex.compile(UNIT)


def unit_ends(text: str) -> array:
    """The code points before the end of each unit of a text, in order."""
    return array("I" if len(text) < 1 << 32 else "Q", (m.end() for m in _unit().finditer(text)))


def draws(doc_id: str, seed: int) -> list[int]:
    """Four numbers below 2**32 that a document draws."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def arrange(text: str, doc_id: str | None, seed: int, plain_from: int, spm_below: int) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle (None if plain), output."""
    ends = unit_ends(text)
    n = len(ends)
    if not text or doc_id is None or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    h1, h2, h3, h4 = draws(doc_id, seed)
    if h3 % 100 >= plain_from:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (i, j))
    prefix, middle, suffix = MARKS[0] + text[:a], MARKS[2] + text[a:b], MARKS[1] + text[b:]
    if h4 % 100 < spm_below:
        return n, "spm", a, b - a, suffix + prefix + middle
    return n, "psm", a, b - a, prefix + suffix + middle


def restore(output: str, form: str) -> str:
    """The text that an output was made of. No part holds a mark, so the first of each is the one that was set."""
    if form == "plain":
        return output
    first, second = (MARKS[0], MARKS[1]) if form == "psm" else (MARKS[1], MARKS[0])
    head, middle = output.split(MARKS[2], 1)
    one, two = head[len(first) :].split(second, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, with_output: bool = True) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, if asked, output.

    ``plain_percent`` of the documents stay plain; ``spm_percent`` of the others are
    spm. restored_sha256 is the digest of the text as rebuilt from output and form.
    """
    if not (0 <= plain_percent <= 100 and 0 <= spm_percent <= 100):
        raise ValueError("shares must be from 0 to 100")
    schema = RESULT + (", output string" if with_output else "")
    names = [x.split()[0] for x in schema.split(", ")]

    @pandas_udf(schema)
    def fim(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = []
            for doc_id, text in zip(ids, texts):
                n, form, before, inside, output = arrange(text or "", doc_id, seed, 100 - plain_percent, spm_percent)
                rows.append((n, form, before, inside, _sha256(output), _sha256(restore(output, form)), *([output] if with_output else [])))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    own = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    made = docs.select(F.struct(*own).alias("row"), fim(F.col("doc_id").cast("string"), F.col("text")).alias("fim"))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in names]
    return made.select(*kept, "fim.*")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id and the digest columns of ``transform``; the outputs themselves do not leave the tasks."""
    return transform(docs.select("doc_id", "text"), with_output=False).select("doc_id", *[x.split()[0] for x in RESULT.split(", ")])


def oracle() -> str:
    """The same in SQL."""
    part = lambda k: f"('0x' || substr(s, {1 + 8 * k}, 8))::BIGINT"
    held = " OR ".join(f"contains(text, '{m}')" for m in MARKS)
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS u, sha256('1:' || doc_id) AS s FROM documents),
h AS (SELECT *, len(u) AS n, {part(0)} % (len(u) + 1) AS a, {part(1)} % (len(u) + 1) AS b,
  CASE WHEN s IS NULL OR text = '' OR {held} OR {part(2)} % 100 >= 90 THEN 'plain' WHEN {part(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (SELECT *, CASE WHEN least(a, b) = 0 THEN '' ELSE array_to_string(u[1:least(a, b)], '') END AS x, CASE WHEN greatest(a, b) = n THEN '' ELSE array_to_string(u[greatest(a, b) + 1:n], '') END AS z FROM h),
p AS (SELECT *, substr(text, length(x) + 1, length(text) - length(x) - length(z)) AS y FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
