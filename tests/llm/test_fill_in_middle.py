"""Units, cuts and forms against a plain version; the texts come back whole."""

import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import fill_in_middle as fim


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_row(doc_id, text):
    """The contract, one step at a time over a list of units."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    if doc_id is None or text == "" or "<P>" in text or "<S>" in text or "<M>" in text:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    h1, h2, h3, h4 = (int(x, 16) for x in re.findall("." * 8, sha(f"1:{doc_id}"))[:4])
    if h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    one, two = h1 % (len(units) + 1), h2 % (len(units) + 1)
    prefix, middle, suffix = "".join(units[: min(one, two)]), "".join(units[min(one, two) : max(one, two)]), "".join(units[max(one, two) :])
    if h4 % 100 < 20:
        return doc_id, len(units), "spm", len(prefix), len(middle), sha(f"<S>{suffix}<P>{prefix}<M>{middle}"), sha(text)
    return doc_id, len(units), "psm", len(prefix), len(middle), sha(f"<P>{prefix}<S>{suffix}<M>{middle}"), sha(text)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    out = [(i, "".join(r.choice(["word", "Ab", " ", "\n", "é", "漢", "😀", "0", "<", "S>", "\r"]) for _ in range(r.randrange(40)))) for i in range(400)]
    out += [(500, None), (501, ""), (None, "no id"), (None, None), (502, "x<P>y"), (503, "<M>"), (504, "<S"), (3, "another text"), (4, out[4][1]), (4, out[4][1])]
    return [*out, (600, "long é word, " * 100_000), (601, "a" * 300_000), (602, "." * 300_000), (2**60 + 1, "a wide id")]


def test_digests_against_plain(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(x) for x in fim.digest(docs.repartition(3)).collect()]
    want = [plain_row(i, t) for i, t in rows]
    assert Counter(got) == Counter(want)
    forms = Counter(x[2] for x in want)
    assert forms["psm"] > forms["spm"] > 20 and forms["plain"] > 20


def test_outputs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fim.transform(docs, seed=9, plain_percent=0, spm_percent=50).collect()
    for x in out:
        assert fim.restore(x.output, x.form) == (x.text or "")
        assert x.output_sha256 == sha(x.output) and x.restored_sha256 == sha(x.text or "")
        if x.form != "plain":
            prefix = x.output[3:] if x.form == "psm" else x.output.split("<P>", 1)[1]
            assert prefix[: x.prefix_chars] == x.text[: x.prefix_chars]
            assert x.output.endswith("<M>" + x.text[x.prefix_chars : x.prefix_chars + x.middle_chars])
    assert {x.form for x in fim.transform(docs, plain_percent=100).collect()} == {"plain"}
    with pytest.raises(ValueError):
        fim.transform(docs, plain_percent=101)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab<>PSM é\n", max_size=30), st.integers(0, 50), st.integers(0, 100))
def test_texts_come_back(text, doc_id, spm_below):
    _, form, _, _, output = fim.arrange(text, str(doc_id), 1, 100, spm_below)
    assert fim.restore(output, form) == text
    assert list(fim.unit_ends(text)) == [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]


def test_edges(spark):
    assert fim.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    names = "row fim ids texts h".split()
    docs = spark.createDataFrame([(i, "some text", *[f"{x}{i}" for x in names], "mine") for i in range(5)], "doc_id long, text string, " + ", ".join(f"{x} string" for x in names) + ", form string")
    out = fim.transform(docs)
    assert out.columns == ["doc_id", "text", *names, "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
    assert sorted(tuple(x)[2:7] for x in out.collect()) == [tuple(f"{x}{i}" for x in names) for i in range(5)]
