"""Extra columns keep their values, whatever they are called."""

import pytest

from tessera.llm import decontam, line_dedup, ngram_join, packing, toxicity

NAMES = "__id __tk __doc __row __drop __n_lines __kept __t __d __k c seed shard n_words score keep".split()


@pytest.fixture(scope="module")
def clashing(spark):
    line = "A line that is long enough to be counted, on six pages."
    rows = [(i, f"{line}\nown text {i} of page {i}") for i in range(6)] + [(7, None), (None, "x")]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(i, t, *[f"{n}-{i}" for n in NAMES]) for i, t in rows], schema)


def extras(df):
    return {x.doc_id: tuple(x[n] for n in NAMES) for x in df.collect()}


def test_columns_survive(spark, clashing):
    want = {i: tuple(f"{n}-{i}" for n in NAMES) for i in [0, 1, 2, 3, 4, 5, 7, None]}
    bench = spark.createDataFrame([(1, "own text 3 of page 3", "b")], "item_id long, text string, __doc string")
    labels = spark.createDataFrame([(1, 0, "l"), (2, 1, "l")], "doc_id long, toxic int, __d string")
    deduped = line_dedup.dedup(clashing)
    assert deduped.columns == clashing.columns and extras(deduped) == want
    assert sum("counted" in (x.text or "") for x in deduped.collect()) == 1
    joined = ngram_join.keep_one(clashing)
    assert joined.columns == clashing.columns and extras(joined) == want
    clean = decontam.clean(clashing, bench)
    assert clean.columns == clashing.columns
    assert extras(clean) == {k: v for k, v in want.items() if k != 3}
    kept = toxicity.reject_toxic(clashing, toxicity.train(clashing, labels))
    assert kept.columns == clashing.columns and extras(kept).items() <= want.items()
    assert packing.pack(clashing).count() > 0
