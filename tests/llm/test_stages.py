"""The pipeline's stages on awkward and on empty tables, with extra columns whose names clash."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.util import empty, frame, odd

STAGES = ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]


def stage(name):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)[name]


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in ("size", "predicted", "shard", "taken", "copies", "component_id", "kept", "similarity", "u", "tie")})


@pytest.mark.parametrize("name", STAGES)
def test_awkward_rows(spark, name):
    docs = clashing(odd(spark))
    out = stage(name)(spark, docs, SF)
    rows = out.collect()
    assert len(set(out.columns)) == len(out.columns)
    if name == "sharding":
        assert len(rows) == docs.count() and set(docs.columns) <= set(out.columns)
    else:
        assert out.columns == docs.columns
    if name in ("toxicity", "decontamination"):
        assert len(rows) == docs.count()
    if name == "near_dedup":
        assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 2, 3, 4, 5, 7, 8]
    if name == "mixing":
        assert all(n <= 2 * 3 for n in Counter(r.doc_id for r in rows).values())  # one id stands in two rows


@pytest.mark.parametrize("name", STAGES)
def test_empty_table(spark, name):
    assert stage(name)(spark, empty(spark), SF).count() == 0


def test_benchmark_copies_and_near_copies_go(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    base = [f"w{i}" for i in range(200)]
    docs = frame(spark, [(1, "before " + item + " after"), (2, " ".join(base)), (3, " ".join([*base[:50], "x", *base[51:]])), (4, "clean words only here"), (5, item.upper())])
    assert sorted(r.doc_id for r in stage("decontamination")(spark, docs, SF).collect()) == [2, 3, 4]
    assert sorted(r.doc_id for r in stage("near_dedup")(spark, docs, SF).collect()) == [1, 2, 4]  # the item alone is nearly all of 1
