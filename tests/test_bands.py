import pytest
from pyspark.sql import functions as F

from rastertime.functions import bands as B
from rastertime.functions import dates as D
from rastertime.functions import harmonize as H
from rastertime.functions import masks as M


def one(spark, expr, /, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'double' if v is None or isinstance(v, float) else 'int'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("a", "b", "c", "total"), [(1.0, 2.0, 3.0, 6.0), (1.0, None, 3.0, 4.0), (None, None, None, None), (0.0, 0.0, None, 0.0)])
def test_row_sum_skips_nulls(spark, a, b, c, total):
    assert one(spark, B.row_sum(["a", "b", "c"]), a=a, b=b, c=c) == total


def test_mask_algebra(spark):
    assert one(spark, B.self_mask("a"), a=0) is None
    assert one(spark, B.unmask("a", 5.0), a=None) == 5.0
    assert one(spark, B.where("a", F.col("b") > 0, F.col("c")), a=1.0, b=1.0, c=None) == 1.0
    assert one(spark, B.where("a", F.col("b") > 0, F.col("c")), a=1.0, b=None, c=9.0) == 1.0
    assert one(spark, B.strict_least(F.col("a"), F.col("b")), a=1.0, b=None) is None
    assert one(spark, B.normalized_difference("a", "b"), a=0.0, b=0.0) is None
    assert one(spark, B.saturating_cast(F.col("a"), "short"), a=70000.0) == 32767
    assert one(spark, B.saturating_cast(F.col("a"), "byte"), a=-3.0) == 0
    assert one(spark, B.clamp(F.col("a"), 0, 1), a=None) is None


def test_bits(spark):
    assert one(spark, M.qa_bits(F.col("a"), 2, 4), a=0b10100) == 0b101
    assert one(spark, M.bit_clear(F.col("a"), 3), a=8) is False


@pytest.mark.parametrize(("first", "last", "want"), [(152, 151, (365, 0)), (300, 60, (365, 0)), (350, 60, (365, 1)), (100, 200, (0, 0))])
def test_wrap_dates(first, last, want):
    assert D.wrap_dates(first, last) == want


def test_harmonisation_goes_both_ways(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.3, 0.4, 0.5, 0.6)], ", ".join(f"{b} double" for b in H.SIX))
    back = H.chastain(H.chastain(df, "MSI", "OLI"), "OLI", "MSI").first()
    assert all(abs(back[b] - v) < 1e-12 for b, v in zip(H.SIX, df.first()))
    with pytest.raises(ValueError):
        H.chastain(df, "MSI", "TM")


def test_hsv(spark):
    rgb = one(spark, B.hsv_to_rgb(F.lit(1 / 3), F.lit(1.0), F.lit(1.0)), a=1)
    assert (round(rgb.r, 9), round(rgb.g, 9), round(rgb.b, 9)) == (0, 1, 0)
