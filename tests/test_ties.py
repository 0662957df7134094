"""Queries on tables of which many rows are as far from their medians as another, but for the last bit."""

import datetime as dt
import random

import duckdb
import pytest

from rastertime.plans import catalog
from tests.compare import same
from tests.conftest import SF


@pytest.mark.parametrize("name, month, years", [("composite_medoid", 6, 1), ("composite_wrapped_medoid", 10, 1), ("recipe_landsat", 6, 5)])
def test_medoids_of_two_observations(spark, tmp_path, name, month, years):
    rng = random.Random(5)
    rows = [
        (rng.randrange(10**6), rng.randrange(20_000), px, rng.choice([1, 5]), float(rng.randrange(1, 51)), round(rng.uniform(900, 105_000), 2), rng.randrange(11) / 100, rng.randrange(9) / 100, "A", "O", dt.datetime(1996 + y, month, 10) + dt.timedelta(days=rng.randrange(100)))
        for px in range(12_000 // years) for y in range(years) for _ in range(2)
    ]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{SF}/supplier.parquet')")
    same(catalog.queries()[name](spark, str(tmp_path)), con, catalog.oracle_sql()[name])
