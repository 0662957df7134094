"""Where the query modules put their queries: name -> (function of session and folder, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertime.sources.observations import GRID_SQL, OBS_SQL, observations

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}
#: What names an observation in the results.
KEYS = ["px", "ok", "ln", "pk", "yr", "doy"]
KEYS_SQL = ", ".join(KEYS)


def query(sql: str | None = None, obs: bool = True):
    """Registers a function under its name. ``sql`` may use the views obs and grid."""

    def keep(fn: Query) -> Query:
        text = sql
        if sql is not None and obs:
            recursive = sql.lstrip().startswith("WITH RECURSIVE ")
            rest = sql.lstrip().removeprefix("WITH RECURSIVE " if recursive else "WITH ")
            more = ",\n" if sql.lstrip().startswith("WITH ") else "\n"
            text = f"WITH {'RECURSIVE ' if recursive else ''}{OBS_SQL},\n{GRID_SQL}{more}{rest}"
        REGISTRY[fn.__name__] = (fn, text)
        return fn

    return keep


def obs_query(sql: str | None = None):
    """Registers a function of the observation table."""

    def keep(fn: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(observations(spark, sf_dir))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        query(sql)(run)
        return fn

    return keep


def rounded(df: DataFrame, keys: list[str], cols: list[str] | dict[str, Column], digits: int = 6) -> DataFrame:
    """Keys as they are and float results rounded, so that two engines' sums agree."""
    cols = cols if isinstance(cols, dict) else {c: F.col(c) for c in cols}
    return df.select(*keys, *[F.round(c, digits).alias(n) for n, c in cols.items()])


def rounded_sql(cols: dict[str, str] | list[str], digits: int = 6) -> str:
    cols = cols if isinstance(cols, dict) else {c: c for c in cols}
    return ", ".join(f"round({e}, {digits}) AS {n}" for n, e in cols.items())
