"""Writers: packed values, no-data, pyramids, one partitioned write per collection."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertime.functions.bands import NO_DATA, saturating_cast


def clean_name(name: str) -> str:
    return re.sub(r"\s+", "-", name.strip())


def collection_name(name: str, first_year: int, last_year: int, first_day: int, last_day: int) -> str:
    return clean_name(f"{name}_{first_year}_{last_year}_{first_day}_{last_day}")


def pack(df: DataFrame, bands: list[str], factor: float = 10000, keep: tuple[str, ...] = ("temp",)) -> DataFrame:
    """Bands times ``factor`` as 16-bit integers; those in ``keep`` only cast."""
    return df.withColumns({b: saturating_cast(F.col(b) * (1.0 if b in keep else float(factor)), "short") for b in bands})


def fill(df: DataFrame, bands: list[str], value: int = NO_DATA) -> DataFrame:
    return df.withColumns({b: F.coalesce(F.col(b), F.lit(value)) for b in bands})


def pyramid(df: DataFrame, policy: dict[str, str], level: int, others: tuple[str, ...] = ()) -> DataFrame:
    """Cells of 2^level rows and columns; ``policy`` gives mean, mode, min, max, median or sample for each band."""
    size = 1 << level
    keys = [*others, F.floor(F.col("row") / size).alias("row"), F.floor(F.col("col") / size).alias("col")]
    how = {
        "mean": F.avg, "min": F.min, "max": F.max, "median": F.median, "mode": lambda c: F.mode(c, deterministic=True),
        "sample": lambda c: F.min_by(c, F.struct("row", "col")),
    }
    return df.groupBy(*keys).agg(*[how[p](F.col(b)).alias(b) for b, p in policy.items()])


def export(df: DataFrame, path: str, by: tuple[str, ...] = ("year",), format: str = "parquet", mode: str = "overwrite") -> str:
    """One write, partitioned by ``by``, with a file's rows dealt out by those columns first."""
    by = [c for c in by if c in df.columns]
    out = df.repartition(*by) if by else df
    out.write.mode(mode).partitionBy(*by).format(format).save(path)
    return path


def export_collection(df: DataFrame, root: str, name: str, years: tuple[int, int], days: tuple[int, int], bands: list[str], factor: float = 10000, no_data: int | None = NO_DATA) -> str:
    """A yearly collection packed, filled and written under its full name."""
    out = pack(df, bands, factor)
    out = out if no_data is None else fill(out, bands, no_data)
    return export(out, f"{root}/{collection_name(name, *years, *days)}")


def copy(spark: SparkSession, source: str, target: str, overwrite: bool = False, format: str = "parquet") -> None:
    spark.read.format(format).load(source).write.mode("overwrite" if overwrite else "errorifexists").format(format).save(target)
