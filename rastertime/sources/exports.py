"""Composites with the options that made them, and point tables as KML."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, is_dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertime.functions.bands import NO_DATA
from rastertime.functions.dates import wrap_dates
from rastertime.sources.sinks import clean_name, fill, pack

NOT_IN_NAMES = str.maketrans({"/": "-"})


def _plain(options) -> dict:
    """Options as plain values; tables among them are named by their columns."""
    found = {k: getattr(options, k) for k in options.__dataclass_fields__} if is_dataclass(options) else dict(options)
    return {k: sorted(v.columns) if isinstance(v, DataFrame) else asdict(v) if is_dataclass(v) else v for k, v in found.items()}


def properties(spark: SparkSession, name: str, options, years: tuple[int, int], days: tuple[int, int], buffer: int = 0, method: str = "medoid", level: str = "SR") -> DataFrame:
    """A row per composite: year (that of most of its days), exportName, first and last year of its window, time_start, options as JSON."""
    _, majority = wrap_dates(*days)
    base, rows = clean_name(name).translate(NOT_IN_NAMES), []
    said = json.dumps(_plain(options), sort_keys=True, default=str)
    for year in range(years[0] + buffer, years[1] - buffer + 1):
        first, last = year - buffer, year + buffer + majority
        rows.append((year + majority, f"{base}_{level}_{method}_{first}_{last}_{days[0]}_{days[1]}", first, last, f"{year + majority}-06-01", said))
    made = spark.createDataFrame(rows, "year int, exportName string, startYearComposite int, endYearComposite int, time_start string, options string")
    return made.withColumn("time_start", F.col("time_start").cast("date"))


def export_composites(df: DataFrame, path: str, bands: list[str], made: DataFrame, factor: float = 10000, keep: tuple[str, ...] = ("temp",), no_data: int | None = NO_DATA, mode: str = "overwrite") -> str:
    """Writes composites (year, ..., bands) as 16-bit integers under ``path``/data, a folder per exportName, then ``path``/properties.

    The properties are the manifest: written by a job of its own when the data is committed, so a run that failed leaves none, and
    ``read_composites`` finds nothing. Each band's column says its factor and its value for no data. Reruns write the same rows.
    """
    out = pack(df, bands, factor, keep)
    out = out if no_data is None else fill(out, bands, no_data)
    said = lambda b: {"factor": 1.0 if b in keep else factor, "no_data": no_data}
    out = out.select(*[F.col(c).alias(c, metadata=said(c)) if c in bands else F.col(c) for c in out.columns])
    named = out.join(F.broadcast(made.select("year", "exportName")), "year")
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/properties")
    if mode == "overwrite":
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    named.repartition("exportName").write.mode(mode).partitionBy("exportName").parquet(f"{path}/data")
    made.coalesce(1).write.mode(mode).parquet(f"{path}/properties")
    return path


def read_composites(spark: SparkSession, path: str) -> DataFrame:
    """The exported rows with their properties, bands as they were before packing, NULL where there was no data."""
    made = spark.read.parquet(f"{path}/properties")
    rows = spark.read.parquet(f"{path}/data")
    cols = []
    for field in rows.schema.fields:
        m = field.metadata or {}
        value = F.col(field.name)
        if "factor" in m:
            value = F.when(value != F.lit(m["no_data"]), value) if m.get("no_data") is not None else value
            value = (value / F.lit(float(m["factor"]))).alias(field.name)
        cols.append(value)
    return rows.select(*cols).join(F.broadcast(made.drop("year")), "exportName")


def _escaped(c):
    text = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
FOOT = "</Document></kml>"


def placemark(x: str, y: str, name: str | None, fields: list[str]):
    """A placemark of a row as text; NULL without a place."""
    data = [F.concat(F.lit(f'<Data name="{f}"><value>'), _escaped(F.col(f)), F.lit("</value></Data>")) for f in fields]
    title = F.concat(F.lit("<name>"), _escaped(F.col(name)), F.lit("</name>")) if name else F.lit("")
    place = F.concat(F.lit("<Point><coordinates>"), F.col(x).cast("string"), F.lit(","), F.col(y).cast("string"), F.lit("</coordinates></Point>"))
    return F.concat(F.lit("<Placemark>"), title, F.lit("<ExtendedData>"), *data, F.lit("</ExtendedData>"), place, F.lit("</Placemark>"))


def export_kml(df: DataFrame, path: str, x: str, y: str, name: str | None = None, fields: list[str] | None = None, mode: str = "overwrite") -> str:
    """Points as KML, each file a document of its own, written through Spark's committer: a failed task leaves no file.

    Rows without a place are left out; NULL fields are empty.
    """
    fields = [c for c in df.columns if c not in (x, y)] if fields is None else fields
    rows = df.select(placemark(x, y, name, fields).alias("value")).where("value IS NOT NULL")

    def document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [HEAD]})
        yield from batches
        yield pd.DataFrame({"value": [FOOT]})

    rows.mapInPandas(document, "value string").write.mode(mode).text(path)
    return path
