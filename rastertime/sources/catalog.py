"""Collections by id: where a table lies, which bands it has, and what they are called here."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ["blue", "green", "red", "nir", "swir1", "temp", "swir2", "qa"]
# How the provider numbers a sensor's bands in the order of NAMES, and names the quality band.
LANDSAT_NUMBERS = {(4, 5): "1 2 3 4 5 6 7", (7,): "1 2 3 4 5 6_VCID_1 7", (8, 9): "2 3 4 5 6 10 7"}
LANDSAT_QUALITY = {("C1", "TOA"): "BQA", ("C1", "SR"): "pixel_qa", ("C2", "TOA"): "QA_PIXEL", ("C2", "SR"): "QA_PIXEL"}
# Fixed value: sensors of each collection.
LANDSAT_SENSORS = {"C1": (4, 5, 7, 8), "C2": (4, 5, 7, 8, 9)}


def landsat_bands(collection: str, sensor: int, level: str) -> list[str]:
    """The provider's band names of a product, in the order of NAMES. Surface products of the second collection carry prefixes."""
    numbers = next(v for k, v in LANDSAT_NUMBERS.items() if sensor in k).split()
    thermal, first, heat = NAMES.index("temp"), "B", "B"
    if level == "SR":
        numbers[thermal] = numbers[thermal].split("_")[0]
        first, heat = ("SR_B", "ST_B") if collection == "C2" else ("B", "B")
    return [*[(heat if i == thermal else first) + n for i, n in enumerate(numbers)], LANDSAT_QUALITY[collection, level]]


LANDSAT_BANDS = {(c, n, level): landsat_bands(c, n, level) for c, sensors in LANDSAT_SENSORS.items() for level in ("TOA", "SR") for n in sensors}
# Bands of the finer optical family by level, in the order of their names; values count in ten-thousandths.
S2_BANDS = {
    "TOA": {
        "B1": "cb", "B2": "blue", "B3": "green", "B4": "red", "B5": "re1", "B6": "re2", "B7": "re3", "B8": "nir", "B8A": "nir2",
        "B9": "waterVapor", "B10": "cirrus", "B11": "swir1", "B12": "swir2",
    },
    "SR": {
        "B1": "cb", "B2": "blue", "B3": "green", "B4": "red", "B5": "re1", "B6": "re2", "B7": "re3", "B8": "nir", "B8A": "nir2",
        "B9": "waterVapor", "B11": "swir1", "B12": "swir2",
    },
}
# Bands of the coarse daily family by product, and their factors.
MODIS_BANDS = {
    "SR250": {"sur_refl_b01": "red", "sur_refl_b02": "nir"},
    "SR500": {"sur_refl_b03": "blue", "sur_refl_b04": "green", "sur_refl_b06": "swir1", "sur_refl_b07": "swir2"},
    "LST_daily": {"LST_Day_1km": "temp", "Emis_31": "Emis_31", "Emis_32": "Emis_32"},
    "LST_8day": {"LST_Day_1km": "temp", "Emis_31": "Emis_31", "Emis_32": "Emis_32"},
    "angles_daily": {"SensorZenith": "SensorZenith", "SensorAzimuth": "SensorAzimuth", "SolarZenith": "SolarZenith", "SolarAzimuth": "SolarAzimuth"},
    "angles_8day": {"SolarZenith": "SolarZenith", "ViewZenith": "ViewZenith", "RelativeAzimuth": "RelativeAzimuth"},
}
MODIS_FACTORS = {"blue": 0.0001, "green": 0.0001, "red": 0.0001, "nir": 0.0001, "swir1": 0.0001, "swir2": 0.0001, "temp": 0.02}
# Bands of the daily climate products.
CLIMATE_BANDS = {
    "DAYMET_V3": ["dayl", "prcp", "srad", "swe", "tmax", "tmin", "vp"],
    "DAYMET_V4": ["dayl", "prcp", "srad", "swe", "tmax", "tmin", "vp"],
    "CHIRPS_DAILY": ["precipitation"],
}
# Numbers of the sensors in a sensor band.
SENSOR_CODES = {"LANDSAT_4": 4, "LANDSAT_5": 5, "LANDSAT_7": 7, "LANDSAT_8": 8, "LANDSAT_9": 9, "Sentinel-2A": 21, "Sentinel-2B": 22, "Sentinel-2C": 23}
#: Last date before the scan-line corrector of sensor 7 failed.
SLC_FAILED = "2003-05-31"


@dataclass(frozen=True)
class Collection:
    """A table and its renames: source band -> name."""

    path: str
    bands: dict[str, str]
    format: str = "parquet"
    factors: dict[str, float] = field(default_factory=dict)

    def read(self, spark: SparkSession, keep: tuple[str, ...] = ()) -> DataFrame:
        """Only the catalogued bands, times their factors, and ``keep``, so the scan reads no others."""
        return self.of(spark.read.format(self.format).load(self.path), keep)

    def of(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """The same of a table that is at hand."""
        return df.select(*keep, *[(F.col(src) * float(self.factors[dst]) if dst in self.factors else F.col(src)).alias(dst) for src, dst in self.bands.items()])


def landsat(path: str, product: tuple[str, int, str]) -> Collection:
    """``product``: collection, sensor, level, as in ("C2", 8, "SR")."""
    return Collection(path, dict(zip(LANDSAT_BANDS[product], NAMES)))


def sentinel2(path: str, level: str = "TOA") -> Collection:
    """Bands of a level, as reflectance from 0 to 1."""
    return Collection(path, S2_BANDS[level], factors={b: 0.0001 for b in S2_BANDS[level].values()})


def modis(path: str, product: str) -> Collection:
    """One product; ``operators.joins.by_time`` joins products of a day."""
    bands = MODIS_BANDS[product]
    return Collection(path, bands, factors={b: MODIS_FACTORS[b] for b in bands.values() if b in MODIS_FACTORS})


def climate(path: str, product: str = "DAYMET_V4") -> Collection:
    return Collection(path, {b: b for b in CLIMATE_BANDS[product]})


def path_row(df: DataFrame, path: str = "WRS_PATH", row: str = "WRS_ROW") -> DataFrame:
    """Adds pathRow, the digits of path and row as one number."""
    digits = [F.col(c).cast("int").cast("string") for c in (path, row)]
    return df.withColumn("pathRow", F.concat(*digits).cast("long"))


def without_gaps(df: DataFrame, failed: str = SLC_FAILED, sensor: str = "sensor", seven: str = "LANDSAT_7", t: str = "t") -> DataFrame:
    """Leaves out scenes of sensor 7 after ``failed``, the last day of its scan-line corrector."""
    broken = (F.col(sensor) == seven) & (F.col(t) >= F.date_add(F.lit(failed).cast("date"), 1).cast("timestamp_ntz"))
    return df.where(~F.coalesce(broken, F.lit(False)))


def missing_bands(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds absent bands as NULL, in place of a masked dummy."""
    return df.withColumns({n: F.lit(None).cast("double") for n in names if n not in df.columns})


def merge(*parts: DataFrame) -> DataFrame:
    """Bag union by name; bands that a part lacks are NULL there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def describe(df: DataFrame, t: str = "t") -> DataFrame:
    """One row: how many rows, the first and last time, and the band names."""
    return df.agg(F.count(F.lit(1)).alias("size"), F.min(t).alias("first"), F.max(t).alias("last")).withColumn("bands", F.lit(",".join(df.columns)))


def in_box(df: DataFrame, low_row: int, high_row: int, low_col: int, high_col: int) -> DataFrame:
    return df.where(F.col("row").between(low_row, high_row) & F.col("col").between(low_col, high_col))


def radar(df: DataFrame, polarisation: str, direction: str, mode: str = "IW") -> DataFrame:
    """Scenes of one mode and orbit direction that have a polarisation among those sent and received."""
    return df.where((F.col("instrumentMode") == mode) & F.array_contains("polarisations", polarisation) & (F.col("pass") == direction))


def metadata(name: str, operator: str, value) -> Column:
    """A filter of a property by a named operator, as columns that reach the scan; NULL properties pass none of them."""
    p = F.col(name)
    known = {
        "equals": lambda: p == value, "not_equals": lambda: p != value, "less_than": lambda: p < value, "not_less_than": lambda: p >= value,
        "greater_than": lambda: p > value, "not_greater_than": lambda: p <= value, "starts_with": lambda: p.startswith(value), "ends_with": lambda: p.endswith(value),
        "contains": lambda: p.contains(value), "not_contains": lambda: ~p.contains(value), "not_starts_with": lambda: ~p.startswith(value), "not_ends_with": lambda: ~p.endswith(value),
        "in_list": lambda: p.isin(list(value)), "not_in_list": lambda: ~p.isin(list(value)), "list_contains": lambda: F.array_contains(p, value),
    }
    if operator not in known:
        raise ValueError(f"no operator {operator!r}; known: {', '.join(sorted(known))}")
    return known[operator]()
