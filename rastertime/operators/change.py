"""Change in time: thresholds, spikes, gaps, pairwise differences, two dates, z-scores and trends in moving windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastertime.functions.bands import dbl, row_mean


def threshold(x: Column, year: Column, limit: float, direction: int = 1) -> Column:
    """The year where the band, turned by ``direction``, is above the limit."""
    return F.when(x * direction > dbl(limit), year)


def threshold_subtle(x: Column, year: Column, low: float, high: float, direction: int = 1) -> Column:
    return F.when((x * direction > dbl(low)) & (x * direction < dbl(high)), year)


def despike(df: DataFrame, band: str, limit: float, bands: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """Replaces all bands by the neighbours' mean where one band leaves both neighbours by more than ``limit``.

    First and last observations stay, as do those with a masked neighbour.
    """
    over = Window.partitionBy(*keys).orderBy(*order)
    x, before, after = F.col(band), F.lag(band).over(over), F.lead(band).over(over)
    up = (x - before > dbl(limit)) & (x - after > dbl(limit))
    down = (before - x > dbl(limit)) & (after - x > dbl(limit))
    spike = F.coalesce(up | down, F.lit(False))
    rows = df.withColumns({"_spike": spike} | {f"_n_{b}": (F.lag(b).over(over) + F.lead(b).over(over)) / 2 for b in bands})
    return rows.withColumns({b: F.when(F.col("_spike") & F.col(f"_n_{b}").isNotNull(), F.col(f"_n_{b}")).otherwise(F.col(b)) for b in bands}).drop("_spike", *[f"_n_{b}" for b in bands])


def linear_interpolation(df: DataFrame, bands: list[str], keys: list[str], days: int = 32, order: str = "t") -> DataFrame:
    """Fills masked values from the nearest valid ones within ``days`` before and after; one side alone is copied.

    A range frame over the ordered series of each key; no self-join.
    """
    at = F.unix_timestamp(F.col(order).cast("timestamp"))
    rows = df.withColumn("_at", at)
    back = Window.partitionBy(*keys).orderBy("_at").rangeBetween(-days * 86400, 0)
    ahead = Window.partitionBy(*keys).orderBy("_at").rangeBetween(0, days * 86400)

    def seen(b: str) -> Column:
        return F.when(F.col(b).isNotNull(), F.struct("_at", F.col(b).alias("v")))

    rows = rows.withColumns({f"_b_{b}": F.last(seen(b), ignorenulls=True).over(back) for b in bands} | {f"_a_{b}": F.first(seen(b), ignorenulls=True).over(ahead) for b in bands})

    def value(b: str) -> Column:
        one, two = F.col(f"_b_{b}"), F.col(f"_a_{b}")
        ratio = F.try_divide((F.col("_at") - one["_at"]).cast("double"), (two["_at"] - one["_at"]).cast("double"))
        return F.coalesce(F.col(b), one["v"] + (two["v"] - one["v"]) * F.coalesce(ratio, dbl(0)), one["v"], two["v"])

    return rows.withColumns({b: value(b) for b in bands}).drop("_at", *[f"_{s}_{b}" for s in "ba" for b in bands])


def pairwise(df: DataFrame, bands: list[str], keys: list[str], order: str, per_year: bool = False) -> DataFrame:
    """x less the x before and a millionth, without the first of each key; ``per_year`` divides by the years between."""
    over = Window.partitionBy(*keys).orderBy(order)
    gap = (F.col(order) - F.lag(order).over(over)).cast("double") if per_year else dbl(1)
    out = df.withColumns({f"{b}_slope": F.try_divide(F.col(b) - (F.lag(b).over(over) + dbl(1e-6)), gap) for b in bands} | {"_n": F.row_number().over(over)})
    return out.where("_n > 1").drop("_n")


def two_dates(before: DataFrame, after: DataFrame, bands: list[str], limits: dict[str, float], directions: dict[str, int], px: str = "px") -> DataFrame:
    """Differences of two composites, and whether any, all or most bands show loss."""
    right = after.select(px, *[F.col(b).alias(f"_{b}") for b in bands])
    rows = before.join(right, px).select(px, *[(F.col(f"_{b}") - F.col(b)).alias(f"{b}_diff") for b in bands])
    lost = [F.coalesce((F.col(f"{b}_diff") * directions[b] > dbl(limits[b])).cast("int"), F.lit(0)) for b in bands]
    n = reduce(lambda a, b: a + b, lost)
    return rows.withColumns({"loss_any": (n > 0).cast("int"), "loss_all": (n == len(bands)).cast("int"), "loss_mode": (n * 2 > len(bands)).cast("int")})


def z_trend_windows(spark: SparkSession, years: tuple[int, int], days: tuple[int, int], n_days: int, baseline: int, gap: int, epoch: int) -> DataFrame:
    """A row per analysis year and window of days, with its baseline and trend years. Neighbouring windows share a day."""
    first = max(years[0] + baseline + gap, years[0] + epoch - 1)
    rows = [(y, d, d + n_days, y - baseline - gap, y - 1 - gap, y - epoch + 1) for y in range(first, years[1] + 1) for d in range(days[0], days[1] - n_days + 1, n_days)]
    return spark.createDataFrame(rows, "year int, day0 int, day1 int, base0 int, base1 int, trend0 int")


def z_and_trend(df: DataFrame, bands: list[str], years: tuple[int, int], days: tuple[int, int], n_days: int, baseline: int = 5, gap: int = 1, epoch: int = 5, least: int = 30, reducer=F.avg, annual: bool = False, px: str = "px") -> DataFrame:
    """Per pixel and window: z-score against the baseline years (times 10) and slope over the epoch (times 10000).

    Observations meet the broadcast table of windows once; conditional aggregates over (pixel, window) give baseline,
    analysis and trend together, so the history of a pixel is shuffled once.
    """
    windows = z_trend_windows(df.sparkSession, years, days, n_days, baseline, gap, epoch)
    by_year = windows.withColumn("member", F.explode(F.sequence(F.least("base0", "trend0"), F.col("year"))))  # a hash join by year, not a loop
    met = df.select(px, "yr", "doy", "t", *bands).join(F.broadcast(by_year), (F.col("yr") == F.col("member")) & F.col("doy").between(F.col("day0"), F.col("day1")))
    base, now, trend = F.col("yr").between(F.col("base0"), F.col("base1")), F.col("yr") == F.col("year"), F.col("yr") >= F.col("trend0")
    keys = [px, "year", "day0", "day1"]
    # the z-score is linear in x, so reducing x first gives the reduced z of the analysis year for mean, median, min and max
    exprs = [e for b in bands for e in (F.count(F.when(base, F.col(b))).alias(f"_n_{b}"), F.avg(F.when(base, F.col(b))).alias(f"_m_{b}"), F.stddev_pop(F.when(base, F.col(b))).alias(f"_s_{b}"), reducer(F.when(now, F.col(b))).alias(f"_x_{b}"))]
    at = F.col("yr").cast("double") + F.col("doy").cast("double") / dbl(365)
    if not annual:
        exprs += [F.regr_slope(F.when(trend, F.col(b)), at - dbl(2000)).alias(f"_t_{b}") for b in bands]
    out = met.groupBy(*keys).agg(*exprs)
    if annual:
        med = met.where(trend).groupBy(*keys, "yr").agg(*[F.median(b).alias(b) for b in bands])
        out = out.join(med.groupBy(*keys).agg(*[F.regr_slope(F.col(b), F.col("yr").cast("double") - dbl(2000)).alias(f"_t_{b}") for b in bands]), keys, "left")
    z = {f"{b}_Z": F.when(F.col(f"_n_{b}") >= least, F.try_divide(F.col(f"_x_{b}") - F.col(f"_m_{b}"), F.col(f"_s_{b}")) * 10) for b in bands}
    slopes = {f"{b}_slope": F.col(f"_t_{b}") * 10000 for b in bands}
    return out.select(*keys, *[c.alias(n) for n, c in (z | slopes).items()])


def threshold_z_and_trend(df: DataFrame, bands: list[str], z: float, slope: float, direction: int = -1) -> DataFrame:
    """Year of change by z and by slope; limits are signed as the change is."""
    return df.withColumns({f"{b}_Z_change": threshold(F.col(f"{b}_Z"), F.col("year"), abs(z * 10), direction) for b in bands} | {f"{b}_slope_change": threshold(F.col(f"{b}_slope"), F.col("year"), abs(slope * 10000), direction) for b in bands})


def threshold_z_and_trend_subtle(df: DataFrame, bands: list[str], z: tuple[float, float], slope: tuple[float, float], direction: int = -1) -> DataFrame:
    """Year of slight change: z and slope beyond the first but short of the second limit, both signed as the change is."""
    limits = [("Z", z, 10), ("slope", slope, 10000)]
    return df.withColumns({f"{b}_{n}_change": threshold_subtle(F.col(f"{b}_{n}"), F.col("year"), abs(low * by), abs(high * by), direction) for b in bands for n, (low, high), by in limits})


def masked_by(df: DataFrame, bands: list[str], valid: DataFrame, keys: list[str]) -> DataFrame:
    """Masks the bands again where ``valid`` has no row of the same keys, as after gaps were filled for a model."""
    seen = valid.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return df.join(seen, keys, "left").withColumns({b: F.when(F.col("_seen"), F.col(b)) for b in bands}).select(*df.columns)


def neighbour_mean(xs: list[Column]) -> Column:
    return row_mean(xs)


def least_observations(df: DataFrame, band: str, keys: list[str], least: int) -> DataFrame:
    """Masks the band in all years of a pixel with fewer than ``least`` valid ones."""
    return df.withColumn(band, F.when(F.count(band).over(Window.partitionBy(*keys)) >= least, F.col(band)))


def bridge_year(df: DataFrame, band: str, year: int, keys: list[str], order: str = "yr") -> DataFrame:
    """Replaces one year's value by the mean of the years beside it where all three are there."""
    over = Window.partitionBy(*keys).orderBy(order)
    near = (F.lag(order).over(over) == year - 1) & (F.lead(order).over(over) == year + 1) & F.col(band).isNotNull()
    mean = (F.lag(band).over(over) + F.lead(band).over(over)) / 2
    return df.withColumn(band, F.when((F.col(order) == year) & near & mean.isNotNull(), mean).otherwise(F.col(band)))


def composite_times(df: DataFrame, keys: list[str], first_day: int, year: str = "year", julian: str = "julianDay") -> DataFrame:
    """Adds time, the decimal year of each composite's own day; a masked day takes the pixel's median one.

    Days up to the season's first belong to the next year.
    """
    day = F.coalesce(F.col(julian).cast("double"), F.median(julian).over(Window.partitionBy(*keys)))
    return df.withColumn("_day", day).withColumn("time", F.col(year).cast("double") + F.when(F.col("_day") <= first_day, 1).otherwise(0) + F.col("_day") / dbl(365)).drop("_day")
