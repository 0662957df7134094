"""Cloud, shadow, snow, water and quality-bit masks as columns that are true where an observation is kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rastertime.functions.bands import all_valid, clamp, dbl, normalized_difference, rescale, strict_greatest, strict_least

# Bits of the quality band by collection version and class, and of two other products.
QA_BITS = {"C1": {"cloud": 5, "shadow": 3, "snow": 4}, "C2": {"cloud": 3, "shadow": 4, "snow": 5}}
QA60_BITS = (10, 11)
STATE_1KM_CLOUD_BIT = 10


def bit_clear(qa: Column, bit: int) -> Column:
    return qa.bitwiseAND(F.lit(1 << bit)) == 0


def fmask(qa: Column, what: str, version: str = "C2") -> Column:
    return bit_clear(qa, QA_BITS[version][what])


def qa_bits(qa: Column, start: int, end: int) -> Column:
    """The number in the bits from start to end, both included."""
    return F.shiftright(qa, start).bitwiseAND(F.lit((1 << (end - start + 1)) - 1))


def qa60_clear(qa: Column) -> Column:
    return bit_clear(qa, QA60_BITS[0]) & bit_clear(qa, QA60_BITS[1])


def _score(*parts: Column) -> Column:
    return clamp(strict_least(dbl(1), *parts) * dbl(100), 0, 100).cast("int")


def _visible() -> Column:
    return rescale(F.col("red") + F.col("green") + F.col("blue"), 0.2, 0.8)


def _infrared() -> Column:
    return rescale(F.col("nir") + F.col("swir1") + F.col("swir2"), 0.3, 0.8)


def landsat_cloud_score() -> Column:
    """0 to 100, from brightness, temperature (270 K where masked) and the snow index."""
    warm = F.coalesce(F.col("temp").cast("double"), dbl(270))
    return _score(rescale(F.col("blue"), 0.1, 0.3), _visible(), _infrared(), rescale(warm, 300, 290), rescale(normalized_difference("green", "swir1"), 0.8, 0.6))


def sentinel2_cloud_score() -> Column:
    haze = strict_greatest(dbl(0), rescale(F.col("blue"), 0.1, 0.5), rescale(F.col("cb"), 0.1, 0.5))
    return _score(haze, _visible(), _infrared(), rescale(normalized_difference("green", "swir1"), 0.8, 0.6))


def modis_cloud_score(use_temperature: bool = True) -> Column:
    """The infrared sum counts swir2 twice; a masked temperature counts as cloud if it is used."""
    infrared = rescale(F.col("nir") + F.col("swir2") + F.col("swir2"), 0.3, 0.8)
    parts = strict_least(dbl(1), _visible(), infrared, rescale(normalized_difference("green", "swir2"), 0.8, 0.6))
    if use_temperature:
        parts = F.when(F.col("temp").isNull(), dbl(1)).otherwise(parts)
    return clamp(parts * dbl(100), 0, 100).cast("int")


def snow() -> Column:
    """Snow in the open or under forest."""
    ndsi = normalized_difference("green", "swir1")
    return ((ndsi > dbl(0.4)) & (F.col("nir") > dbl(0.11))) | ((ndsi > dbl(0.1)) & (ndsi < dbl(0.4)))


def water(flat: Column | None = None) -> Column:
    """From tasselled-cap angles and brightness, on flat ground where a slope test is given."""
    wet = (F.col("tcAngleBW") >= dbl(-0.05)) & (F.col("tcAngleBG") <= dbl(0.05)) & (F.col("brightness") < dbl(0.3))
    return wet if flat is None else wet & flat


def all_bands(bands: list[str]) -> Column:
    return all_valid(bands)


def observed(count: Column) -> Column:
    """Cells that were looked at at all on a day."""
    return count > 0


def state_clear(state: Column) -> Column:
    return bit_clear(state, STATE_1KM_CLOUD_BIT)


def existing_change(year: Column, first: int, last: int) -> Column:
    """The year of a known change, if it lies within the years given."""
    return F.when(year.between(first, last), year)
