"""Scale factors and cross-sensor harmonisation as linear maps of bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertime.functions.bands import dbl
from rastertime.functions.indices import SIX

# Published scale factors and regression coefficients, in the order of SIX.
SCALE = {"C1": {"refl": (0.0001, 0.0), "temp": (0.1, 0.0)}, "C2": {"refl": (0.0000275, -0.2), "temp": (0.00341802, 149.0)}}
ROY_SLOPES = [0.9785, 0.9542, 0.9825, 1.0073, 1.0171, 0.9949]
ROY_INTERCEPTS = [-0.0095, -0.0016, -0.0022, -0.0021, -0.003, 0.0029]
#: Constants of the thermal band by sensor, for brightness temperature in kelvin.
THERMAL = {"L4": (671.62, 1284.3), "L5": (607.76, 1260.56), "L7": (666.09, 1282.71), "L8": (774.8853, 1321.0789)}
CHASTAIN = {
    ("MSI", "OLI"): ([1.0946, 1.0043, 1.0524, 0.8954, 1.0049, 1.0002], [-0.0107, 0.0026, -0.0015, 0.0033, 0.0065, 0.0046]),
    ("MSI", "ETM"): ([1.10601, 0.99091, 1.05681, 1.0045, 1.03611, 1.04011], [-0.0139, 0.00411, -0.0024, -0.0076, 0.00411, 0.00861]),
    ("OLI", "ETM"): ([1.03501, 1.00921, 1.01991, 1.14061, 1.04351, 1.05271], [-0.0055, -0.0008, -0.0021, -0.0163, -0.0045, 0.00261]),
}


def apply_scale(df: DataFrame, version: str = "C2", reflective: list[str] = SIX, thermal: str = "temp") -> DataFrame:
    (m, a), (tm, ta) = SCALE[version]["refl"], SCALE[version]["temp"]
    return df.withColumns({b: F.col(b) * dbl(m) + dbl(a) for b in reflective} | {thermal: F.col(thermal) * dbl(tm) + dbl(ta)})


def toa_reflectance(number: Column, gain: Column, bias: Column, elevation: Column) -> Column:
    """Reflectance at the top of the atmosphere; NULL where the sun, its elevation in degrees, is not above the horizon."""
    return F.when(elevation > 0, (number * gain + bias) / F.sin(F.radians(elevation)))


def brightness_temperature(radiance: Column, sensor: str) -> Column:
    """Kelvin from the radiance of a sensor's thermal band; NULL where there is none."""
    k1, k2 = THERMAL[sensor]
    return F.when(radiance > 0, dbl(k2) / F.log1p(dbl(k1) / radiance))


def _forward(slopes: list[float], intercepts: list[float]) -> dict[str, Column]:
    return {b: F.col(b) * dbl(s) + dbl(i) for b, s, i in zip(SIX, slopes, intercepts)}


def _inverse(slopes: list[float], intercepts: list[float]) -> dict[str, Column]:
    return {b: (F.col(b) - dbl(i)) / dbl(s) for b, s, i in zip(SIX, slopes, intercepts)}


def roy(df: DataFrame) -> DataFrame:
    """OLI reflectance to ETM+."""
    return df.withColumns(_inverse(ROY_SLOPES, ROY_INTERCEPTS))


def chastain(df: DataFrame, source: str, target: str) -> DataFrame:
    """Between MSI, OLI and ETM. Regressions give the first of a pair from the second, so that way round is inverse."""
    if (source, target) in CHASTAIN:
        return df.withColumns(_inverse(*CHASTAIN[source, target]))
    if (target, source) in CHASTAIN:
        return df.withColumns(_forward(*CHASTAIN[target, source]))
    raise ValueError(f"no regression between {source} and {target}")
