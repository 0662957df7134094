"""Band algebra. A masked value is NULL: comparisons and arithmetic propagate it, aggregates skip it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_DATA = -32768


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dbl(x: float) -> Column:
    """A DOUBLE literal; a bare decimal literal in SQL text would be DECIMAL."""
    return F.lit(float(x))


def select_bands(df: DataFrame, *patterns: str) -> list[str]:
    """The columns that fully match any pattern, in the order of the patterns."""
    found = [c for p in patterns for c in df.columns if re.fullmatch(p, c)]
    return list(dict.fromkeys(found))


def update(df: DataFrame, bands: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Applies one expression to several bands in one projection."""
    return df.withColumns({b: fn(F.col(b)) for b in bands})


def mask(df: DataFrame, keep: Column, bands: Iterable[str]) -> DataFrame:
    """NULLs the bands where ``keep`` is false or NULL."""
    return update(df, bands, lambda c: F.when(keep, c))


def all_valid(bands: Iterable[Column | str]) -> Column:
    return reduce(lambda a, b: a & b, [col(b).isNotNull() for b in bands])


def all_band_mask(df: DataFrame, bands: list[str]) -> DataFrame:
    """Masks every band of a row unless all of them are valid."""
    return mask(df, all_valid(bands), bands)


def unmask(x: Column | str, value: Column | float) -> Column:
    return F.coalesce(col(x), value if isinstance(value, Column) else F.lit(value))


def self_mask(x: Column | str) -> Column:
    return F.nullif(col(x), F.lit(0))


def where(x: Column | str, condition: Column, value: Column) -> Column:
    """Replaces where the condition is true and the new value is valid."""
    return F.when(condition & value.isNotNull(), value).otherwise(col(x))


def strict_least(*xs: Column) -> Column:
    """The smallest of the values, NULL if any is NULL (F.least skips NULLs)."""
    return F.when(all_valid(xs), F.least(*xs))


def strict_greatest(*xs: Column) -> Column:
    return F.when(all_valid(xs), F.greatest(*xs))


def row_sum(xs: Iterable[Column | str]) -> Column:
    """Horizontal sum that skips NULLs; NULL only if all are."""
    xs = [col(x) for x in xs]
    total = reduce(lambda a, b: a + b, [F.coalesce(x, dbl(0)) for x in xs])
    return F.when(F.coalesce(*xs).isNotNull(), total)


def row_mean(xs: Iterable[Column | str]) -> Column:
    xs = [col(x) for x in xs]
    n = reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in xs])
    return F.try_divide(row_sum(xs), n.cast("double"))


def clamp(x: Column, low: float, high: float) -> Column:
    """NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, dbl(low)), dbl(high)))


def unit_scale(x: Column, low: float, high: float) -> Column:
    return (x - dbl(low)) / dbl(high - low)


def rescale(x: Column, at_zero: float, at_one: float) -> Column:
    return (x - dbl(at_zero)) / dbl(at_one - at_zero)


def normalized_difference(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return F.try_divide(a - b, a + b)


def saturating_cast(x: Column, kind: str) -> Column:
    """Clamps to the range of an integer type before the cast, which would raise beyond it."""
    low, high = {"byte": (0, 255), "short": (-32768, 32767), "uint16": (0, 65535), "int": (-(2**31), 2**31 - 1)}[kind]
    return clamp(x.cast("double"), low, high).cast({"byte": "short", "short": "short", "uint16": "int", "int": "int"}[kind])


def remap(x: Column | str, table: dict) -> Column:
    """Values of a small dictionary; NULL where the key is absent."""
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), col(x))


def linear_combination(bands: list[str], weights: list[float]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(b) * dbl(w) for b, w in zip(bands, weights)])


def set_no_data(df: DataFrame, bands: Iterable[str], value: float = NO_DATA) -> DataFrame:
    return update(df, bands, lambda c: F.coalesce(c, F.lit(value)))


def array_percentile(values: Column, p: float) -> Column:
    """A percentile, 0 to 100, of an array's valid values, interpolated; NULL if there are none."""
    a = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    at = (F.size(a) - 1) * dbl(p / 100)
    low, high = F.get(a, F.floor(at).cast("int")), F.get(a, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def replace_mask(x: Column, new: Column, no_data: float = 0) -> Column:
    """Fills NULL from ``new``, then masks the no-data value."""
    return F.nullif(F.coalesce(x, new), F.lit(no_data).cast("double"))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """(r, g, b) of hue, saturation and value, all 0 to 1."""
    six = (h - F.floor(h)) * 6
    part = {k: v - v * s * F.greatest(F.least(F.least((six + n) - F.floor((six + n) / 6) * 6, 4 - ((six + n) - F.floor((six + n) / 6) * 6)), dbl(1)), dbl(0)) for k, n in (("r", 5), ("g", 3), ("b", 1))}
    return F.struct(*[c.alias(k) for k, c in part.items()])


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """(h, s, v), all 0 to 1, of red, green and blue; grey has hue 0, black saturation 0."""
    high, low = strict_greatest(r, g, b), strict_least(r, g, b)
    spread = high - low
    turn = F.when(high == r, F.pmod(F.try_divide(g - b, spread), dbl(6))).when(high == g, F.try_divide(b - r, spread) + 2).otherwise(F.try_divide(r - g, spread) + 4)
    h = F.when(spread == 0, dbl(0)).otherwise(turn / 6)
    s = F.when(high == 0, dbl(0)).otherwise(F.try_divide(spread, high))
    return F.struct(h.alias("h"), s.alias("s"), high.alias("v"))


def expression(text: str, names: dict[str, str]) -> Column:
    """An SQL expression in short names for the bands, as in expression("N / (N + R)", {"N": "nir", "R": "red"}).

    Names within quotes are left alone, as are those of fields (after a dot) and of functions (before a bracket).
    """
    part = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|(?<![\w.])[A-Za-z_]\w*\b(?!\s*\()""")
    return F.expr(part.sub(lambda m: f"`{names[m[0]]}`" if m[0] in names else m[0], text))


def to_natural(db: Column) -> Column:
    return F.pow(dbl(10), db / 10)


def to_db(x: Column) -> Column:
    return F.when(x > 0, F.log10(x) * 10)


def scale_for_fit(x: Column, direction: int, factor: float = 1.0) -> Column:
    """Turns a band so that loss goes up and makes it positive, as some models need."""
    return (x * dbl(-direction) + dbl(1)) * dbl(factor)


def unscale_fit(x: Column, direction: int, factor: float = 1.0) -> Column:
    return (x / dbl(factor) - dbl(1)) * dbl(-direction)
