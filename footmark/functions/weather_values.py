"""Acceptance and conversion of native weather readings. Missing is never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VARIABLES = ("tmin", "tmax", "pcpn")

# Sentinels that mean missing, and the decimal pattern of hourly text.
SENTINELS = (-999.0, -9999.0)
DECIMAL = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)$"

# Fixed values: (label, exclusive upper bound) in increasing order; None is open.
TEMPERATURE_BANDS = (
    ("Temperature < 0 °C", 0.0),
    ("0 ≤ temperature < 10 °C", 10.0),
    ("10 ≤ temperature < 20 °C", 20.0),
    ("20 ≤ temperature < 30 °C", 30.0),
    ("Temperature ≥ 30 °C", None),
)
# The first rain band includes its bound.
RAIN_BANDS = (
    ("0 mm (dry / trace)", 0.0),
    ("0 < rain < 1 mm", 1.0),
    ("1 ≤ rain < 5 mm", 5.0),
    ("5 ≤ rain < 10 mm", 10.0),
    ("10 ≤ rain < 20 mm", 20.0),
    ("Rain ≥ 20 mm", None),
)


def celsius(fahrenheit: Column) -> Column:
    return (fahrenheit - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0)


def millimetres(inches: Column) -> Column:
    return inches * F.lit(25.4)


def finite(value: Column) -> Column:
    return (
        value.isNotNull() & ~F.isnan(value)
        & (F.abs(value) != F.lit(float("inf")))
    )


def is_rain() -> Column:
    return F.col("variable") == "pcpn"


def accepted_value() -> Column:
    """Station policy over (variable, value, unit, raw_value, flag, is_trace) in °C or mm."""
    flag = F.upper(F.trim("flag"))
    value = F.col("value")
    return (
        F.when(~F.col("variable").isin(*VARIABLES), None)
        .when((flag != "") & ~(is_rain() & (flag == "T")), None)
        .when(F.col("unit") != F.when(is_rain(), "inch").otherwise("degreeF"), None)
        .when(is_rain() & ((flag == "T") | (F.trim("raw_value") == "T") | F.col("is_trace")),
              F.lit(0.0))
        .when(~finite(value) | value.isin(*SENTINELS), None)
        .when(is_rain(), F.when(value >= 0, millimetres(value)))
        .otherwise(celsius(value))
    )


def native_value(raw: Column) -> Column:
    """Blank, M and sentinels are missing; T is zero; anything else must be a number."""
    text = F.trim(raw)
    number = text.try_cast("double")
    return (
        F.when(text == "T", F.lit(0.0)).when(text.isin("", "M"), None)
        .when(~number.isin(*SENTINELS), number)
    )


def native_violation(variable: Column, raw: Column, flag: Column) -> Column:
    """Why a native reading is invalid, or null."""
    text = F.trim(raw)
    value = native_value(raw)
    trace = (F.trim(flag) == "T") | (text == "T")
    number = text.try_cast("double")
    return (
        F.when(~text.isin("", "M", "T") & ~finite(number), "unreadable value")
        .when((F.trim(flag) == "M") & value.isNotNull(), "missing flag with a number")
        .when(trace & ((variable != "pcpn") | ~value.eqNullSafe(F.lit(0.0))), "trace not zero rain")
        .when((variable == "pcpn") & (value < 0), "negative rain")
    )


def hourly_value(raw: Column, precipitation: bool = False) -> Column:
    """Hourly text to a number; suffixed, blank and non-decimal text stays missing."""
    text = F.trim(raw)
    number = F.when(text.rlike(DECIMAL), text.try_cast("double"))
    if not precipitation:
        return number
    return F.when(text == "T", F.lit(0.0)).when(number >= 0, number)


def bands(variable: str) -> tuple[tuple[str, float | None], ...]:
    if variable not in VARIABLES:
        raise ValueError("Choose an available weather variable.")
    return RAIN_BANDS if variable == "pcpn" else TEMPERATURE_BANDS


def band_index(value: Column, variable: str) -> Column:
    """Position of the band, null for missing, infinite or negative-rain values."""
    usable = finite(value) & (value >= 0) if variable == "pcpn" else finite(value)
    out = None
    for i, (_, upper) in enumerate(bands(variable)):
        if upper is None:
            out = out.otherwise(F.lit(i))
            break
        inside = value <= upper if variable == "pcpn" and i == 0 else value < upper
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return F.when(usable, out)


def band_label(index: Column, variable: str) -> Column:
    labels = F.array(*[F.lit(label) for label, _ in bands(variable)])
    return F.element_at(labels, (index + 1).cast("int"))
