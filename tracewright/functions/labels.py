"""Profile groups, map styles and study labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
#: Upper bounds (exclusive) and names of age groups.
AGE_GROUPS = ((18, "<18"), (25, "18-24"), (35, "25-34"), (45, "35-44"), (55, "45-54"), (65, "55-64"))
OLDEST = "65+"
#: Texts that mean yes.
YES_TEXTS = ("true", "1", "yes")
#: Least share of the largest weight, and colour.
WEIGHT_COLORS = ((0.75, "#ef4444"), (0.50, "#f97316"), (0.30, "#facc15"))
LOW_COLOR = "#22d3ee"
INTENSITIES = ((0.66, "red"), (0.33, "orange"))
LOW_INTENSITY = "blue"


def age_group(age: Column) -> Column:
    years = age.cast("int")
    found = F.when(years.isNull(), UNKNOWN)
    for bound, name in AGE_GROUPS:
        found = found.when(years < bound, name)
    return found.otherwise(OLDEST)


def nb_car_group(cars: Column) -> Column:
    n = cars.cast("int")
    return F.when(n.isNull(), UNKNOWN).when(n <= 0, "0 car").when(n == 1, "1 car").otherwise("2+ cars")


def bool_label(value: Column) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isNull(), UNKNOWN).when(text.isin(*YES_TEXTS), "Yes").otherwise("No")


def _bucket(share: Column, steps: tuple[tuple[float, str], ...], low: str) -> Column:
    found = F.when(share.isNull(), low)
    for least, name in steps:
        found = found.when(share >= least, name)
    return found.otherwise(low)


def weight_color(value: Column, largest: Column) -> Column:
    return F.when(largest <= 1, LOW_COLOR).otherwise(_bucket(value / F.greatest(largest, F.lit(1)), WEIGHT_COLORS, LOW_COLOR))


def corridor_intensity(weight: Column, largest: Column) -> Column:
    return F.when(weight >= 0.66 * largest, "red").when(weight >= 0.33 * largest, "orange").otherwise(LOW_INTENSITY)


def threshold_label(threshold: Column) -> Column:
    return F.when(threshold < 0.40, "trop large").when(threshold > 0.50, "trop strict").when(threshold == 0.42, "retenu").otherwise("acceptable")
