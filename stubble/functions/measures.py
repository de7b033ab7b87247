"""Arithmetic and reconciliation expressions over survey measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stubble.functions import as_col


def guarded_ratio(numerator, denominator) -> Column:
    """``a / b`` where ``b > 0``, else null."""
    a, b = as_col(numerator), as_col(denominator)
    return F.when(b > 0, a / b)


def moisture_share(wet, dry) -> Column:
    """Share of water in a wet mass: ``(wet - dry) / wet`` where ``wet > 0``."""
    w, d = as_col(wet), as_col(dry)
    return F.when(w > 0, (w - d) / w)


def dry_from_wet(wet, moisture) -> Column:
    w, m = as_col(wet), as_col(moisture)
    return w - w * m


def residue_by_difference(biomass, grain, guarded: bool = False) -> Column:
    """Biomass without its grain; ``guarded`` asks for a positive biomass."""
    b, g = as_col(biomass), as_col(grain)
    return F.when(b > 0, b - g) if guarded else b - g


def float_divide(numerator, denominator) -> Column:
    """Division by IEEE rules: ``x/0`` is signed infinity, ``0/0`` is null."""
    a, b = as_col(numerator), as_col(denominator)
    return (
        F.when(b != 0, a / b)
        .when((b == 0) & (a > 0), F.lit(float("inf")))
        .when((b == 0) & (a < 0), F.lit(float("-inf")))
    )


def harvest_index(grain, residue) -> Column:
    """Grain share of the above-ground mass."""
    g, r = as_col(grain), as_col(residue)
    return float_divide(g, g + r)


def residue_set(
    biomass_wet, grain_wet, sub_wet, sub_dry, area
) -> dict[str, Column]:
    """Residue wet mass, moisture share, dry mass and dry mass per area."""
    wet = as_col(biomass_wet) - as_col(grain_wet)
    moisture = float_divide(as_col(sub_wet) - as_col(sub_dry), sub_wet)
    dry = wet * (F.lit(1.0) - moisture)
    return {
        "ResidueMassWet": wet,
        "ResidueMoistureProportion": moisture,
        "ResidueMassDry": dry,
        "ResidueMassDryPerArea": float_divide(dry, area),
    }


def sample_id(year, point, given, first_own_id: int = 2010) -> Column:
    """``year_point`` before the first year with own ids; null parts give null."""
    return F.when(
        as_col(year) < first_own_id,
        F.concat(as_col(year).cast("string"), F.lit("_"), as_col(point).cast("string")),
    ).otherwise(as_col(given))


def allocate_area(biomass, grain, area) -> tuple[Column, Column]:
    """(grain sample area, biomass sample area) from which masses are present."""
    b, g, a = as_col(biomass), as_col(grain), as_col(area)
    neither = b.isNull() & g.isNull()
    grain_area = (
        F.when(neither, None).when(b.isNull() & g.isNotNull(), a).otherwise(F.lit(0.0))
    )
    biomass_area = F.when(neither, None).when(b.isNotNull(), a).otherwise(F.lit(0.0))
    return grain_area, biomass_area


def both_sampled(grain_area, biomass_area) -> Column:
    """True when grain and biomass were both sampled; null areas count as no."""
    return F.coalesce((as_col(grain_area) > 0) & (as_col(biomass_area) > 0), F.lit(False))


def keep_total(value, grain_area, biomass_area) -> Column:
    """A total mass is kept only where both samples were taken."""
    return F.when(both_sampled(grain_area, biomass_area), as_col(value))


def keep_part(value, grain_area, biomass_area) -> Column:
    """A part mass is kept only where not both samples were taken."""
    return F.when(~both_sampled(grain_area, biomass_area), as_col(value))


def within(value, low, high) -> Column:
    """The value where ``low < value <= high``, else null."""
    v = as_col(value)
    return F.when((v > low) & (v <= high), v)


def positive(value) -> Column:
    v = as_col(value)
    return F.when(v > 0, v)


def zero_to_null(value) -> Column:
    v = as_col(value)
    return F.when(v != 0, v)


def prefer(first, *others) -> Column:
    """First non-null of the given columns."""
    return F.coalesce(as_col(first), *[as_col(o) for o in others])


def mean_of_present(a, b) -> Column:
    """Mean of two sources, or the one that is present."""
    x, y = as_col(a), as_col(b)
    return F.when(x.isNotNull() & y.isNotNull(), (x + y) / 2).otherwise(F.coalesce(x, y))


def differs(a, b) -> Column:
    """Three-valued inequality flag."""
    return as_col(a) != as_col(b)


def label_if_differs(a, b) -> Column:
    return F.when(differs(a, b), as_col(a))


def off_by_more(a, b, tolerance: float) -> Column:
    return F.abs(as_col(a) - as_col(b)) > tolerance


def outside(value, low, high, flag_nulls: bool = False) -> Column:
    """Strict bounds test; a null value counts as outside only on request."""
    v = as_col(value)
    return F.coalesce((v < as_col(low)) | (v > as_col(high)), F.lit(flag_nulls))


def half_even(value, places: int = 1) -> Column:
    return F.bround(as_col(value), places)


def year_of_serial(serial) -> Column:
    """Year of a spreadsheet day number counted from 1900-01-01."""
    return F.year(date_of_serial(serial))


def date_of_serial(serial) -> Column:
    return F.date_add(F.to_date(F.lit("1900-01-01")), F.floor(as_col(serial)).cast("int"))
