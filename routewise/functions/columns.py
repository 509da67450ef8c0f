"""Scalar column expressions (all native, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
SECONDS_PER_DAY = 86400.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; NULL unless all four coordinates exist.

    The asin argument is clamped to 1 *inside* the guard: ``least(1, NULL)``
    is 1, so an unguarded clamp would turn missing coordinates into half
    the earth's circumference.
    """
    rlat1, rlon1, rlat2, rlon2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    a = (F.pow(F.sin((rlat2 - rlat1) / 2), 2)
         + F.cos(rlat1) * F.cos(rlat2) * F.pow(F.sin((rlon2 - rlon1) / 2), 2))
    dist = F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(known, dist)


def micros_between(start: Column, end: Column) -> Column:
    """(end - start) in microseconds, NULL if either side is NULL.

    Computed from the day-time interval ``end - start``: for TIMESTAMP_NTZ
    that difference is taken on the wall-clock values, independent of the
    session time zone (``timestamp_diff`` casts NTZ to the session zone, so
    a wall time inside a DST gap would shift by an hour)."""
    i = end - start
    part = lambda unit: F.extract(F.lit(unit), i)
    return (part("DAY").cast("long") * 86_400_000_000 + part("HOUR").cast("long") * 3_600_000_000
            + part("MINUTE").cast("long") * 60_000_000 + (part("SECOND") * 1_000_000).cast("long"))


def days_between(start: Column, end: Column) -> Column:
    """(end - start) in fractional days, NULL if either side is NULL."""
    return micros_between(start, end) / F.lit(SECONDS_PER_DAY * 1e6)


def flag(predicate: Column) -> Column:
    """Boolean predicate as 0/1 where an unknown (NULL) comparison is 0."""
    return F.coalesce(predicate, F.lit(False)).cast("int")


def safe_ratio(num: Column, den: Column, zero_div: float | None = 0.0) -> Column:
    """num / den with 0/0 (and x/0) mapped to ``zero_div`` instead of raising."""
    r = F.try_divide(num, den)
    return r if zero_div is None else F.coalesce(r, F.lit(zero_div))


# Distance bands, right-closed, upper edges in km.
DISTANCE_BANDS = [(100.0, "<100km"), (500.0, "100-500km"), (1000.0, "500-1000km"),
                  (float("inf"), ">1000km")]
# Delivery-delay bands in days, right-closed, (upper edge, label).
DELAY_BANDS = [(-7.0, "Very Early\n(>7d early)"), (0.0, "On Time\n(0-7d early)"),
               (7.0, "Slight Delay\n(0-7d late)"), (float("inf"), "Severe Delay\n(>7d late)")]


def _band_conditions(x: Column, edges: list[tuple[float, str]], lower: float | None):
    """(condition, index, label) of each right-closed band (lo, hi]; NULL
    matches none, so it stays NULL."""
    lo = lower
    for i, (hi, label) in enumerate(edges):
        cond = x.isNotNull()
        if lo is not None:
            cond = cond & (x > F.lit(lo))
        if hi != float("inf"):
            cond = cond & (x <= F.lit(hi))
        yield cond, i, label
        lo = hi


def right_closed_band(x: Column, edges: list[tuple[float, str]], lower: float | None) -> Column:
    """Label of the right-closed interval (lo, hi] containing ``x``.

    ``lower`` is the open lower edge of the first band (None = -inf);
    values at or below it, and NULL, get NULL.
    """
    expr = None
    for cond, _, label in _band_conditions(x, edges, lower):
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def band_order(x: Column, edges: list[tuple[float, str]], lower: float | None) -> Column:
    """Ordinal (0-based) of the band, to sort labels in interval order."""
    expr = None
    for cond, i, _ in _band_conditions(x, edges, lower):
        expr = F.when(cond, i) if expr is None else expr.when(cond, i)
    return expr


def distance_band(distance_km: Column) -> Column:
    return right_closed_band(distance_km, DISTANCE_BANDS, lower=0.0)


def delay_band(delay_days: Column) -> Column:
    return right_closed_band(delay_days, DELAY_BANDS, lower=None)


def delay_band_order(delay_days: Column) -> Column:
    return band_order(delay_days, DELAY_BANDS, lower=None)


def weekday_monday0(ts: Column) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(ts)


def dummy_name(prefix: str, value: str) -> str:
    return f"{prefix}{value.replace(' ', '_')}"
