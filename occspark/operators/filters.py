"""Filters on features (O-7.*) and the checks of their arguments (O-3.13)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import normalize_period


@dataclass(frozen=True)
class FeatureFilter:
    """What to keep. Unset parts don't filter. bounds: (min lon, min lat, max lon, max lat)."""

    after: str | None = None
    before: str | None = None
    categories: tuple[str, ...] = field(default=())
    periods: tuple[str, ...] = field(default=())
    hour_start: int | None = None
    hour_end: int | None = None
    bounds: tuple[float, float, float, float] | None = None

    def checked(self) -> FeatureFilter:
        """Itself, if the arguments make sense; else ValueError."""
        for d in (self.after, self.before):
            if d is not None:
                if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", d):
                    raise ValueError(f"not a date: {d}")
                date.fromisoformat(d)
        if self.after and self.before and self.before < self.after:
            raise ValueError("before is earlier than after")
        if (self.hour_start is None) != (self.hour_end is None):
            raise ValueError("both hours are needed")
        for h in (self.hour_start, self.hour_end):
            if h is not None and not 0 <= h <= 23:
                raise ValueError(f"not an hour: {h}")
        if self.bounds is not None and not (len(self.bounds) == 4 and self.bounds[0] <= self.bounds[2] and self.bounds[1] <= self.bounds[3]):
            raise ValueError("bounds are out of order")
        return self

    def without(self, **parts: object) -> FeatureFilter:
        """The filter with some parts unset."""
        return replace(self, **parts)

    def column(self) -> Column:
        """The condition, for DataFrame.where."""
        parts = [date_filter(self.after, self.before), category_filter(self.categories), period_filter(self.periods), hour_filter(self.hour_start, self.hour_end), bounds_filter(self.bounds)]
        return reduce(Column.__and__, [p for p in parts if p is not None], F.lit(True))


def check_radius(metres: float) -> float:
    """A radius from 1 to 10000 m, else ValueError."""
    if not 1 <= metres <= 10_000:
        raise ValueError(f"radius out of range: {metres}")
    return metres


def date_filter(after: str | None, before: str | None) -> Column | None:
    """O-7.1: inclusive; unknown dates go once either is set."""
    parts = [F.col("data_ocorrencia") >= F.lit(after).cast("date")] * bool(after) + [F.col("data_ocorrencia") <= F.lit(before).cast("date")] * bool(before)
    return reduce(Column.__and__, parts) if parts else None


def clean_list(values: tuple[str, ...]) -> list[str]:
    """Trimmed, without blanks and repeats, in order."""
    return sorted({v.strip() for v in values if v and v.strip()})


def category_filter(categories: tuple[str, ...]) -> Column | None:
    """O-7.2: any of a feature's categories is wanted."""
    wanted = clean_list(categories)
    return F.arrays_overlap("search_categories", F.array(*map(F.lit, wanted))) if wanted else None


def period_filter(periods: tuple[str, ...]) -> Column | None:
    """O-7.3: by normalized name on both sides."""
    wanted = clean_list(periods)
    return reduce(Column.__or__, [F.col("periodo_normalized") == normalize_period(F.lit(p)) for p in wanted]) if wanted else None


def hour_filter(start: int | None, end: int | None) -> Column | None:
    """O-7.4: from start to end, over midnight if start is later; one alone is a bound."""
    hour = F.col("hora_ocorrencia")
    if start is None and end is None:
        return None
    if start is None or end is None:
        return hour <= end if start is None else hour >= start
    return hour.between(start, end) if start <= end else (hour >= start) | (hour <= end)


def bounds_filter(bounds: tuple[float, float, float, float] | None) -> Column | None:
    """O-7.5: the box, edges included."""
    if bounds is None:
        return None
    return F.col("longitude").between(bounds[0], bounds[2]) & F.col("latitude").between(bounds[1], bounds[3])


def radius_filter(lon: float, lat: float, metres: float, sphere: bool = False) -> Column:
    """O-7.6: a box of so many degrees each way, and the distance on the ellipsoid. The box is square in degrees and cuts the circle's east and west."""
    reach = check_radius(metres) / geo.METRES_PER_DEGREE
    box = F.col("longitude").between(lon - reach, lon + reach) & F.col("latitude").between(lat - reach, lat + reach)
    measure = geo.haversine_m if sphere else geo.ellipsoid_m
    return box & (measure(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon)) <= metres)


def tile_filter(after: str | None = None, before: str | None = None, categories: tuple[str, ...] = (), periods: tuple[str, ...] = (), hours: tuple[str | None, str | None] = (None, None)) -> Column:
    """O-7.7: like the others, but what can't be read is left out, and hours count only as a pair."""

    def real(d: str | None) -> str | None:
        try:
            return date.fromisoformat(d).isoformat() if d else None
        except ValueError:
            return None

    start, end = (int(h) if h is not None and re.fullmatch("[0-9]{1,2}", str(h)) and int(h) <= 23 else None for h in hours)
    both = start is not None and end is not None
    return FeatureFilter(real(after), real(before), tuple(categories), tuple(periods), start if both else None, end if both else None).column()
