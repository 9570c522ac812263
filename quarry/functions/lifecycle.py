"""How records age: buoyancy, stability and tiers."""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


@dataclass(frozen=True)
class Tide:
    floor: float = 0.30
    slope: float = 0.15
    start_days: float = 7.0
    gain: float = 0.5
    cap_days: float = 365.0
    ebb: float = 0.30
    archive: float = 0.05
    ebb_days: int = 90
    archive_days: int = 180
    weights: tuple[tuple[str, float], ...] = (("auto", 0.5), ("search", 1.0), ("drill", 1.5))


def buoyancy(stability: Column, last: Column, created: Column, anchored: Column, now: int, t: Tide = Tide()) -> Column:
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.coalesce(last, created)).cast("double") / DAY)
    s = F.coalesce(stability, F.lit(t.start_days))
    s = F.when(s <= 0, 1.0).otherwise(s)
    return F.when(anchored, 1.0).otherwise(1.0 / (1.0 + F.lit(t.slope) * age / s))


def multiplier(b: Column, t: Tide = Tide()) -> Column:
    return F.lit(t.floor) + F.lit(1 - t.floor) * b


def grown(stability: Column, source: Column, t: Tide = Tide()) -> Column:
    """Stability after one more surfacing from a source."""
    g = None
    for name, w in t.weights:
        g = F.when(source == name, w) if g is None else g.when(source == name, w)
    g = g.otherwise(0.0)
    return F.least(F.lit(t.cap_days), stability * (1.0 + F.lit(t.gain) * g * F.lit(t.cap_days) / (F.lit(t.cap_days) + stability)))


def folded_stability(events: Column, start: Column, t: Tide = Tide()) -> Column:
    """Fold an array of structs (ts, seq, src) in time order: growth depends on the order."""
    return F.aggregate(F.array_sort(events), start.cast("double"), lambda s, e: grown(s, e["src"], t))


def tier(state: Column, b: Column, last: Column, created: Column, anchored: Column, drills: Column, now: int, t: Tide = Tide()) -> Column:
    """The state a sweep leaves a record in. Anchored and drilled ones never sink; archived is final."""
    age = (F.lit(now) - F.coalesce(last, created)).cast("double") / DAY
    keep = anchored | (drills > 0)
    return (
        F.when(keep, state)
        .when((state == "active") & (b < t.ebb) & (age > t.ebb_days), "dormant")
        .when((state == "dormant") & (b < t.archive) & (age > t.archive_days), "archived")
        .otherwise(state)
    )


def recency(age_seconds: Column, half_life_days: float, floor: float = 0.0) -> Column:
    return F.lit(floor) + F.lit(1 - floor) * F.exp(-F.lit(0.6931471805599453) * F.greatest(F.lit(0.0), age_seconds.cast("double") / DAY) / F.lit(half_life_days))
