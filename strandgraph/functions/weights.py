"""Confidence grades and weights of edges, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identity import col

# Results depend on these numbers.
CEILING = {"OBSERVED": 1.0, "INFERRED": 0.7, "EXTRACTED": 0.5, "STALE": 0.3}
EXTRACTED_GRADE = {"structural": 0.85, "verified-call-site": 0.85, "url-literal-service-target": 0.7, "url-with-structural-support": 0.5, "hostname-shape-match": 0.2}
PRECISION_FLOOR = 0.7
INFERRED_CONFIDENCE = 0.6
INCIDENT_CONFIDENCE = 0.6
SATURATION_P95_MS = 1000
HOUR_MS = 3_600_000
STALE_CONFIDENCE = 0.3
STALE_AFTER_MS = {"CALLS": HOUR_MS, "CONNECTS_TO": 4 * HOUR_MS, "PUBLISHES_TO": 4 * HOUR_MS, "CONSUMES_FROM": 4 * HOUR_MS, "DEPENDS_ON": 24 * HOUR_MS, "CONFIGURED_BY": 24 * HOUR_MS, "RUNS_ON": 24 * HOUR_MS}
STALE_AFTER_MS_OTHER = 24 * HOUR_MS


def choose(key: Column, values: dict, otherwise) -> Column:
    out = None
    for k, v in values.items():
        out = (F.when if out is None else out.when)(key == k, F.lit(v))
    return out.otherwise(otherwise)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def volume_weight(spans: Column) -> Column:
    return F.when(spans.isNull() | (spans <= 0), 0.5).otherwise(F.least(F.lit(1.0), 0.5 + F.log10(spans + 1) / 3))


def recency_weight(age_ms: Column) -> Column:
    """Falls from 1 to 0.5 between one hour and a day, then jumps to 0.3."""
    return (
        F.when(age_ms.isNull(), 0.8)
        .when(age_ms <= HOUR_MS, 1.0)
        .when(age_ms <= 24 * HOUR_MS, 1.0 - 0.5 * (age_ms - HOUR_MS) / (23.0 * HOUR_MS))
        .otherwise(0.3)
    )


def cleanliness_weight(spans: Column, errors: Column) -> Column:
    rate = F.coalesce(errors, F.lit(0)) / spans.cast("double")
    return F.when(spans.isNull() | (spans <= 0), 1.0).when(rate <= 0.01, 1.0).when(rate >= 0.5, 0.3).otherwise(1.0 - 1.4 * rate)


def age_ms(seen: Column, now: Column) -> Column:
    """Age in milliseconds, not below 0; null without a time."""
    return F.when(seen.isNotNull(), F.greatest(F.lit(0), F.unix_millis(now.cast("timestamp")) - F.unix_millis(seen.cast("timestamp"))))


def edge_confidence(now: Column, signal: str = "signal", live_age: bool = False) -> Column:
    """Ceiling of the provenance x volume x recency x cleanliness.

    The signal's own age comes first; span folding always writes 0 there, so
    edges made from spans do not age.  ``live_age`` ignores it.
    """
    s = col(signal)
    ceiling = choose(col("provenance"), CEILING, 0.5)
    spans = F.coalesce(s["spanCount"], F.col("callCount"))
    live = age_ms(F.col("lastObserved"), now).cast("double")
    age = live if live_age else F.coalesce(s["lastObservedAgeMs"], live)
    bare = spans.isNull() & age.isNull() & s.isNull()
    return F.when(bare, ceiling).otherwise(clamp(ceiling * volume_weight(spans) * recency_weight(age) * cleanliness_weight(spans, s["errorCount"])))


def observed_confidence(spans: Column, errors: Column, age: Column | None = None, threshold_ms: int | None = None) -> Column:
    """Grade of an observed edge from its counts, to three places; 1.0 without any signal."""
    n = spans.cast("double")
    base = (
        F.when(n >= 100, 0.95 + 0.05 * F.least(F.lit(1.0), (n - 100) / 900))
        .when(n >= 10, 0.7 + 0.2 * (n - 10) / 90)
        .when(n > 0, 0.4 + 0.2 * (n - 1) / 9)
        .otherwise(0.4)
    )
    if age is not None and threshold_ms is not None:
        base = F.when(age > threshold_ms, 0.4).otherwise(base)
    penalty = F.when(n > 0, 0.2 * F.least(F.lit(1.0), F.coalesce(errors, F.lit(0)) / n)).otherwise(0.0)
    return F.when(spans.isNull(), 1.0).otherwise(F.round(clamp(base - penalty), 3))


def passes_floor(provenance: Column, confidence: Column, floor: float = PRECISION_FLOOR) -> Column:
    """Whether an edge is precise enough: extracted edges need the floor, others pass."""
    return (provenance != "EXTRACTED") | (F.coalesce(confidence, F.lit(0.0)) >= floor)


def stale_after_ms(kind: Column) -> Column:
    return choose(kind, STALE_AFTER_MS, STALE_AFTER_MS_OTHER)


def classify(emitted: Column, from_callers: Column, stale: Column, p95: Column) -> Column:
    """primary-failure, symptom-only or unrelated."""
    strained = stale | (F.coalesce(p95, F.lit(0.0)) >= SATURATION_P95_MS)
    return (
        F.when((emitted > 0) & strained & (from_callers >= emitted), "symptom-only")
        .when(emitted > 0, "primary-failure")
        .when(from_callers > 0, "symptom-only")
        .otherwise("unrelated")
    )


def is_victim(emitted: Column, from_callers: Column, stale: Column, p95: Column) -> Column:
    """A node that fails only because its callers overload it."""
    strained = stale | (F.coalesce(p95, F.lit(0.0)) >= SATURATION_P95_MS)
    return (from_callers > 0) & strained & (emitted <= from_callers)
