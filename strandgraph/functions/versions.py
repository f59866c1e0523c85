"""Version numbers as comparable arrays, and what ranges admit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"(\d{1,9})(?:\.(\d{1,9}))?(?:\.(\d{1,9}))?"


def coerce(text: Column) -> Column:
    """[major, minor, patch] of the first version-like number in a text; null without one."""
    first = F.regexp_extract(text, _NUMBER, 1)
    parts = [F.coalesce(F.regexp_extract(text, _NUMBER, i).try_cast("int"), F.lit(0)) for i in (1, 2, 3)]
    return F.when(first != "", F.array(*parts))


def older(a: Column, b: Column) -> Column:
    """Whether version a is below version b; null if either is none."""
    return coerce(a) < coerce(b)


def dotted_older(a: Column, b: Column) -> Column:
    """Compare dotted integers of any length; missing or other parts count as 0."""

    def numbers(text: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(text, "^[vV]", ""), r"[.\-+]"), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))

    pairs = F.zip_with(numbers(a), numbers(b), lambda p, q: F.struct(F.coalesce(p, F.lit(0)).alias("p"), F.coalesce(q, F.lit(0)).alias("q")))
    first = F.get(F.filter(pairs, lambda z: z["p"] != z["q"]), 0)
    return F.coalesce(first["p"] < first["q"], F.lit(False))


def clean(text: Column) -> Column:
    """A declared version without range operators and leading v."""
    return F.regexp_replace(F.trim(text), r"^[\^~>=<v\s]+", "")


def lower_bound(alternative: Column) -> Column:
    """Least version that one alternative of a range admits (0.0.0 if unbounded)."""
    hyphen = F.regexp_extract(alternative, r"^\s*v?(\d[\d.]*)\s+-\s+", 1)
    tokens = F.regexp_extract_all(alternative, F.lit(r"(?:^|[\s,])((?:>=|>|\^|~|=)?\s*v?\d[\d.xX*]*)"), F.lit(1))
    bounds = F.transform(tokens, lambda t: coerce(F.regexp_replace(t, "[xX*]", "0")))
    return F.when(hyphen != "", coerce(hyphen)).otherwise(F.coalesce(F.array_max(bounds), F.array(F.lit(0), F.lit(0), F.lit(0))))


def admits_only_from(declared: Column, required: Column) -> Column:
    """Whether a declared range lies within >= required; true when the requirement is not a version."""
    lows = F.transform(F.split(declared, r"\|\|"), lower_bound)
    return F.coalesce(F.array_min(lows) >= coerce(required), F.lit(True))
