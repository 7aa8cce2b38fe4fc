"""Values written in tags: years, weights, heights, lengths, speeds and durations.

A limit is a struct of status (not_provided, unlimited, supported or unsupported)
and value; what is given but cannot be read is unsupported, so that filters can
fail closed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean no limit, and units in metres and km/h.
UNLIMITED = ["none", "no", "unlimited", "unrestricted"]
NEEDS = ["weight", "rating", "height", "width", "length", "axle"]
FOOT, INCH, MPH, KNOT = 0.3048, 0.0254, 1.609344, 1.852
_NUMBER = r"(\d+(?:\.\d+)?)"


def _limit(text: Column, value: Column) -> Column:
    raw = F.coalesce(F.trim(text), F.lit(""))
    ok = value.isNotNull() & (value >= 0)
    status = F.when(raw == "", "not_provided").when(F.lower(raw).isin(UNLIMITED), "unlimited").when(ok, "supported").otherwise("unsupported")
    return F.struct(status.alias("status"), F.when(status == "supported", value).alias("value"))


def _part(text: Column, pattern: str, group: int) -> Column:
    """A group of a pattern that has to match the whole text; null if it doesn't or the group is empty."""
    whole = f"(?i)^(?:{pattern})$"
    return F.when(F.trim(text).rlike(whole), F.nullif(F.regexp_extract(F.trim(text), whole, group), F.lit("")))


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return _part(text, pattern, group).try_cast("double")


def weight(text: Column) -> Column:
    """Tonnes."""
    return _limit(text, _number(text, _NUMBER + r"\s*(?:t|tonnes?|lt)?"))


def height(text: Column) -> Column:
    """Metres, centimetres or feet and inches."""
    metric = _NUMBER + r"\s*(cm|m|met(?:er|re)s?)?"
    feet = _NUMBER + r"\s*'\s*" + _NUMBER + r"\s*\""
    metres = _number(text, metric) / F.when(F.lower(_part(text, metric, 2)) == "cm", 100.0).otherwise(1.0)
    inches = _number(text, feet, 2)
    return _limit(text, F.coalesce(metres, F.when(inches < 12, _number(text, feet) * FOOT + inches * INCH)))


def dimension(text: Column) -> Column:
    """Width or length: metres, or feet with inches if any."""
    feet = _NUMBER + r"\s*(?:'|ft|feet)(?:\s*" + _NUMBER + r"\s*(?:\"|in|inch(?:es)?))?"
    return _limit(text, F.coalesce(_number(text, _NUMBER + r"\s*(?:m|met(?:er|re)s?)?"), _number(text, feet) * FOOT + F.coalesce(_number(text, feet, 2), F.lit(0.0)) * INCH))


def speed(text: Column) -> Column:
    """km/h."""
    pattern = _NUMBER + r"\s*(km/?h|kph|mph|knots?|kt)?"
    unit = F.lower(F.coalesce(_part(text, pattern, 2), F.lit("")))
    return _limit(text, _number(text, pattern) * F.when(unit == "mph", MPH).when(unit.isin("knot", "knots", "kt"), KNOT).otherwise(1.0))


#: Units of a duration in seconds, the longest first.
_SPANS = {("h", "hour", "hours"): 3600, ("m", "min", "mins", "minute", "minutes"): 60, ("s", "sec", "secs", "second", "seconds"): 1}


def duration(text: Column) -> Column:
    """Seconds of H:MM[:SS] or of hours, minutes and seconds with units, each once, the longest first; null if it is neither or not above 0.

    A clock is cut at its colons; anything else into pairs of a number and a unit,
    and nothing but blanks may be left over.
    """
    low = F.lower(F.trim(text))
    parts = F.split(low, ":")
    fits = F.size(parts).isin(2, 3) & F.forall(parts, lambda x: x.rlike("^[0-9]+$")) & (F.length(parts[0]) <= 3) & F.forall(F.slice(parts, 2, 2), lambda x: (F.length(x) == 2) & (x.try_cast("int") <= 59))
    clock = F.when(fits, parts[0].try_cast("double") * 3600 + parts[1].try_cast("double") * 60 + F.coalesce(F.get(parts, F.lit(2)).try_cast("double"), F.lit(0.0)))
    numbers, units = (F.regexp_extract_all(low, F.lit("([0-9][0-9.]*) *([a-z]+)"), F.lit(i)) for i in (1, 2))
    values = F.transform(numbers, lambda x: F.when(x.rlike("^[0-9]+([.][0-9]+)?$"), x.try_cast("double")))
    factor = lambda u: F.coalesce(*(F.when(u.isin(*names), F.lit(seconds)) for names, seconds in _SPANS.items()))
    factors = F.transform(units, factor)
    falling = F.forall(F.sequence(F.lit(0), F.size(factors) - 1), lambda i: (i == 0) | (F.get(factors, i) < F.get(factors, i - 1)))
    whole = (F.size(units) > 0) & (F.trim(F.regexp_replace(low, "[0-9][0-9.]* *[a-z]+", "")) == "") & ~F.exists(factors, lambda x: x.isNull()) & ~F.exists(values, lambda x: x.isNull())
    summed = F.when(whole, F.when(falling, F.aggregate(F.zip_with(values, factors, lambda v, f: v * f), F.lit(0.0), lambda s, x: s + x)))
    total = F.coalesce(clock, summed)
    return F.when(total > 0, total)


def weight_condition(text: Column) -> Column:
    """Struct of operator and tonnes of a condition such as (weight > 7.5 t); null if it is none."""
    inner = F.regexp_replace(F.trim(text), r"^\((.*)\)$", "$1")
    pattern = r"weight\s*(>=|<=|>|<)\s*" + _NUMBER + r"\s*(?:t|tonnes?)?"
    return F.when(_part(inner, pattern, 1).isNotNull(), F.struct(_part(inner, pattern, 1).alias("op"), _number(inner, pattern, 2).alias("tonnes")))


def turn_condition(text: Column) -> Column:
    """Struct of kind and condition of no_* or only_* @ (condition); null if it is none."""
    pattern = r"((?:no|only)_[A-Za-z0-9_]+)\s*@\s*(.+)"
    return F.when(_part(text, pattern, 1).isNotNull(), F.struct(_part(text, pattern, 1).alias("kind"), F.trim(_part(text, pattern, 2)).alias("condition")))


def rating(hgv: Column, goods: Column) -> Column:
    """Permitted weight rating of heavy vehicles from two tags: the stricter one counts.

    yes and no tell nothing here; if either tag cannot be read, nor can the rating, as
    it may be the stricter one.
    """
    both = [weight(F.when(F.lower(F.trim(x)).isin("yes", "no"), "unreadable").otherwise(x)) for x in (hgv, goods)]
    status = lambda name: reduce(Column.__or__, (x["status"] == name for x in both))
    named = F.when(status("unsupported"), "unsupported").when(status("supported"), "supported").when(status("unlimited"), "unlimited").otherwise("not_provided")
    return F.struct(named.alias("status"), F.when(named == "supported", F.least(*(x["value"] for x in both))).alias("value"))


def passes(limit: Column, need: float | None) -> Column:
    """Whether a vehicle that needs that much gets past a limit; without a need every limit passes."""
    if need is None:
        return F.lit(True)
    return limit["status"].isin("not_provided", "unlimited") | ((limit["status"] == "supported") & (limit["value"] >= need))


def year(text: Column) -> Column:
    """A year from a date cell: its first digits, three or four of them; a longer number loses leading digits until it is one."""
    digits = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"\d+", 0), F.lit(""))
    n = digits.try_cast("bigint")
    plain = digits.try_cast("decimal(38,0)").cast("string")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length(plain) - 3)), lambda i: F.substring(plain, i, F.lit(38)).try_cast("bigint"))
    typo = F.get(F.filter(tails, lambda x: x.between(1000, 2100)), F.lit(0))
    return F.when(n.between(100, 2100), n).when((n > 2100) & (F.length(plain) >= 5), typo).cast("int")


def mid_year(a: Column, b: Column) -> Column:
    """Mean of two years; the first if they are more than 500 apart, the other if one is missing."""
    return F.when(F.abs(a - b) > 500, a.cast("double")).otherwise(F.coalesce((a + b) / 2, a.cast("double"), b.cast("double")))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "y"), F.lit(False))


def first_of(properties: Column, *names: str) -> Column:
    """The first of the named properties (of a map) that is not empty, else an empty text."""
    return F.coalesce(*(F.nullif(F.trim(F.try_element_at(properties, F.lit(n))), F.lit("")) for n in names), F.lit(""))


def profile(text: Column) -> Column:
    """Struct of name, needs (map of numbers) and ok of a vehicle's text, NAME;key=value;...: keys must be known and once each, values finite and above 0."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    pairs = F.transform(rest, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.substring_index(x, "=", -1)).try_cast("double").alias("value")))
    good = lambda p: p["key"].isin(NEEDS) & F.coalesce((p["value"] > 0) & (p["value"] < float("inf")), F.lit(False))
    ok = (F.size(parts) > 0) & ~F.contains(F.get(parts, F.lit(0)), F.lit("=")) & F.forall(pairs, good) & (F.size(F.array_distinct(F.transform(pairs, lambda p: p["key"]))) == F.size(pairs))
    return F.struct(F.when(ok, F.get(parts, F.lit(0))).alias("name"), F.when(ok, F.map_from_entries(pairs)).alias("needs"), F.coalesce(ok, F.lit(False)).alias("ok"))
