"""Conditional tags as rules: texts are cut into clauses, clauses read into rows, and rules evaluated at a moment.

Texts are read once each: clauses are rows until their conditions are parsed, then
arrays beside the text, to be joined with what has it. A text with a clause that
cannot be read is not readable, so that access under it can fail closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import calendar, limits

# What a clause's value stands for.
ALLOW, DENY, CLASSES = ["yes", "permissive"], ["no", "closed"], ["delivery", "hgv", "psv", "taxi"]
ALWAYS = "24/7"
#: Pieces of a text: quoted, in parentheses (quotes and one more pair inside), other characters; what is not closed reaches to the end.
_PIECE = r"""(?:"[^"]*+"?+|'[^']*+'?+|\((?:[^()"']|"[^"]*+"?+|'[^']*+'?+|\([^()]*+\)?+)*+\)?+|\)|[^;"'()]++)++"""
_CLAUSE = r"(?s)^\s*([A-Za-z_]+)\s*@\s*(.+?)\s*\z"
_VALUED = r"(?s)^([^@]*)@(.*)\z"
_NAMES = {"access": "mode string, class string", "speed": "kmh double", "oneway": "value string"}


def clauses(text: Column) -> Column:
    """Clauses of a value, cut at semicolons outside quotes and parentheses, trimmed, without empty ones."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECE), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def _rows(texts: DataFrame, text: str) -> DataFrame:
    known = texts.select(F.col(text).alias("text")).distinct()
    return known.select("text", F.posexplode_outer(clauses(F.col("text"))).alias("i", "clause"))


def _condition(rows: DataFrame, weights: bool) -> DataFrame:
    """Add schedule, weight (a condition on it) and whether either was read."""
    rows = rows.withColumn("schedule", calendar.schedule(F.col("condition")))
    rows = rows.withColumn("weight", limits.weight_condition(F.col("condition")) if weights else F.lit(None).cast("struct<op:string,tonnes:double>"))
    return rows.withColumn("understood", F.col("schedule.supported") | F.col("weight").isNotNull())


def _gathered(rows: DataFrame, fields: list[str]) -> DataFrame:
    """text, readable and rules in the order of their clauses; a text without clauses has none and is readable."""
    rule = F.when(F.col("i").isNotNull(), F.struct("i", *fields, "schedule", "weight"))
    out = rows.groupBy("text").agg(F.array_sort(F.collect_list(rule), lambda a, b: a["i"] - b["i"]).alias("rules"), F.bool_and(F.col("i").isNull() | F.coalesce("readable", F.lit(False))).alias("readable"))
    return out.select("text", "readable", "rules")


def access(texts: DataFrame, text: str) -> DataFrame:
    """Rules of conditional access by text: mode (allow, deny), class (general for all) and what they hold on: a schedule or a weight."""
    rows = _rows(texts, text)
    low, valued = F.lower("clause"), F.col("clause").rlike(_CLAUSE)
    bare = low.isin(*ALLOW, *DENY, *CLASSES)
    value = F.when(bare, low).when(valued, F.lower(F.regexp_extract("clause", _CLAUSE, 1)))
    rows = rows.withColumn("value", value).withColumn("condition", F.when(bare, F.lit(ALWAYS)).when(valued, F.regexp_extract("clause", _CLAUSE, 2)))
    rows = _condition(rows, weights=True)
    named = F.col("value").isin(*CLASSES)
    rows = rows.withColumn("mode", F.when(F.col("value").isin(*ALLOW) | named, "allow").when(F.col("value").isin(*DENY), "deny"))
    rows = rows.withColumn("class", F.when(named, F.col("value")).otherwise("general"))
    return _gathered(rows.withColumn("readable", F.col("mode").isNotNull() & F.col("understood")), ["mode", "class"])


def _split(rows: DataFrame, otherwise_value: Column, otherwise_condition: Column) -> DataFrame:
    has = F.contains(F.col("clause"), F.lit("@"))
    rows = rows.withColumn("value", F.when(has, F.trim(F.regexp_extract("clause", _VALUED, 1))).otherwise(otherwise_value))
    return rows.withColumn("condition", F.when(has, F.trim(F.regexp_extract("clause", _VALUED, 2))).otherwise(otherwise_condition))


def speeds(texts: DataFrame, text: str) -> DataFrame:
    """Rules of conditional speed by text: kmh, null for no limit."""
    rows = _condition(_split(_rows(texts, text), F.col("clause"), F.lit(ALWAYS)), weights=False).withColumn("limit", limits.speed(F.col("value")))
    rows = rows.withColumn("kmh", F.when(F.col("limit.status") == "supported", F.col("limit.value")))
    return _gathered(rows.withColumn("readable", F.col("limit.status").isin("supported", "unlimited") & F.col("understood")), ["kmh"])


def oneways(texts: DataFrame, text: str) -> DataFrame:
    """Rules of conditional one-way traffic by text: value (yes, no); a schedule alone means yes."""
    rows = _condition(_split(_rows(texts, text), F.lit("yes"), F.col("clause")), weights=False)
    low = F.lower("value")
    rows = rows.withColumn("value", F.when(low.isin("1", "true"), "yes").when(low == "0", "no").otherwise(low))
    return _gathered(rows.withColumn("readable", F.col("value").isin("yes", "no") & F.col("understood")), ["value"])


def attach(rows: DataFrame, text: str, made: DataFrame, name: str) -> DataFrame:
    """Add the rules of a column's texts as a struct of readable and rules."""
    known = made.select(F.col("text").alias("_text"), F.struct("readable", "rules").alias(name))
    return rows.join(known, F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")


def _on(rule: Column, moment: Column, holidays: Column, weight: float | None) -> Column:
    """Whether a rule holds. Without a weight none that asks for one does."""
    holiday = F.array_contains(holidays, F.to_date(moment))
    heavy = F.lit(False)
    if weight is not None:
        op, tonnes = rule["weight"]["op"], rule["weight"]["tonnes"]
        heavy = F.when(op == ">", F.lit(weight) > tonnes).when(op == ">=", F.lit(weight) >= tonnes).when(op == "<", F.lit(weight) < tonnes).otherwise(F.lit(weight) <= tonnes)
    return F.when(rule["weight"].isNotNull(), heavy).otherwise(calendar.active(rule["schedule"], moment, holiday))


def may_pass(parsed: Column, moment: Column, holidays: Column, vehicle: str = "general", weight: float | None = None) -> Column:
    """Whether a vehicle of a class may enter at a moment: an unreadable text closes; an active deny of its class or of all closes; where there are allow rules an active one has to name it or all.

    An exception: where only public transport is allowed at times, all others may pass
    outside these. holidays: an array of dates.
    """
    rules = parsed["rules"]
    here = F.filter(rules, lambda r: _on(r, moment, holidays, weight))
    own = lambda r: r["class"].isin("general", vehicle)
    denied = F.exists(here, lambda r: (r["mode"] == "deny") & own(r))
    allows = F.filter(rules, lambda r: r["mode"] == "allow")
    granted = F.filter(here, lambda r: r["mode"] == "allow")
    apart = F.lit(vehicle != "psv") & (F.size(granted) == 0) & F.forall(allows, lambda r: r["class"] == "psv")
    return F.when(~F.coalesce(parsed["readable"], F.lit(True)) | denied, F.lit(False)).otherwise((F.size(F.coalesce(allows, F.array())) == 0) | apart | F.exists(granted, own))


def speed_at(base: Column, parsed: Column, moment: Column, holidays: Column) -> Column:
    """The least of the base limit and the active readable ones; null where there is none."""
    kmh = F.transform(F.filter(parsed["rules"], lambda r: r["schedule"]["supported"] & r["kmh"].isNotNull() & _on(r, moment, holidays, None)), lambda r: r["kmh"])
    return F.least(base, F.array_min(kmh))


def oneway_at(base: Column, parsed: Column, moment: Column, holidays: Column) -> Column:
    """The value in force: an active no before an active yes, both before the base; what cannot be read changes nothing."""
    on = lambda v: F.exists(F.coalesce(parsed["rules"], F.array()), lambda r: (r["value"] == v) & _on(r, moment, holidays, None))
    return F.when(on("no"), F.lit("no")).when(on("yes"), F.lit("yes")).otherwise(base)
