"""Conditional rules of a way, evaluated at a moment: access, speed and direction.

Rules are arrays of structs in which ``active`` already tells whether a rule's
condition holds (null: it could not be read).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clauses(text: Column) -> Column:
    """Clauses of a conditional value: separated by semicolons outside parentheses, trimmed, without empty ones."""
    parts = F.split(F.coalesce(text, F.lit("")), r";(?![^(]*\))")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def clause(text: Column) -> Column:
    """Struct of value and condition of one clause, ``value @ (condition)``; null if it is none."""
    pattern = r"^([^@]+?)\s*@\s*\(?(.*?)\)?$"
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).alias("value"), F.regexp_extract(text, pattern, 2).alias("condition")))


def access(rules: Column, classes: list[str], base: Column) -> Column:
    """Whether a vehicle of some classes may pass.

    rules: (mode yes or no, class, active). A rule that could not be read closes the
    way; an active no for one of the classes or for all (class empty) closes it;
    where active yes rules name classes, one of them has to be the vehicle's; else
    what holds without conditions.
    """
    own = F.array(*(F.lit(c) for c in ("", *classes)))
    unread = F.exists(rules, lambda r: r["active"].isNull())
    denied = F.exists(rules, lambda r: F.coalesce(r["active"], F.lit(False)) & (r["mode"] == "no") & F.array_contains(own, r["class"]))
    allows = F.filter(rules, lambda r: F.coalesce(r["active"], F.lit(False)) & (r["mode"] == "yes"))
    named = F.exists(allows, lambda r: F.array_contains(own, r["class"]))
    return F.when(unread | denied, F.lit(False)).when(F.size(allows) > 0, named).otherwise(base)


def speed(base: Column, rules: Column) -> Column:
    """The least of the base limit and the active conditional ones (kmh, active); null if there is none."""
    active = F.transform(F.filter(rules, lambda r: F.coalesce(r["active"], F.lit(False))), lambda r: r["kmh"])
    return F.least(base, F.array_min(active))


def oneway(base: Column, rules: Column) -> Column:
    """The direction rule in force: an active no wins over an active yes, both over the base (value, active)."""
    on = lambda value: F.exists(rules, lambda r: F.coalesce(r["active"], F.lit(False)) & (r["value"] == value))
    return F.when(on("no"), F.lit("no")).when(on("yes"), F.lit("yes")).otherwise(base)


def destination(hgv: Column, limit: Column) -> Column:
    """Struct of access (heavy vehicles that end here only), exception (a limit that does not hold for these) and unsupported (a rule about them that cannot be read).

    hgv is the value of the access tag, limit a conditional one; the exception is a
    clause none, unlimited or unrestricted on condition destination.
    """
    parts = F.filter(F.transform(clauses(limit), clause), lambda c: F.contains(F.lower(c["condition"]), F.lit("destination")))
    plain = lambda c: (F.lower(F.trim(c["condition"])) == "destination") & F.lower(F.trim(c["value"])).isin("none", "unlimited", "unrestricted")
    return F.struct((F.lower(F.trim(F.coalesce(hgv, F.lit("")))) == "destination").alias("access"), F.exists(parts, plain).alias("exception"), F.exists(parts, lambda c: ~plain(c)).alias("unsupported"))
