"""Audits, digests, calibration and entity histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tokens that stand for a missing value.
MISSING = ["", "nan", "none", "null"]


def missing(value: Column) -> Column:
    return value.isNull() | F.lower(F.trim(value.cast("string"))).isin(MISSING)


def field_audit(rows: DataFrame, group: str, fields: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Missing, out-of-range and distinct values of each field, for each group and for ``all``.

    The rows are read once: each gives one long row for each field, and grouping
    sets count both levels together.
    """
    parts = []
    for name, (low, high) in fields.items():
        number = F.col(name).cast("string").try_cast("double")
        bad = ~missing(F.col(name)) & number.isNull()
        if low is not None or high is not None:
            bad = bad | (number < (low if low is not None else float("-inf"))) | (number > (high if high is not None else float("inf")))
        else:
            bad = F.lit(False)
        parts.append(F.struct(F.lit(name).alias("field"), F.when(missing(F.col(name)), None).otherwise(F.col(name).cast("string")).alias("value"), F.coalesce(bad, F.lit(False)).alias("bad")))
    long = rows.select(F.col(group).alias("grp"), F.explode(F.array(*parts)).alias("x")).select("grp", "x.*")
    out = long.groupingSets([["grp", "field"], ["field"]], "grp", "field").agg(
        F.grouping("grp").alias("_all"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("missing"), F.count_if("bad").alias("invalid"), F.countDistinct("value").alias("distinct_values")
    )
    return out.withColumn("grp", F.when(F.col("_all") == 1, "all").otherwise(F.col("grp"))).drop("_all")


def duplicate_groups(rows: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Rows of key values that more than one row has, with their number: a row for each, so that no group has to fit one."""
    counts = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return rows.join(counts, same).select(*keys, "n", F.col(ident).alias("id"))


def status(df: DataFrame, status_: str, quality: str, default: str = "available") -> Column:
    """The first of two columns that is not empty, else the default."""
    return F.coalesce(F.nullif(F.trim(df[status_]), F.lit("")), F.nullif(F.trim(df[quality]), F.lit("")), F.lit(default))


def distribution(rows: DataFrame, value: str) -> DataFrame:
    """Counts of a column's values as one text, value=n sorted by value."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    items = F.array_sort(F.collect_list(F.concat_ws("=", F.col(value), F.col("n").cast("string"))))
    return counts.agg(F.array_join(items, ";").alias("distribution"))


def calibration(rows: DataFrame, score: str, truth: str, thresholds: list[float], scale: float) -> DataFrame:
    """Confusion counts, precision, recall and F1 at each threshold, and the Brier score of score / scale."""
    t, s = F.col(truth).cast("boolean"), F.col(score)
    cells = []
    for i, limit in enumerate(thresholds):
        up = s >= limit
        cells += [F.count_if(up & t).alias(f"tp{i}"), F.count_if(up & ~t).alias(f"fp{i}"), F.count_if(~up & t).alias(f"fn{i}"), F.count_if(~up & ~t).alias(f"tn{i}")]
    brier = F.avg(F.pow(F.least(F.lit(1.0), s / scale) - t.cast("int"), 2)).alias("brier")
    per = F.explode(F.array(*(F.struct(F.lit(float(limit)).alias("threshold"), *(F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "fn", "tn"))) for i, limit in enumerate(thresholds))))
    out = rows.agg(*cells, brier).select(per.alias("x"), "brier").select("x.*", "brier")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b: F.when(b > 0, a / b)
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def confusion(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """The four cells of two boolean columns, empty ones with 0."""
    cells = [(p, a) for p in (0, 1) for a in (0, 1)]
    p, a = F.col(predicted).cast("int"), F.col(actual).cast("int")
    counted = rows.agg(*(F.count_if((p == x) & (a == y)).alias(f"n{x}{y}") for x, y in cells))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(x).alias("predicted"), F.lit(y).alias("actual"), F.col(f"n{x}{y}").alias("n")) for x, y in cells))).alias("x")).select("x.*")


def numeric_token(value: Column) -> Column:
    """A decimal number's shortest plain form (1.50 and 1.5e0 are one), else the text itself."""
    d = value.cast("string").try_cast("decimal(38,18)")
    plain = F.rtrim(F.rtrim(d.cast("string"), F.lit("0")), F.lit("."))
    short = F.when(F.instr(d.cast("string"), ".") > 0, plain).otherwise(d.cast("string"))
    return F.coalesce(F.when(short == "-0", "0").otherwise(short), value.cast("string"))


def row_hash(rows: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of a row's values as text, null apart from empty, joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(numeric_token(F.col(c)), F.lit("\x00")) for c in columns)), 256)


def digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Digest of a multiset of rows in whatever order: count, and the sum modulo 2^64 of each half of their hashes.

    Sums combine in any order, so nothing is gathered or sorted.
    """
    h = rows.select(row_hash(rows, columns).alias("h"))
    part = lambda i: F.conv(F.substring("h", i, 12), 16, 10).cast("decimal(38,0)")
    return h.agg(F.count(F.lit(1)).alias("n"), F.sum(part(1)).cast("string").alias("low"), F.sum(part(13)).cast("string").alias("high"))


def field_kinds(rows: DataFrame) -> DataFrame:
    """numeric or string for each column: whether all its values that are not missing are numbers."""
    tests = [F.bool_and(F.when(~missing(F.col(c)), F.col(c).cast("string").try_cast("double").isNotNull())).alias(c) for c in rows.columns]
    one = rows.agg(*tests)
    items = F.array(*(F.struct(F.lit(c).alias("field"), F.when(F.coalesce(F.col(c), F.lit(False)), "numeric").otherwise("string").alias("kind")) for c in rows.columns))
    return one.select(F.explode(items).alias("x")).select("x.*")


def schema_fingerprint(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ordered columns and their kinds."""
    kinds = field_kinds(rows).withColumn("i", F.array_position(F.array(*map(F.lit, rows.columns)), F.col("field")))
    line = F.transform(F.sort_array(F.collect_list(F.struct("i", "field", "kind"))), lambda x: F.concat_ws(":", x["field"], x["kind"]))
    return kinds.agg(F.sha2(F.array_join(line, ","), 256).alias("fingerprint"))


def history(events: DataFrame, entity: str, ts: str) -> list[Column]:
    """Aggregates of an entity's versions: count, first, last and the days between."""
    days = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / F.lit(86_400_000_000)
    return [F.count(F.lit(1)).alias("versions"), F.min(ts).alias("first_edit"), F.max(ts).alias("last_edit"), days.alias("age_days")]


def with_history(entities: DataFrame, events: DataFrame, key: str, ts: str) -> DataFrame:
    """Entities with their histories; those without one have status not_provided and nulls."""
    made = events.groupBy(key).agg(*history(events, key, ts))
    return entities.join(made, key, "left").withColumn("history_status", F.when(F.col("versions").isNull(), "not_provided").otherwise("available"))


def audit_rules(rows: DataFrame, required: list[str], numeric: list[str], unique: list[str]) -> DataFrame:
    """One row for each rule of a table: rule, column, violations. Missing columns violate once."""
    have = set(rows.columns)
    checks = [(f"numeric:{c}", F.count_if(~missing(F.col(c)) & F.col(c).cast("string").try_cast("double").isNull())) for c in numeric if c in have]
    checks += [(f"unique:{c}", F.count(c) - F.countDistinct(c)) for c in unique if c in have]
    checks += [(f"required:{c}", F.max(F.lit(int(c not in have))).cast("long")) for c in required]
    one = rows.agg(*(F.coalesce(expr, F.lit(0)).cast("long").alias(f"c{i}") for i, (_, expr) in enumerate(checks)))
    items = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"c{i}").alias("violations")) for i, (n, _) in enumerate(checks)))
    return one.select(F.explode(items).alias("x")).select("x.*")


def last_of(rows: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """Of rows that share a key the last one in an order."""
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


# Statuses, sources and warnings of an evidence record.
STATUSES = ["independent_reference", "curated_reference_unverified", "inventory_and_architect_evidence", "inventory_matched", "osm_heritage_tagged", "manual_review_required"]
SOURCES = ["NIAH inventory match", "NIAH architect evidence", "OSM heritage metadata", "archival evidence"]
WARNINGS = ["no NIAH match", "NIAH match is nearest-point fallback", "no architect attribution extracted", "no independent reference supplied", "geometry repaired", "multipart footprint"]


def evidence_status() -> Column:
    """Status by the strongest evidence of a row: has_ref and verified, designer, reg_no, heritage."""
    tests = [F.col("has_ref") & F.col("verified"), F.col("has_ref"), F.col("designer").isNotNull(), F.col("reg_no").isNotNull(), F.col("heritage"), F.lit(True)]
    return F.coalesce(*(F.when(test, F.lit(name)) for test, name in zip(tests, STATUSES)))


def review_priority() -> Column:
    """high from a score of 75 on, or of 55 with the angle and a match; medium from 55 on or with a match."""
    matched = F.col("reg_no").isNotNull()
    return F.when((F.col("score") >= 75) | ((F.col("score") >= 55) & F.col("angle") & matched), "high").when((F.col("score") >= 55) | matched, "medium").otherwise("low")


def _named(tests: list[Column], names: list[str]) -> Column:
    return F.concat_ws("; ", *(F.when(test, F.lit(name)) for test, name in zip(tests, names)))


def evidence_sources() -> Column:
    return _named([F.col("reg_no").isNotNull(), F.col("designer").isNotNull(), F.col("heritage"), F.col("has_ref")], SOURCES)


def evidence_warnings() -> Column:
    matched = F.col("reg_no").isNotNull()
    return _named([~matched, matched & (F.col("mode") == "near"), F.col("designer").isNull(), ~F.col("has_ref"), F.col("repaired"), F.col("multipart")], WARNINGS)


def label_checks(labels: DataFrame, key: str, allowed: dict[str, list], known: DataFrame) -> DataFrame:
    """Counts of what a strict reader refuses: check_ and n. Keys are counted before they are compared, so a key of many rows is one row."""
    bad = reduce(Column.__or__, (~F.col(c).isin(values) for c, values in allowed.items()))
    keys = labels.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad"))
    met = keys.join(known.select(key, F.lit(True).alias("_known")).distinct(), key, "left")
    out = met.agg(
        F.sum("rows").alias("rows"), F.count_if((F.col("rows") > 1) & F.col(key).isNotNull()).alias("duplicate"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("rows"))), F.lit(0)).alias("blank"),
        F.sum("bad").alias("not_allowed"), F.coalesce(F.sum(F.when(F.col("_known").isNull() & F.col(key).isNotNull(), F.col("rows"))), F.lit(0)).alias("unknown"),
    )
    return out.unpivot([], ["rows", "duplicate", "blank", "not_allowed", "unknown"], "check_", "n")


def coverage(entities: DataFrame, samples: DataFrame, key: str, value: str) -> DataFrame:
    """Each entity with what its samples tell: not_covered (none), unreadable (none with a value), partial or available; valid ones and the highest."""
    found = samples.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count(value).alias("_valid"), F.max(value).alias("_highest"))
    status = F.when(F.col("_n").isNull(), "not_covered").when(F.col("_valid") == 0, "unreadable").when(F.col("_valid") < F.col("_n"), "partial").otherwise("available")
    return entities.join(found, key, "left").select(key, status.alias("status"), F.coalesce("_valid", F.lit(0)).alias("valid"), F.round("_highest", 3).alias("highest"))


def differences(left: DataFrame, right: DataFrame, keys: list[str], tolerance: dict[str, float | None], samples: int = 5) -> DataFrame:
    """How two tables differ, by key: a row for each column that does, and for keys of one side only or repeated ones: what, n and samples (key, left, right as texts; the least keys).

    tolerance: for each column to compare the greatest absolute difference of numbers,
    or None for equality; NaN equals NaN and null null. Keys may be null. A key that a
    side repeats is reported as repeated, and its rows are compared with all of the
    other side's. Equal tables give no rows.
    """
    text = lambda side, c: F.col(f"{side}.{c}").cast("string")
    one = lambda df: df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.struct(*tolerance).alias("_v"))
    a, b = one(left).withColumnRenamed("_v", "_left"), one(right).withColumnRenamed("_v", "_right")
    on = None
    for i in range(len(keys)):
        same = F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))
        on = same if on is None else on & same
    a, b = a.withColumnsRenamed({f"_k{i}": f"_a{i}" for i in range(len(keys))}), b.withColumnsRenamed({f"_k{i}": f"_b{i}" for i in range(len(keys))})
    met = a.withColumn("_in_left", F.lit(True)).join(b.withColumn("_in_right", F.lit(True)), on, "full_outer")
    met = met.withColumn("key", F.concat_ws("|", *(F.coalesce(F.when(F.col("_in_left"), F.col(f"_a{i}").cast("string")), F.col(f"_b{i}").cast("string"), F.lit("null")) for i in range(len(keys)))))

    def unlike(c: str, within: float | None):
        x, y = F.col(f"_left.{c}"), F.col(f"_right.{c}")
        if within is None:
            return ~x.eqNullSafe(y)
        # nulls and NaN are equal to their kind; anything else is a distance
        return ~x.eqNullSafe(y) & F.coalesce(F.abs(x - y) > within, F.lit(True))

    row = lambda what, x, y: F.struct(F.lit(what).alias("what"), x.alias("left"), y.alias("right"))
    none = F.lit(None).cast("string")
    both = F.col("_in_left") & F.col("_in_right")
    found = [F.when(F.col("_in_right").isNull(), row("left only", none, none)), F.when(F.col("_in_left").isNull(), row("right only", none, none))]
    found += [F.when(both & unlike(c, within), row(c, text("_left", c), text("_right", c))) for c, within in tolerance.items()]
    rows = met.select("key", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("d")).select("key", "d.*")
    for df, side in ((left, "left"), (right, "right")):
        again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        rows = rows.unionByName(again.select(F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys)).alias("key"), F.lit(f"{side} repeated").alias("what"), none.alias("left"), none.alias("right")))
    total = rows.groupBy("what").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("what").orderBy("key", "left", "right"))
    first = rows.withColumn("_rank", rank).where(F.col("_rank") <= samples).groupBy("what").agg(F.array_sort(F.collect_list(F.struct("key", "left", "right"))).alias("samples"))
    return total.join(first, "what")
