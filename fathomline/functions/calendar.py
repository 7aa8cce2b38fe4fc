"""Schedules with dates, seasons and public holidays, parsed and evaluated by Column functions.

Clauses are separated by semicolons: 24/7; off or closed; days and times (Mo-Fr,Sa
08:00-12:00,13:00-18:00, over midnight if the end is not after the start), with PH
among the days for public holidays and months in front (Jun-Aug: ...) for a season;
months alone; a closed date (Dec 25); a range of dates (2026 Dec 20 - 2027 Jan 05). What
is asked first decides: a closed date, then a range of dates, then holidays' own times,
then seasons and weeks. Any clause of another form makes a text unsupported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.schedule import DAY, DAYS, MONTHS

_DAYS, _MONTHS = "|".join(DAYS), "|".join(MONTHS)
_MONTH_SPEC = rf"(?:{_MONTHS})(?:\s*-\s*(?:{_MONTHS}))?(?:\s*,\s*(?:{_MONTHS})(?:\s*-\s*(?:{_MONTHS}))?)*"
_DAY_SPEC = rf"(?:PH|(?:{_DAYS})(?:\s*-\s*(?:{_DAYS}))?)"
_TIME = r"(?:[01]?[0-9]|2[0-3]):[0-5][0-9]\s*-\s*(?:(?:[01]?[0-9]|2[0-3]):[0-5][0-9]|24:00)"
_WEEKLY = rf"(?:({_MONTH_SPEC})\s*:?\s*)??({_DAY_SPEC}(?:\s*,\s*{_DAY_SPEC})*)?\s*({_TIME}(?:\s*,\s*{_TIME})*)"
_SEASON = rf"({_MONTH_SPEC})\s*:?"
_CLOSED = rf"({_MONTHS})\s+([0-9]{{1,2}})(?:\s+(?:off|closed))?"
_RANGE = rf"([0-9]{{4}})\s+({_MONTHS})\s+([0-9]{{1,2}})\s*-\s*([0-9]{{4}})\s+({_MONTHS})\s+([0-9]{{1,2}})"
ALL_MONTHS, ALL_DAYS = 4095, 127
#: Days that a search for the next start looks ahead.
HORIZON = 731


def _full(text: Column, pattern: str) -> Column:
    return text.rlike(rf"^(?:{pattern})\z")


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(text, rf"^(?:{pattern})\z", i)


def _number(names: list[str], name: Column) -> Column:
    """Place of a name from 0; -1 if it is none."""
    return (F.array_position(F.array(*map(F.lit, names)), F.trim(name)) - 1).cast("int")


def _mask(names: list[str], spec: Column) -> Column:
    """A bit for each name of a list of names and cyclic ranges, others ignored."""
    n = len(names)

    def bits(item: Column) -> Column:
        ends = F.split(item, "-")
        a = _number(names, F.get(ends, F.lit(0)))
        b = _number(names, F.get(ends, F.size(ends) - 1))
        listed = F.transform(F.sequence(F.lit(0), F.pmod(b - a, F.lit(n))), lambda i: F.pow(F.lit(2), F.pmod(a + i, F.lit(n))).cast("int"))
        return F.when((a >= 0) & (b >= 0), F.aggregate(listed, F.lit(0), lambda x, y: x.bitwiseOR(y))).otherwise(F.lit(0))

    return F.aggregate(F.transform(F.split(spec, ","), bits), F.lit(0), lambda x, y: x.bitwiseOR(y))


def _minute(text: Column) -> Column:
    parts = F.split(F.trim(text), ":")
    return F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int")


def _date(text: Column, first: int) -> Column:
    """Date of year, month and day in three groups of a range; null if there is no such day."""
    month = _number(MONTHS, _group(text, _RANGE, first + 1)) + 1
    return F.concat_ws("-", _group(text, _RANGE, first), month.cast("string"), _group(text, _RANGE, first + 2)).try_cast("date")


def bit(mask: Column, i: Column) -> Column:
    return F.floor(mask / F.pow(F.lit(2), i)).cast("int") % 2 == 1


def schedule(text: Column) -> Column:
    """Struct of supported, ranges (first, last), closed (month * 100 + day), spans (months, days, start, end, in minutes of a day) and holidays (months, start, end)."""
    inner = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^\((.*)\)$", "$1")
    parts = F.transform(F.split(inner, ";"), lambda x: F.trim(x))
    off = F.lower(inner).isin("off", "closed")
    span = lambda months, days, start, end: F.struct(months.alias("months"), days.alias("days"), start.alias("start"), end.alias("end"))
    whole = F.array(span(F.lit(ALL_MONTHS), F.lit(ALL_DAYS), F.lit(0), F.lit(DAY)))
    none = F.slice(whole, 1, 0)

    def times(part: Column) -> Column:
        """Spans of the time ranges of a clause; one over midnight is two, the second on the next day."""
        months = F.when(_group(part, _WEEKLY, 1) == "", F.lit(ALL_MONTHS)).otherwise(_mask(MONTHS, _group(part, _WEEKLY, 1)))
        listed = _group(part, _WEEKLY, 2)
        days = F.when(listed == "", F.lit(ALL_DAYS)).otherwise(_mask(DAYS, listed))
        next_days = (days * 2 % 128 + F.floor(days / 64).cast("int")).cast("int")

        def of(item: Column) -> Column:
            start, end = _minute(F.substring_index(item, "-", 1)), _minute(F.substring_index(item, "-", -1))
            return F.when(end > start, F.array(span(months, days, start, end))).otherwise(F.filter(F.array(span(months, days, start, F.lit(DAY)), span(months, next_days, F.lit(0), end)), lambda s: s["end"] > s["start"]))

        return F.flatten(F.transform(F.split(_group(part, _WEEKLY, 3), ","), of))

    def spans(part: Column) -> Column:
        season = F.array(span(_mask(MONTHS, _group(part, _SEASON, 1)), F.lit(ALL_DAYS), F.lit(0), F.lit(DAY)))
        return F.when(F.lower(part) == "24/7", whole).when(_full(part, _SEASON), season).when(_full(part, _WEEKLY), F.filter(times(part), lambda s: s["days"] > 0)).otherwise(none)

    def holidays(part: Column) -> Column:
        named = _full(part, _WEEKLY) & F.contains(_group(part, _WEEKLY, 2), F.lit("PH"))
        # days of holidays are those of the calendar: what reaches over midnight ends there
        own = F.transform(F.filter(times(part), lambda s: (s["start"] > 0) | (s["end"] > 0)), lambda s: F.struct(s["months"].alias("months"), s["start"].alias("start"), s["end"].alias("end")))
        return F.when(named, own).otherwise(F.slice(own, 1, 0))

    def readable(part: Column) -> Column:
        day = _group(part, _CLOSED, 2).try_cast("int")
        length = F.get(F.array(*map(F.lit, (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31))), _number(MONTHS, _group(part, _CLOSED, 1)))
        ordered = F.coalesce(_date(part, 1) <= _date(part, 4), F.lit(False))
        return (F.lower(part) == "24/7") | F.when(_full(part, _RANGE), ordered).when(_full(part, _CLOSED), day.between(1, length)).otherwise(_full(part, _WEEKLY) | _full(part, _SEASON))

    is_closed = lambda part: _full(part, _CLOSED) & ~_full(part, _RANGE)
    closed = F.transform(F.filter(parts, is_closed), lambda p: (_number(MONTHS, _group(p, _CLOSED, 1)) + 1) * 100 + _group(p, _CLOSED, 2).try_cast("int"))
    ranges = F.transform(F.filter(parts, lambda p: _full(p, _RANGE)), lambda p: F.struct(_date(p, 1).alias("first"), _date(p, 4).alias("last")))
    weekly = F.flatten(F.transform(parts, spans))
    own = F.flatten(F.transform(parts, holidays))
    known = off | (F.forall(parts, readable) & (inner != ""))
    some = off | (F.size(weekly) + F.size(own) + F.size(closed) + F.size(ranges) > 0)
    return F.struct((known & some).alias("supported"), ranges.alias("ranges"), closed.alias("closed"), weekly.alias("spans"), own.alias("holidays"))


def _closed_on(s: Column, day: Column) -> Column:
    return F.array_contains(s["closed"], F.month(day) * 100 + F.dayofmonth(day))


def _in_range(s: Column, day: Column) -> Column:
    return F.exists(s["ranges"], lambda r: (r["first"] <= day) & (day <= r["last"]))


def active(s: Column, moment: Column, holiday: Column) -> Column:
    """Whether a schedule holds at a moment; holiday: whether its day is one. An unsupported schedule never does."""
    day, minute = F.to_date(moment), F.hour(moment) * 60 + F.minute(moment)
    month, weekday = F.month(moment) - 1, F.weekday(moment)
    inside = lambda x: (x["start"] <= minute) & (minute < x["end"]) & bit(x["months"], month)
    own = F.coalesce(holiday, F.lit(False)) & F.exists(s["holidays"], inside)
    weekly = F.exists(s["spans"], lambda x: inside(x) & bit(x["days"], weekday))
    return s["supported"] & ~_closed_on(s, day) & (_in_range(s, day) | own | weekly)


def _start(s: Column, day: Column, after: Column) -> Column:
    """Minute of the first start after a minute on a day, of ranges, seasons and weeks."""
    spans = F.filter(s["spans"], lambda x: bit(x["months"], F.month(day) - 1) & bit(x["days"], F.weekday(day)) & (x["start"] > after))
    least = F.array_min(F.transform(spans, lambda x: x["start"]))
    dated = F.when(_in_range(s, day) & (after < 0), F.lit(0))
    return F.when(~_closed_on(s, day), F.least(dated, least))


def with_schedule(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add the schedule of a column's text; each distinct text is parsed once."""
    made = rows.select(F.col(text).alias("_text")).distinct().withColumn(name, schedule(F.col("_text")))
    return rows.join(made, F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")


def with_holidays(rows: DataFrame, moment: str, holidays: DataFrame, name: str) -> DataFrame:
    """Add whether the moment's day is in holidays (day, a date; each once)."""
    known = holidays.select(F.col("day").alias("_day"), F.lit(True).alias(name)).distinct()
    return rows.join(known, F.to_date(moment) == F.col("_day"), "left").drop("_day").withColumn(name, F.coalesce(name, F.lit(False)))


def next_active(rows: DataFrame, text: str, moment: str, holidays: DataFrame, name: str = "next_active") -> DataFrame:
    """Add the moment itself if the schedule of a text holds, else the next start of a range, span or holiday window within HORIZON days; null if there is none.

    What comes after a day is the same for all its moments, so it is looked for once for
    each distinct text and day: ranges and spans day by day, holidays by a join of the
    days ahead with the table of holidays, in pieces of 512 days.
    """
    asked = rows.select(F.col(text).alias("_text"), F.to_date(moment).alias("_day")).distinct()
    texts = asked.select(F.col("_text").alias("_own")).distinct().withColumn("_s", schedule(F.col("_own")))
    days = asked.join(texts, F.col("_text").eqNullSafe(F.col("_own"))).drop("_own")
    ahead = F.transform(F.sequence(F.lit(1), F.lit(HORIZON)), lambda i: F.struct(i.alias("day"), _start(F.col("_s"), F.date_add("_day", i), F.lit(-1)).alias("minute")))
    found = F.get(F.filter(ahead, lambda x: x["minute"].isNotNull()), F.lit(0))
    at = lambda day, minute: F.timestamp_add("MINUTE", minute, day.cast("timestamp"))
    some = F.col("_s.supported") & (F.size("_s.spans") + F.size("_s.ranges") > 0)
    later = days.withColumn("_f", F.when(some, found)).select("_text", "_day", "_s", at(F.date_add("_day", F.col("_f.day")), F.col("_f.minute")).alias("_later"))
    # holidays ahead, the day itself included: every start of a window on a day that is not closed
    piece = lambda d: F.floor(F.unix_date(d) / 512)
    first, last = piece(F.col("_day")), piece(F.date_add("_day", HORIZON))
    open_ = days.where(F.col("_s.supported") & (F.size("_s.holidays") > 0)).withColumn("_piece", F.explode(F.sequence(first, last)))
    dates = holidays.select(F.col("day").alias("_h")).distinct().withColumn("_piece", piece(F.col("_h")))
    met = open_.join(dates, "_piece").where(F.col("_h").between(F.col("_day"), F.date_add("_day", HORIZON)) & ~_closed_on(F.col("_s"), F.col("_h")))
    windows = F.filter("_s.holidays", lambda x: bit(x["months"], F.month("_h") - 1))
    met = met.select("_text", "_day", "_h", F.explode(F.transform(windows, lambda x: x["start"])).alias("_m"))
    starts = met.groupBy("_text", "_day").agg(F.collect_set(at(F.col("_h"), F.col("_m"))).alias("_starts"))  # holidays of two years
    starts = starts.withColumnsRenamed({"_text": "_text2", "_day": "_day2"})
    both = later.join(starts, F.col("_text").eqNullSafe(F.col("_text2")) & (F.col("_day") == F.col("_day2")), "left").drop("_text2", "_day2")
    flagged = with_holidays(rows, moment, holidays, "_holiday")
    same = F.col(text).eqNullSafe(F.col("_text")) & (F.to_date(moment) == F.col("_day"))
    out = flagged.join(both, same, "left")
    now = F.col(moment)
    today = at(F.col("_day"), _start(F.col("_s"), F.col("_day"), F.hour(now) * 60 + F.minute(now)))
    held = F.array_min(F.filter("_starts", lambda t: t > now))
    begins = F.least(F.coalesce(today, F.col("_later")), held)
    value = F.when(active(F.col("_s"), now, F.col("_holiday")), now).otherwise(F.when(F.col("_s.supported"), begins))
    return out.withColumn(name, value).select(*(c for c in rows.columns if c != name), name)


def holiday_contract(texts: DataFrame, text: str = "day") -> DataFrame:
    """Check of a table of holidays as texts, in one row: dates (different ones), first, last, repeated and invalid (not of the form YYYY-MM-DD, or no day)."""
    day = F.when(F.col(text).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.col(text).try_cast("date"))
    per = texts.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("day").isNotNull()
    return per.agg(
        F.count("day").alias("dates"),
        F.min("day").alias("first"),
        F.max("day").alias("last"),
        F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("repeated"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("invalid"),
    )
