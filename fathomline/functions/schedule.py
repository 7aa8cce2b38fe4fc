"""Opening hours as intervals of minutes, parsed once for each distinct text.

Parts are separated by semicolons: days with times (Mo-Fr 08:00-18:00, over
midnight if the end is not after the start), months in front (May-Sep ...), 24/7,
PH with times or off, and single closed dates (Dec 25 off). A text that is not of
that form has no intervals and is not supported, so that rules can fail closed.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of days and months in the order of their numbers.
DAYS = ["Mo", "Tu", "We", "Th", "Fr", "Sa", "Su"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
WEEK, DAY = 7 * 1440, 1440
SCHEMA = "supported boolean, spans array<struct<months:int,start:int,end:int>>, holiday string, holiday_spans array<struct<start:int,end:int>>, closed array<int>"
_DAY, _TIME = "(?:" + "|".join(DAYS) + ")", r"(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})"
_PART = re.compile(rf"(?:({'|'.join(MONTHS)})(?:\s*-\s*({'|'.join(MONTHS)}))?\s+)?({_DAY}(?:-{_DAY})?(?:\s*,\s*{_DAY}(?:-{_DAY})?)*)\s+(.+)")
_CLOSED = re.compile(rf"({'|'.join(MONTHS)})\s+(\d{{1,2}})\s+off")


def _cycle(names: list[str], first: str, last: str | None) -> list[int]:
    """Numbers of the names from first to last, round the end if need be."""
    a, b = names.index(first), names.index(last or first)
    return [(a + i) % len(names) for i in range((b - a) % len(names) + 1)]


def _times(text: str) -> list[tuple[int, int]]:
    """Minutes of each time range of a comma list; an end not after its start is on the next day."""
    out = []
    for part in text.split(","):
        m = re.fullmatch(_TIME, part.strip())
        if not m:
            raise ValueError(text)
        h1, m1, h2, m2 = map(int, m.groups())
        if h1 > 23 or h2 > 24 or m1 > 59 or m2 > 59 or h2 == 24 and m2:
            raise ValueError(text)
        a, b = h1 * 60 + m1, h2 * 60 + m2
        out.append((a, b if b > a else b + DAY))
    return out


def parse(text: str | None) -> dict:
    """Intervals of one text: minutes of the week, with a bit for each month they hold in."""
    out: dict = {"supported": True, "spans": [], "holiday": "", "holiday_spans": [], "closed": []}
    try:
        for part in filter(None, (p.strip() for p in (text or "").split(";"))):
            if part == "24/7":
                out["spans"].append({"months": 4095, "start": 0, "end": WEEK})
            elif m := _CLOSED.fullmatch(part):
                out["closed"].append((MONTHS.index(m[1]) + 1) * 100 + int(m[2]))
            elif part.startswith("PH"):
                rest = part[2:].strip()
                out["holiday"] = "off" if rest == "off" else "open"
                out["holiday_spans"] = [] if rest == "off" else [{"start": a, "end": b} for a, b in _times(rest)]
            elif m := _PART.fullmatch(part):
                months = sum(1 << i for i in (_cycle(MONTHS, m[1], m[2]) if m[1] else range(12)))
                days = [d for x in m[3].split(",") for d in _cycle(DAYS, *(x.strip().split("-") + [None])[:2])]
                out["spans"] += [{"months": months, "start": d * DAY + a, "end": d * DAY + b} for d in days for a, b in _times(m[4])]
            else:
                raise ValueError(part)
    except ValueError:
        return {"supported": False, "spans": [], "holiday": "", "holiday_spans": [], "closed": []}
    return out


def _parsed(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(t) for t in texts], columns=["supported", "spans", "holiday", "holiday_spans", "closed"])


def parse_column(rows: DataFrame, text: str, name: str = "schedule") -> DataFrame:
    """Add the parsed schedule of a column; each distinct text is parsed once."""
    made = rows.select(F.col(text).alias("_t")).distinct().withColumn(name, F.pandas_udf(_parsed, SCHEMA)("_t"))
    return rows.join(made, F.col(text).eqNullSafe(F.col("_t")), "left").drop("_t")


def active_at(schedule: Column, moment: Column, is_holiday: Column | None = None) -> Column:
    """Whether a schedule is active: not on closed dates, nor on holidays if it is off then; else in weekly and seasonal spans (one of Sunday night may reach into Monday) and, on holidays, in those of holidays."""
    minute = F.weekday(moment) * DAY + F.hour(moment) * 60 + F.minute(moment)
    today = minute % DAY
    closed = F.array_contains(schedule["closed"], F.month(moment) * 100 + F.dayofmonth(moment))
    month = F.month(moment)

    def inside(s: Column) -> Column:
        now = (minute >= s["start"]) & (minute < s["end"]) | (minute + WEEK >= s["start"]) & (minute + WEEK < s["end"])
        return now & (F.floor(s["months"] / F.pow(F.lit(2), month - 1)).cast("int") % 2 == 1)

    weekly = F.exists(schedule["spans"], inside)
    holiday = F.coalesce(is_holiday, F.lit(False)) if is_holiday is not None else F.lit(False)
    on_holiday = F.exists(schedule["holiday_spans"], lambda s: (today >= s["start"]) & (today < s["end"]))
    off = holiday & (schedule["holiday"] == "off")
    return schedule["supported"] & ~closed & ~off & (weekly | (holiday & on_holiday))


#: Days ahead in which a schedule that is closed now is looked at; the first few are enough for most.
HORIZON, FIRST_DAYS = 731, 7


def _first_start(schedule: Column, day: Column, after: Column) -> Column:
    """Minute of the first start, after a minute, of a schedule's spans on a day that is not closed; null if there is none."""
    month, weekday = F.month(day), F.weekday(day)
    bit = lambda s: F.floor(s["months"] / F.pow(F.lit(2), month - 1)).cast("int") % 2 == 1
    # a span that is longer than a day goes on at midnight of the others
    on = lambda s: (F.floor(s["start"] / DAY) <= weekday) & (F.floor((s["end"] - 1) / DAY) >= weekday) & bit(s) & ((s["start"] >= weekday * DAY) | (s["end"] - s["start"] > DAY))
    at = F.transform(F.filter(schedule["spans"], on), lambda s: F.greatest(s["start"] - weekday * DAY, F.lit(0)))
    return F.when(~F.array_contains(schedule["closed"], month * 100 + F.dayofmonth(day)), F.array_min(F.filter(at, lambda x: x > after)))


def next_active(rows: DataFrame, text: str, moment: str, name: str = "next_active") -> DataFrame:
    """Add the moment itself if the schedule of a text is active, else the next start of one of its spans, up to HORIZON days ahead; null if there is none.

    Days are taken in order. What comes after a day is the same for all its moments,
    so it is looked for once for each distinct text and day. Holidays are not looked at.
    """
    known = parse_column(rows.withColumn("_day", F.to_date(moment)), text, "_s")
    days = parse_column(known.select(text, "_day").distinct(), text, "_s")

    def first(low: int, high: int) -> Column:
        made = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: F.struct(i.alias("day"), _first_start(F.col("_s"), F.date_add("_day", i), F.lit(-1)).alias("minute")))
        return F.get(F.filter(made, lambda x: x["minute"].isNotNull()), F.lit(0))

    # the far days are only computed where the near ones have nothing
    found = F.coalesce(first(1, FIRST_DAYS), F.when(F.size("_s.spans") > 0, first(FIRST_DAYS + 1, HORIZON)))
    later = days.withColumn("_f", found).select(F.col(text).alias("_t"), F.col("_day").alias("_d"), F.timestamp_add("MINUTE", F.col("_f.minute"), F.timestamp_add("DAY", F.col("_f.day"), F.col("_day").cast("timestamp"))).alias("_later"))
    met = known.join(later, F.col(text).eqNullSafe(F.col("_t")) & F.col("_day").eqNullSafe(F.col("_d")), "left")
    today = _first_start(F.col("_s"), F.col("_day"), F.hour(moment) * 60 + F.minute(moment))
    begins = F.coalesce(F.timestamp_add("MINUTE", today, F.date_trunc("day", F.col(moment))), F.col("_later"))
    now = F.when(active_at(F.col("_s"), F.col(moment)), F.col(moment)).otherwise(begins)
    return met.withColumn(name, F.when(F.col("_s.supported"), now)).select(*(c for c in rows.columns if c != name), name)
