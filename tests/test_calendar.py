"""Schedules with dates, seasons and holidays against a plain version, minute by minute."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fathomline.functions import calendar

TEXTS = {
    "Mo-Fr 08:00-18:00": True,
    "Mo-Fr 08:00-12:00,13:00-18:00; Sa 09:00-13:00": True,
    "2025 Dec 20 - 2026 Jan 05; Mo 10:00-11:00; Dec 25": True,
    "Jun-Aug: Mo-Sa,PH 07:45-21:30; Sep-May Mo-Fr 09:00-17:00": True,
    "PH 10:00-12:00": True,
    "Nov-Feb": True,
    "(22:00-06:00)": True,
    "Sa-Su 22:00-02:00; Jan 1 off": True,
    "24/7": True,
    "24/7; Dec 26": True,
    "closed": True,
    "Dec 25": True,
    "We,PH 06:00-24:00; Dec 24": True,
    "Mo-Fr 8-18": False,
    "Feb 30": False,
    "2026 Jan 05 - 2025 Dec 20": False,
    "2026 Feb 30 - 2026 Mar 02": False,
    "Mo-Fr 08:00-18:00; sunrise-sunset": False,
    "Mo-Fr 25:00-26:00": False,
    "": False,
    "Mo-Fr 08:00-18:00;": False,
}
HOLIDAYS = [dt.date(2025, 12, 25), dt.date(2025, 12, 26), dt.date(2026, 1, 1), dt.date(2026, 8, 3)]
D, M = ["Mo", "Tu", "We", "Th", "Fr", "Sa", "Su"], ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def cyc(names, spec):
    out = set()
    for item in spec.split(","):
        a, _, b = item.strip().partition("-")
        if a in names:
            i = names.index(a)
            while True:
                out.add(i)
                if names[i] == (b or a):
                    break
                i = (i + 1) % len(names)
    return out


def plain_active(text, t):
    """Written for the texts above: clause by clause."""
    text = text.strip("()")
    parts = [p.strip() for p in text.split(";")]
    day, minute = t.date(), t.hour * 60 + t.minute
    dated = weekly = False
    for p in parts:
        words = p.split()
        if p == "closed":
            continue
        if p == "24/7":
            weekly = True
        elif len(words) >= 2 and words[0] in M and words[1].isdigit():
            if (day.month, day.day) == (M.index(words[0]) + 1, int(words[1])):
                return False
        elif words[0].isdigit() and len(words) == 7:
            first, last = (dt.date(int(words[i]), M.index(words[i + 1]) + 1, int(words[i + 2])) for i in (0, 4))
            dated |= first <= day <= last
        else:
            months = set(range(12))
            if words[0].rstrip(":").split("-")[0] in M:
                months = cyc(M, words[0].rstrip(":"))
                words = words[1:]
            if not words:
                weekly |= day.month - 1 in months
                continue
            times = words[-1]
            spec = words[0] if len(words) > 1 else ("PH" if False else ",".join(D))
            days = cyc(D, spec)
            for item in times.split(","):
                a, b = (int(x[:2]) * 60 + int(x[3:]) for x in item.split("-"))
                if day.month - 1 not in months:
                    continue
                if "PH" in spec and day in HOLIDAYS and a <= minute < b:
                    weekly = True
                if b > a:
                    weekly |= day.weekday() in days and a <= minute < b
                else:
                    weekly |= day.weekday() in days and minute >= a or (day.weekday() - 1) % 7 in days and minute < b
    return dated or weekly


@pytest.fixture(scope="module")
def holidays(spark):
    return spark.createDataFrame([(d,) for d in HOLIDAYS] * 2, "day date")


def moments():
    start = dt.datetime(2025, 12, 18)
    return [start + dt.timedelta(hours=7 * i, minutes=13 * i % 60) for i in range(90)] + [dt.datetime(2026, 8, 3, 11), dt.datetime(2026, 6, 30, 23, 30), dt.datetime(2026, 2, 28, 23, 59), dt.datetime(2025, 12, 24, 23, 59)]


def test_active(spark, holidays):
    rows = spark.createDataFrame([(x, t) for x in TEXTS for t in moments()], "x string, t timestamp")
    got = calendar.with_schedule(calendar.with_holidays(rows, "t", holidays, "h"), "x", "s")
    for r in got.select("x", "t", "s.supported", calendar.active(F.col("s"), F.col("t"), F.col("h")).alias("on")).collect():
        assert r["supported"] == TEXTS[r["x"]], r["x"]
        assert r["on"] == (TEXTS[r["x"]] and plain_active(r["x"], r["t"])), (r["x"], r["t"])
    assert spark.createDataFrame([(None,)], "x string").select(calendar.schedule(F.col("x"))["supported"]).first()[0] is False


def test_next_active(spark, holidays):
    times = moments()[::6]
    rows = spark.createDataFrame([(x, t) for x in TEXTS for t in times] + [(None, times[0])], "x string, t timestamp")
    got = calendar.next_active(rows, "x", "t", holidays)
    assert got.columns == ["x", "t", "next_active"]
    for r in got.collect():
        x, t, n = r["x"], r["t"], r["next_active"]
        if not TEXTS.get(x):
            assert n is None
        elif x in ("closed", "Dec 25"):
            assert n is None
        elif n is not None:
            assert plain_active(x, n) and n >= t, (x, t, n)
            step, at = dt.timedelta(minutes=30), t.replace(minute=t.minute // 30 * 30) + dt.timedelta(minutes=30)
            while at < n:  # no start before it; starts of these texts are at quarters of an hour
                assert not plain_active(x, at), (x, t, n, at)
                at += step
        else:
            assert x == "PH 10:00-12:00" and t > dt.datetime(2026, 8, 3, 10) or x.startswith("2025") is None


def test_contract(spark):
    rows = spark.createDataFrame([(x,) for x in ("2026-01-01", "2026-01-01", "2025-12-25", "2026-1-1", "2026-02-30", "", None, "2026-01-01 ")], "day string")
    r = calendar.holiday_contract(rows).first()
    assert (r["dates"], str(r["first"]), str(r["last"]), r["repeated"], r["invalid"]) == (2, "2025-12-25", "2026-01-01", 1, 5)
    r = calendar.holiday_contract(rows.limit(0)).first()
    assert (r["dates"], r["first"], r["invalid"]) == (0, None, 0)
