"""Conditional tags from text, and a search that obeys them, against plain versions."""

import datetime as dt
import heapq

from pyspark.sql import functions as F

from fathomline.functions import conditional
from fathomline.plans import calendars, registry


def plain_clauses(text):
    out, start, depth, quote = [], 0, 0, None
    for i, c in enumerate(text):
        if c in "\"'" and quote in (None, c):
            quote = None if quote else c
        elif quote is None and c == "(":
            depth += 1
        elif quote is None and c == ")":
            depth = max(0, depth - 1)
        elif quote is None and c == ";" and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [x for x in [*out, text[start:].strip()] if x]


CUT = ["a; b", "a @ (x; y); b", "no @ ('x;y'; z); c;", '"a;b";c', "a @ (b (c; d); e); f", ";;a;;", "", None, "a) ; b", "x @ (open; y", '"open; y', "it's; fine", "(a;b)(c;d);e" * 50, "a" * 20_000 + ";b"]


def test_clauses(spark):
    got = spark.createDataFrame([(i, x) for i, x in enumerate(CUT)], "i int, x string").select("i", conditional.clauses(F.col("x")).alias("c")).collect()
    for r in got:
        assert r["c"] == plain_clauses(CUT[r["i"]] or ""), CUT[r["i"]]


def test_rules_that_cannot_be_read(spark):
    texts = ["", None, "yes", "no @ (Mo-Fr 07:00-09:00); maybe @ (Sa 10:00-11:00)", "delivery @ (weight<=3.5)", "hgv; psv @ 24/7", "no @ ()", "no @ (Mo-Fr)"]
    frame = spark.createDataFrame([(x,) for x in texts], "x string")
    got = {r["text"]: (r["readable"], [(x["mode"], x["class"], x["weight"] and tuple(x["weight"])) for x in r["rules"]]) for r in conditional.access(frame, "x").collect()}
    assert got[""] == got[None] == (True, [])
    assert got["yes"] == (True, [("allow", "general", None)])
    assert not got[texts[3]][0] and not got["no @ ()"][0] and not got["no @ (Mo-Fr)"][0]
    assert got[texts[4]] == (True, [("allow", "delivery", ("<=", 3.5))])
    assert got[texts[5]] == (True, [("allow", "hgv", None), ("allow", "psv", None)])


def test_weights_and_classes(spark):
    frame = spark.createDataFrame([("no @ (weight > 7.5 t)",), ("hgv @ (weight >= 7.5)",), ("psv @ (06:00-10:00)",), ("psv",)], "x string")
    rows = conditional.attach(frame, "x", conditional.access(frame, "x"), "r")
    at = F.lit("2026-12-21 07:00:00").cast("timestamp")
    ask = lambda **k: [r[0] for r in rows.orderBy("x").select(conditional.may_pass(F.col("r"), at, F.array().cast("array<date>"), **k)).collect()]
    # in order: hgv ..., no ..., psv, psv @ ...
    assert ask(vehicle="hgv", weight=7.5) == [True, True, False, False]
    assert ask(vehicle="hgv", weight=8.0) == [True, False, False, False]
    assert ask(vehicle="hgv") == [False, True, False, False]
    assert ask(vehicle="psv", weight=3.0) == [False, True, True, True]


def open_at(k, t, holiday):
    wd, mi = t.weekday(), t.hour * 60 + t.minute
    return {
        0: True,
        1: not (wd < 5 and 420 <= mi < 540),
        2: wd < 6 and (420 <= mi < 660 or mi >= 1110),
        3: False,
        4: False,
        5: dt.date(2026, 12, 20) <= t.date() <= dt.date(2027, 1, 5) and not ((holiday or wd < 2) and 600 <= mi < 720),
        6: not 360 <= mi < 600,
    }[k]


def test_paths_by_tags(spark, sf_dir):
    origins = [r["c_custkey"] for r in spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 100 = 0").collect()]
    edges = {}
    for r in calendars.edges(spark, sf_dir).collect():
        edges.setdefault(r["u"], []).append((r["v"], r["w"] * 60, r["cents"], False))
        if r["cents"] % 4:
            edges.setdefault(r["v"], []).append((r["u"], r["w"] * 60, r["cents"], True))
    start, off = dt.datetime.fromisoformat(calendars.START), {dt.date.fromisoformat(d) for d in calendars.DAYS_OFF}
    expected = set()
    for origin in origins:
        best, heap = {}, [(0, origin)]
        while heap:
            cost, node = heapq.heappop(heap)
            if node in best:
                continue
            best[node] = cost
            t = start + dt.timedelta(seconds=cost)
            h, wd, mi = t.date() in off, t.weekday(), t.hour * 60 + t.minute
            for v, seconds, cents, against in edges.get(node, ()):
                free = {1: False, 2: mi >= 1200 or mi < 360, 3: h}.get(cents % 4)
                if not open_at(cents % 7, t, h) or against and not free:
                    continue
                kmh = 80
                if cents % 4 == 1:
                    kmh = 30 if wd < 5 and 420 <= mi < 1020 else 50 if mi >= 1320 or mi < 360 else 80
                heapq.heappush(heap, (cost + -(-seconds * 80 // kmh), v))
        expected |= {(origin, n, float(c)) for n, c in best.items()}
    got = {(r["origin"], r["node"], r["arrival"]) for r in registry.queries()["tagged_paths"](spark, sf_dir).collect()}
    assert got == expected and len(got) >= 50
