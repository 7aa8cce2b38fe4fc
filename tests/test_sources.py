"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from fathomline.functions import polygons, rules, signals
from fathomline.operators import graph, select
from fathomline.sources import files, sinks
from fathomline.sources.store import Scratch


def test_elements(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    named = [{"lat": y, "lon": x} for x, y in ring]
    made = [
        {"osm_type": "way", "id": 1, "tags": {"building": "church"}, "geometry": ring},
        {"type": "relation", "id": 2, "tags": {}, "geometry": {"exterior": named, "holes": []}, "control": True},
        {"osm_type": "way", "id": 3, "tags": {}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"osm_type": "way", "id": 4, "tags": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring]]}},
    ]
    (tmp_path / "e.json").write_text(json.dumps({"elements": made}, indent=1))
    rows = files.elements(spark, str(tmp_path / "e.json")).select("osm_id", "is_control", files.rings(F.col("geometry")).alias("r")).collect()
    assert [r["osm_id"] for r in rows] == ["way/1", "relation/2", "way/3", "way/4"] and [r["is_control"] for r in rows] == [False, True, False, False]
    assert all(r["r"] == [[float(x), float(y)] for x, y in ring] for r in rows)


def test_lines_fail_fast(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.lines(spark, str(tmp_path / "a.jsonl"), "a INT").count() == 2
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        files.lines(spark, str(tmp_path / "b.jsonl"), "a INT").collect()


def test_features_and_histories(spark, tmp_path):
    layer = {"type": "FeatureCollection", "features": [{"geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"name": "x", "n": 3}}]}
    (tmp_path / "l.json").write_text(json.dumps(layer))
    assert files.features(spark, str(tmp_path / "l.json")).first()["properties"] == {"name": "x", "n": "3"}
    (tmp_path / "h.csv").write_text("osm_id,version,timestamp,changeset,uid,geometry_changed,tags_changed,source\nway/1,1,2020-01-01T00:00:00,5,6,yes,0,s\nway/1,2,bad,5,6,,1,s\n")
    a, b = files.history(spark, str(tmp_path / "h.csv")).orderBy("version").collect()
    assert a["ts"] is not None and a["geometry_changed"] and not a["tags_changed"] and b["ts"] is None and b["tags_changed"]


def test_road_edges(spark, tmp_path):
    (tmp_path / "n.csv").write_text("node_id,lat,lon\na,53.0,-7.0\nb,53.01,-7.0\n")
    (tmp_path / "e.csv").write_text("u,v,length_m,oneway,highway,way_id,name,ref,route,ferry\na,b,,,road,1,,,,\nb,a,7.5,yes,,2,,,ferry,\n")
    got = {r["way_id"]: r for r in files.road_edges(spark, str(tmp_path / "e.csv"), files.road_nodes(spark, str(tmp_path / "n.csv"))).collect()}
    assert got["1"]["w"] == pytest.approx(1105.4) and got["2"]["w"] == 7.5 and got["2"]["is_ferry"]


def test_segments(spark):
    ways = spark.createDataFrame([(1, [5, 6, 7]), (2, [9])], "way_id long, nodes array<long>")
    assert {tuple(r) for r in files.segments(ways).collect()} == {(1, 5, 6, 0), (1, 6, 7, 1)}


def test_json_holds_no_nan(spark, tmp_path):
    sinks.write(spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "id int, x double"), str(tmp_path / "o"), "json")
    assert {r["id"]: r["x"] for r in files.lines(spark, str(tmp_path / "o"), "id INT, x DOUBLE").collect()} == {1: None, 2: None, 3: 1.5}


def test_clauses(spark):
    row = spark.createDataFrame([("no @ (Mo-Fr 07:00-09:00; PH off); 30 @ (22:00-06:00);",)], "t string")
    got = row.select(rules.clauses(F.col("t")).alias("c")).select(F.transform("c", rules.clause).alias("x")).first()["x"]
    assert [(x["value"], x["condition"]) for x in got] == [("no", "Mo-Fr 07:00-09:00; PH off"), ("30", "22:00-06:00")]


def test_parts_of_geometries(spark):
    a, b, h = [[0, 0], [4, 0], [4, 4], [0, 0]], [[9, 0], [10, 0], [10, 1], [9, 0]], [[2, 1], [3, 1], [3, 2], [2, 1]]
    named = lambda ring: [{"lat": y, "lon": x} for x, y in ring]
    made = [
        a,
        named(a),
        {"exterior": a, "holes": [h]},
        {"exteriors": [named(a), named(b)], "holes_by_exterior": [[named(h)], []]},
        {"type": "Polygon", "coordinates": [a, h]},
        {"type": "MultiPolygon", "coordinates": [[a, h], [b]]},
    ]
    rows = spark.createDataFrame([(i, json.dumps(g)) for i, g in enumerate(made)] + [(9, None)], "i int, g string").withColumn("p", files.parts(F.col("g")))
    got = {r["i"]: None if r["p"] is None else [(x["outer"], x["ring"]) for x in r["p"]] for r in rows.collect()}
    ring = lambda outer, r: (outer, [[float(x), float(y)] for x, y in r])
    one, two, three = [ring(True, a)], [ring(True, a), ring(False, h)], [ring(True, a), ring(False, h), ring(True, b)]
    assert got == {0: one, 1: one, 2: two, 3: three, 4: two, 5: three, 9: None}
    shapes = rows.select("i", *(c.alias(n) for n, c in files.shape_columns(F.col("p")).items()))
    d = {r["i"]: r["d"] for r in shapes.select("i", polygons.descriptors("xs", "ys", "starts", "outer").alias("d")).collect()}
    assert [d[i]["area"] for i in range(6)] == pytest.approx([8, 8, 7.5, 8, 7.5, 8]) and [d[i]["holes"] for i in range(6)] == [0, 0, 1, 1, 1, 1] and d[9]["status"] == "missing"


def test_latin1_and_buckets(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("name,n\nCaf\u00e9,1\n".encode("latin-1"))
    assert files.latin1(spark, str(tmp_path / "r.csv"), "name STRING, n INT").first()["name"] == "Caf\u00e9"
    sinks.bucketed(spark.range(100).withColumn("x", F.col("id") % 7), "bucketed_rows", "id", 4)
    made = spark.table("bucketed_rows")
    try:
        plan = made.join(made.select("id", F.col("x").alias("y")), "id").hint("merge")._jdf.queryExecution().executedPlan().toString()
        assert made.count() == 100 and "hashpartitioning" not in plan
    finally:
        spark.sql("DROP TABLE bucketed_rows")


def test_numbers_in_tags(spark):
    tags = F.create_map(F.lit("height"), F.lit(" 12.5 m"), F.lit("width"), F.lit("wide"), F.lit("levels"), F.lit("-3"))
    row = spark.range(1).select(signals.tag_number(tags, "height"), signals.tag_number(tags, "width", "height"), signals.tag_number(tags, "levels"), signals.tag_number(tags, "none")).first()
    assert tuple(row) == (12.5, 12.5, 0.0, 0.0)


def test_second_quantity_breaks_ties(spark):
    e = spark.createDataFrame([(1, 2, 5.0, 9.0), (1, 3, 2.0, 1.0), (3, 2, 3.0, 1.0)], "u long, v long, w double, seconds double")
    got = {r["node"]: (r["cost"], r["second"], r["hops"]) for r in graph.shortest(e, spark.createDataFrame([(1, 1, 0.0)], "origin long, node long, start double"), Scratch(spark, "t"), second="seconds").collect()}
    assert got == {1: (0.0, 0.0, 0), 3: (2.0, 1.0, 1), 2: (5.0, 2.0, 2)}


def test_requests_that_are_refused(spark):
    rows = spark.createDataFrame([(1, 2.0)], "id long, score double")
    for limit, offset in ((-1, 0), (1, -1)):
        with pytest.raises(ValueError):
            select.bounded(rows, limit, offset)
    with pytest.raises(ValueError):
        select.report_filter(culture="none")
    with pytest.raises(ValueError):
        signals.signal("none")
