"""Sources: elements, layers, histories and plain tables, with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENTS = "elements ARRAY<STRUCT<osm_type: STRING, type: STRING, id: BIGINT, src_way_id: BIGINT, tags: MAP<STRING, STRING>, geometry: STRING, control: BOOLEAN>>"
HISTORY = "osm_id STRING, version INT, timestamp STRING, changeset BIGINT, uid BIGINT, geometry_changed STRING, tags_changed STRING, source STRING"
NODES, EDGES = "node_id STRING, lat DOUBLE, lon DOUBLE", "u STRING, v STRING, length_m DOUBLE, oneway STRING, highway STRING, way_id STRING, name STRING, ref STRING, route STRING, ferry STRING"
#: Storage formats in the order in which they are preferred.
FORMATS = ("parquet", "orc", "csv", "json")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a document of elements: osm_id, tags, geometry (as JSON text), is_control."""
    rows = spark.read.schema(ELEMENTS).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("elements").alias("e"))
    kind = F.coalesce(F.nullif(F.col("e.osm_type"), F.lit("")), F.col("e.type"))
    return rows.select(F.concat_ws("/", kind, F.col("e.id")).alias("osm_id"), "e.tags", "e.geometry", F.coalesce("e.control", F.lit(False)).alias("is_control"), "e.src_way_id")


def rings(geometry: Column) -> Column:
    """The outer ring of a geometry text as an array of (lon, lat): a bare ring, {exterior} or GeoJSON; points as pairs or {lat, lon}."""
    pair, point = "ARRAY<ARRAY<DOUBLE>>", "ARRAY<STRUCT<lat: DOUBLE, lon: DOUBLE>>"
    named = lambda ring: F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))
    inner = F.get_json_object(geometry, "$.exterior")
    first = F.get_json_object(geometry, "$.exteriors[0]")
    layer = F.get_json_object(geometry, "$.coordinates[0]")
    multi = F.get_json_object(geometry, "$.coordinates[0][0]")

    def read(text: Column) -> Column:
        has_names = F.get_json_object(text, "$[0].lat").isNotNull()
        return F.when(has_names, named(F.from_json(text, point))).otherwise(F.from_json(text, pair))

    kind = F.get_json_object(geometry, "$.type")
    return F.coalesce(F.when(kind == "MultiPolygon", read(multi)), F.when(kind == "Polygon", read(layer)), F.when(inner.isNotNull(), read(inner)), F.when(first.isNotNull(), read(first)), read(geometry))


def parts(geometry: Column) -> Column:
    """All rings of a geometry text, in order: array of (outer, ring), each outer ring before its holes.

    Reads what rings() does, and all of {exterior, holes}, {exteriors,
    holes_by_exterior}, Polygon and MultiPolygon.
    """
    point = "STRUCT<lat: DOUBLE, lon: DOUBLE>"

    def read(path: str, depth: int) -> Column:
        """Rings nested in depth arrays, of pairs or of {lat, lon}."""
        text = F.get_json_object(geometry, path)
        nest = lambda inner: "ARRAY<" * (depth + 1) + inner + ">" * (depth + 1)
        pairs = lambda x, d: F.transform(x, (lambda p: F.array(p["lon"], p["lat"])) if d == 0 else (lambda y: pairs(y, d - 1)))
        return F.when(F.contains(text, F.lit('"lat"')), pairs(F.from_json(text, nest(point)), depth)).otherwise(F.from_json(text, nest("ARRAY<DOUBLE>")))

    ring = lambda outer, r: F.struct(outer.alias("outer"), r.alias("ring"))
    none = F.array().cast("array<array<array<double>>>")
    listed = lambda x: F.transform(x, lambda r, i: ring(i == 0, r))
    with_holes = lambda outer, holes: F.concat(F.array(ring(F.lit(True), outer)), F.transform(F.coalesce(holes, none), lambda r: ring(F.lit(False), r)))
    kind, one, many, holes = F.get_json_object(geometry, "$.type"), read("$.exterior", 0), read("$.exteriors", 1), read("$.holes_by_exterior", 2)
    several = F.flatten(F.transform(many, lambda r, i: with_holes(r, F.coalesce(F.get(holes, i), F.when(i == 0, read("$.holes", 1))))))
    return F.coalesce(
        F.when(kind == "MultiPolygon", F.flatten(F.transform(read("$.coordinates", 2), listed))),
        F.when(kind == "Polygon", listed(read("$.coordinates", 1))),
        F.when(many.isNotNull(), several),
        F.when(one.isNotNull(), with_holes(one, read("$.holes", 1))),
        F.when(read("$", 0).isNotNull(), F.array(ring(F.lit(True), read("$", 0)))),
    )


def shape_columns(rings_: Column) -> dict[str, Column]:
    """xs, ys, starts and outer of rings as parts() gives them, as functions.polygons takes them."""
    sizes = F.transform(rings_, lambda r: F.size(r["ring"]))
    axis = lambda k: F.flatten(F.transform(rings_, lambda r: F.transform(r["ring"], lambda p: p[k])))
    starts = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, n: a + n))
    return {"xs": axis(0), "ys": axis(1), "starts": starts, "outer": F.transform(rings_, lambda r: r["outer"])}


def features(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GeoJSON layer in their order: seq, geometry (JSON text), properties as texts."""
    schema = "features ARRAY<STRUCT<geometry: STRING, properties: MAP<STRING, STRING>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.posexplode("features").alias("seq", "f")).select("seq", "f.geometry", "f.properties")


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def table(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.csv(path, header=True, encoding="UTF-8") if kind == "csv" else reader.format(kind).load(path)


def latin1(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A regional register in Latin-1."""
    return spark.read.schema(schema).csv(path, header=True, encoding="ISO-8859-1")


def first_readable(spark: SparkSession, paths: dict[str, str], schema: str | None = None, prefer: tuple[str, ...] = FORMATS) -> tuple[DataFrame, str, list[str]]:
    """The first format of an order of preference that can be read, its name and the errors of those before it."""
    errors = []
    for kind in (k for k in prefer if k in paths):
        try:
            rows = table(spark, paths[kind], kind, schema)
            rows.limit(1).count()  # reads no more than a row
            return rows, kind, errors
        except Exception as e:  # a reader may fail in any way
            errors.append(f"{kind}: {type(e).__name__}")
    raise ValueError(f"no readable format: {errors or sorted(paths)}")


def history(spark: SparkSession, path: str) -> DataFrame:
    """Versions of entities; a time without a zone is UTC, a bad one null."""
    rows = table(spark, path, "csv", HISTORY)
    flag = lambda c: F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "y"), F.lit(False))
    return rows.select("osm_id", "version", F.try_to_timestamp("timestamp").alias("ts"), "changeset", "uid", flag("geometry_changed").alias("geometry_changed"), flag("tags_changed").alias("tags_changed"), "source")


def road_nodes(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "csv", NODES)


def road_edges(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """Edges with a length: the one given, else from the nodes' coordinates; ferry marks routes and tags that say so."""
    from fathomline.functions.geo import equirect
    from fathomline.functions.limits import truthy

    edges = table(spark, path, "csv", EDGES)
    a, b = (nodes.select(F.col("node_id").alias(e), F.col("lat").alias(f"lat_{e}"), F.col("lon").alias(f"lon_{e}")) for e in ("u", "v"))
    met = edges.join(a, "u").join(b, "v")
    length = F.coalesce("length_m", equirect(*(F.col(c) for c in ("lat_u", "lon_u", "lat_v", "lon_v"))))
    return met.select("u", "v", length.alias("w"), "oneway", "highway", "way_id", ((F.col("route") == "ferry") | truthy(F.col("ferry"))).alias("is_ferry"))


def segments(ways: DataFrame) -> DataFrame:
    """Consecutive node pairs of ways (way_id, nodes) without a window: each array gives its own pairs."""
    pairs = F.transform(F.slice("nodes", 1, F.greatest(F.size("nodes") - 1, F.lit(0))), lambda n, i: F.struct(n.alias("u"), F.get("nodes", i + 1).alias("v"), i.alias("pos")))
    return ways.select("way_id", F.explode(pairs).alias("s")).select("way_id", "s.*")
