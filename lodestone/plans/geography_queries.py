"""Queries of the geography functions, on points made from keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import geography as G
from lodestone.functions import library as L

from .catalogue import register, spread, table

_LNG, _LAT = "((c_custkey * 37) % 359 - 179.5)", "((c_custkey * 17) % 170 - 84.5)"
_HAVERSINE = "2 * 6371010.0 * asin(sqrt(least(1.0, pow(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2))))"


def _points(spark, sf_dir):
    k = F.col("c_custkey")
    p = G.st_geogpoint((k * 37) % 359 - 179.5, (k * 17) % 170 - 84.5)
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")).select("c_custkey", "c_nationkey", p.alias("p"), G.st_geogpoint(F.lit(13.4), F.lit(52.5)).alias("q"))


@register(
    "geo_points",
    f"""SELECT c_custkey, round({_LNG}, 6) AS x, round({_LAT}, 6) AS y, round({_HAVERSINE.format(a=_LNG, b=_LAT, c=13.4, d=52.5)} / 1000, 3) AS km,
          {_HAVERSINE.format(a=_LNG, b=_LAT, c=13.4, d=52.5)} <= 3000000 AS near, 'POINT(' || {_LNG} || ' ' || {_LAT} || ')' = 'POINT(' || {_LNG} || ' ' || {_LAT} || ')' AS same_text FROM customer""",
)
def geo_points(spark, sf_dir):
    back = G.st_geogfromtext(G.st_astext("p"))
    return _points(spark, sf_dir).select(
        "c_custkey", F.round(G.st_x("p"), 6).alias("x"), F.round(G.st_y("p"), 6).alias("y"), F.round(G.st_distance("p", "q") / 1000, 3).alias("km"),
        G.st_dwithin("p", "q", F.lit(3_000_000)).alias("near"), G.st_equals("p", back).alias("same_text"),
    )


@register(
    "geo_lines",
    f"""SELECT c_custkey, 2::BIGINT AS n, round({_HAVERSINE.format(a=_LNG, b=_LAT, c=13.4, d=52.5)} / 1000, 3) AS km, round(2 * {_HAVERSINE.format(a=_LNG, b=_LAT, c=13.4, d=52.5)} / 1000, 3) AS around,
          round(least({_LNG}, 13.4), 6) AS west, round(greatest({_LAT}, 52.5), 6) AS north FROM customer""",
)
def geo_lines(spark, sf_dir):
    line = G.st_makeline("p", "q")
    box = G.st_boundingbox(line)
    return _points(spark, sf_dir).select(
        "c_custkey", G.st_numpoints(line).alias("n"), F.round(G.st_length(line) / 1000, 3).alias("km"), F.round(G.st_perimeter(line) / 1000, 3).alias("around"),
        F.round(box["xmin"], 6).alias("west"), F.round(box["ymax"], 6).alias("north"),
    )


@register(
    "geo_centroid",
    f"""WITH v AS (SELECT c_nationkey, avg(cos(radians({_LAT})) * cos(radians({_LNG}))) AS x, avg(cos(radians({_LAT})) * sin(radians({_LNG}))) AS y, avg(sin(radians({_LAT}))) AS z FROM customer GROUP BY c_nationkey)
       SELECT c_nationkey, round(degrees(atan2(y, x)), 4) AS lng, round(degrees(atan2(z, sqrt(x * x + y * y))), 4) AS lat FROM v""",
)
def geo_centroid(spark, sf_dir):
    found = _points(spark, sf_dir).groupBy("c_nationkey").agg(G.st_centroid_agg("p").alias("c"))
    return found.select("c_nationkey", F.round("c.lng", 4).alias("lng"), F.round("c.lat", 4).alias("lat"))



def _box(k):
    """A polygon of ten degrees with a hole of two, somewhere north."""
    lng, lat = (k * 37) % 300 - 150.0, (k * 17) % 60 + 1.0
    ring = lambda a, b: F.array(*(F.struct((lng + x).alias("lng"), (lat + y).alias("lat")) for x, y in ((a, a), (b, a), (b, b), (a, b))))
    return G.st_shape("POLYGON", ring(0, 10), ring(4, 6)), lng, lat


@register(
    "geo_shapes",
    """SELECT c_custkey, 'ST_Polygon' AS kind, 2 AS dimension, 10::BIGINT AS points, 1::BIGINT AS parts, false AS empty, 5 AS outer, 1 AS holes, true AS inside, false AS in_hole, false AS outside, true AS apart, true AS ring,
       '{"type":"LineString","coordinates":[[' || ((c_custkey * 37) % 300 - 150.0)::DOUBLE || ',' || ((c_custkey * 17) % 60 + 1.0)::DOUBLE || '],[0.0,0.5]]}' AS json FROM customer""",
)
def geo_shapes(spark, sf_dir):
    shape, lng, lat = _box(F.col("c_custkey"))
    at = lambda x, y: F.struct((lng + x).alias("lng"), (lat + y).alias("lat"))
    line = G.st_shape("LINESTRING", F.array(at(0, 0), F.struct(F.lit(0.0).alias("lng"), F.lit(0.5).alias("lat"))))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", G.st_geometrytype(shape).alias("kind"), G.st_dimension(shape).alias("dimension"), G.st_npoints(shape).alias("points"), G.st_numgeometries(shape).alias("parts"), G.st_isempty(shape).alias("empty"),
        F.size(G.st_exteriorring(shape)).alias("outer"), F.size(G.st_interiorrings(shape)).alias("holes"), G.st_contains(shape, at(2, 2)).alias("inside"), G.st_contains(shape, at(5, 5)).alias("in_hole"),
        L.call("st_within", at(11, 2), shape).alias("outside"), L.call("st_disjoint", shape, at(-1, 5)).alias("apart"), G.st_isring(G.st_exteriorring(shape)).alias("ring"), G.st_asgeojson(G.st_geogfromgeojson(G.st_asgeojson(line))).alias("json"),
    )


@register("geo_hashes", """SELECT c_custkey, true AS near, 'u33dc0cpp' AS known, 9 AS size FROM customer""")
def geo_hashes(spark, sf_dir):
    """A geohash's cell has its point within some metres; and one worked out by hand."""
    hashed = G.st_geohash("p", 12)
    known = G.st_geohash(G.st_geogpoint(F.lit(13.4050), F.lit(52.5200)), 9)
    return _points(spark, sf_dir).select("c_custkey", (G.st_distance(G.st_geogpointfromgeohash(hashed), "p") < 1).alias("near"), known.alias("known"), F.char_length(known).alias("size"))


@register(
    "geo_along",
    f"""WITH x AS (SELECT c_custkey, {_LNG} AS a, {_LAT} AS b FROM customer)
        SELECT c_custkey, round({_HAVERSINE.format(a='a', b='b', c=13.4, d=52.5)} / 2000, 2) AS half_way, true AS middle, round({_HAVERSINE.format(a='a', b='b', c=13.4, d=52.5)} / 1000, 2) AS farthest, true AS closest, false AS closed, a BETWEEN 170 AND 180 OR a <= -100 AS in_box FROM x""",
)
def geo_along(spark, sf_dir):
    line = F.array("p", "q")
    middle = F.col("middle_")
    return _points(spark, sf_dir).withColumn("middle_", G.st_lineinterpolatepoint(line, F.lit(0.5))).select(
        "c_custkey", F.round(G.st_distance("p", middle) / 1000, 2).alias("half_way"), (F.abs(G.st_distance("p", middle) - G.st_distance(middle, "q")) < 1).alias("middle"),
        F.round(G.st_maxdistance(F.array("p"), line) / 1000, 2).alias("farthest"), (G.st_closestpoint(line, "q") == F.col("q")).alias("closest"), G.st_isclosed(line).alias("closed"),
        G.st_intersectsbox("p", F.lit(170.0), F.lit(-90.0), F.lit(-100.0), F.lit(90.0)).alias("in_box"),
    )


@register("geo_extent", f"SELECT c_nationkey, min({_LNG})::DOUBLE AS xmin, min({_LAT})::DOUBLE AS ymin, max({_LNG})::DOUBLE AS xmax, max({_LAT})::DOUBLE AS ymax, count(DISTINCT {_LNG} || ' ' || {_LAT}) AS points FROM customer GROUP BY c_nationkey")
def geo_extent(spark, sf_dir):
    grouped = _points(spark, sf_dir).groupBy("c_nationkey").agg(G.st_extent("p").alias("e"), G.st_npoints(G.st_union_agg_points("p")).alias("points"))
    return grouped.select("c_nationkey", "e.*", "points")
