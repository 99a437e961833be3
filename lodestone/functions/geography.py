"""Points, lines and polygons on a sphere, as structs and arrays of (lng, lat) in degrees.

Distances are along great circles on a sphere of EARTH metres; areas are of spherical polygons. Rings are arrays of
points without the closing one; a polygon is the smaller side of its ring.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .library import FUNCTIONS, col, function

#: Radius of the sphere, in metres.
EARTH = 6_371_010.0


def _rad(x: Column) -> Column:
    return F.radians(x)


@function
def st_geogpoint(lng, lat):
    lng, lat = col(lng).cast("double"), col(lat).cast("double")
    checked = F.when((lat < -90) | (lat > 90), F.raise_error(F.lit("a latitude is out of range"))).otherwise(lat)
    # longitudes wrap around
    return F.when(lng.isNotNull() & lat.isNotNull(), F.struct((F.pmod(lng + 180, F.lit(360.0)) - 180).alias("lng"), checked.alias("lat")))


@function
def st_x(p):
    return col(p)["lng"]


@function
def st_y(p):
    return col(p)["lat"]


def _angle(a: Column, b: Column) -> Column:
    """By the haversine formula, which is exact for near points."""
    lat, lng = _rad(b["lat"] - a["lat"]) / 2, _rad(b["lng"] - a["lng"]) / 2
    h = F.sin(lat) * F.sin(lat) + F.cos(_rad(a["lat"])) * F.cos(_rad(b["lat"])) * F.sin(lng) * F.sin(lng)
    return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


@function
def st_distance(a, b):
    return _angle(col(a), col(b)) * EARTH


@function
def st_dwithin(a, b, metres):
    return st_distance(a, b) <= col(metres)


@function
def st_equals(a, b):
    return (col(a)["lng"] == col(b)["lng"]) & (col(a)["lat"] == col(b)["lat"])


@function
def st_azimuth(a, b):
    """In radians, clockwise from north, from 0 on; null for equal points."""
    a, b = col(a), col(b)
    d = _rad(b["lng"] - a["lng"])
    y = F.sin(d) * F.cos(_rad(b["lat"]))
    x = F.cos(_rad(a["lat"])) * F.sin(_rad(b["lat"])) - F.sin(_rad(a["lat"])) * F.cos(_rad(b["lat"])) * F.cos(d)
    return F.when(~st_equals(a, b), F.pmod(F.atan2(y, x), F.lit(2 * math.pi)))


@function
def st_makeline(*points):
    return F.array(*map(col, points))


@function
def st_numpoints(line):
    return F.size(col(line)).cast("long")


@function
def st_pointn(line, n: int):
    return F.get(col(line), F.lit(n - 1)) if n > 0 else F.try_element_at(col(line), F.lit(n))


@function
def st_startpoint(line):
    return F.get(col(line), F.lit(0))


@function
def st_endpoint(line):
    return F.try_element_at(col(line), F.lit(-1))


def _edges(line: Column) -> Column:
    return F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


@function
def st_length(line):
    return F.aggregate(_edges(col(line)), F.lit(0.0), lambda s, e: s + _angle(e["a"], e["b"]) * EARTH)


def _closed(ring: Column) -> Column:
    return F.concat(ring, F.slice(ring, 1, 1))


@function
def st_perimeter(ring):
    return st_length(_closed(col(ring)))


@function
def st_area(ring):
    """By the sum of the signed areas between edges and the equator."""

    def lune(e: Column) -> Column:
        d = F.pmod(_rad(e["b"]["lng"] - e["a"]["lng"]) + math.pi, F.lit(2 * math.pi)) - math.pi
        a, b = F.tan(_rad(e["a"]["lat"]) / 2), F.tan(_rad(e["b"]["lat"]) / 2)
        return 2 * F.atan2(F.tan(d / 2) * (a + b), 1 + a * b)

    excess = F.abs(F.aggregate(_edges(_closed(col(ring))), F.lit(0.0), lambda s, e: s + lune(e)))
    return F.least(excess, 4 * math.pi - excess) * EARTH * EARTH


@function
def st_astext(p):
    return F.concat(F.lit("POINT("), col(p)["lng"].cast("string"), F.lit(" "), col(p)["lat"].cast("string"), F.lit(")"))


@function
def st_geogfromtext(text):
    """Of a POINT."""
    number = r"(-?\d+(?:\.\d+)?(?:[eE]-?\d+)?)"
    pattern = rf"^\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$"
    part = lambda i: F.regexp_extract(F.upper(col(text)), pattern, i)
    return F.when(F.upper(col(text)).rlike(pattern), st_geogpoint(part(1).cast("double"), part(2).cast("double")))


@function
def st_centroid_agg(p):
    """Of points: the direction of their mean on the sphere."""
    lat, lng = _rad(col(p)["lat"]), _rad(col(p)["lng"])
    x, y, z = F.avg(F.cos(lat) * F.cos(lng)), F.avg(F.cos(lat) * F.sin(lng)), F.avg(F.sin(lat))
    return F.struct(F.degrees(F.atan2(y, x)).alias("lng"), F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"))


@function
def st_boundingbox(line):
    """(xmin, ymin, xmax, ymax), of lines that don't cross the date line."""
    lng, lat = F.transform(col(line), lambda p: p["lng"]), F.transform(col(line), lambda p: p["lat"])
    return F.struct(F.array_min(lng).alias("xmin"), F.array_min(lat).alias("ymin"), F.array_max(lng).alias("xmax"), F.array_max(lat).alias("ymax"))


@function
def st_snaptogrid(p, size: float):
    return F.struct((F.round(col(p)["lng"] / size) * size).alias("lng"), (F.round(col(p)["lat"] / size) * size).alias("lat"))


__all__ = ["EARTH", "FUNCTIONS"]


# shapes: structs of a kind (POINT, LINESTRING, POLYGON, a MULTI of these) and parts, arrays of arrays of points;
# a polygon's first part is its outer ring, rings without their closing point


def _shape(kind: str, parts: Column) -> Column:
    return F.when(parts.isNotNull(), F.struct(F.lit(kind).alias("kind"), parts.alias("parts")))


@function
def st_shape(kind: str, *parts):
    """A shape of arrays of points."""
    return _shape(kind, F.array(*map(col, parts)))


@function
def st_makepolygon(ring, *holes):
    """Of lines whose last point is the first."""
    open_ = lambda line: F.slice(col(line), 1, F.size(col(line)) - 1)
    closed = F.element_at(col(ring), 1) == F.element_at(col(ring), -1)
    return F.when(closed, _shape("POLYGON", F.array(open_(ring), *map(open_, holes)))).otherwise(F.raise_error(F.lit("a polygon's line must be closed")))


FUNCTIONS["st_makepolygonoriented"] = st_makepolygon


def _points_of(shape) -> Column:
    return F.flatten(col(shape)["parts"])


@function
def st_geometrytype(shape):
    return F.concat(F.lit("ST_"), F.initcap(F.regexp_replace(F.lower(col(shape)["kind"]), "linestring", "LineString")).substr(1, 1 << 10))


@function
def st_dimension(shape):
    kind = col(shape)["kind"]
    return F.when(F.size(_points_of(shape)) == 0, -1).when(kind.endswith("POINT"), 0).when(kind.endswith("LINESTRING"), 1).otherwise(2)


@function
def st_isempty(shape):
    return F.size(_points_of(shape)) == 0


@function
def st_iscollection(shape):
    return col(shape)["kind"].startswith("MULTI") & (F.size(col(shape)["parts"]) > 1)


@function
def st_npoints(shape):
    """A ring's closing point counts."""
    rings = F.when(col(shape)["kind"].endswith("POLYGON"), F.size(col(shape)["parts"])).otherwise(0)
    return (F.size(_points_of(shape)) + rings).cast("long")


@function
def st_numgeometries(shape):
    one = F.when(F.size(_points_of(shape)) > 0, 1).otherwise(0)
    return F.when(col(shape)["kind"].startswith("MULTI"), F.size(col(shape)["parts"])).otherwise(one).cast("long")


@function
def st_dump(shape):
    """The parts of a MULTI shape as shapes of their own; another shape as the only one."""
    kind = F.regexp_replace(col(shape)["kind"], "^MULTI", "")
    each = F.transform(col(shape)["parts"], lambda p: F.struct(kind.alias("kind"), F.array(p).alias("parts")))
    return F.when(col(shape)["kind"].startswith("MULTI"), each).otherwise(F.array(col(shape)))


@function
def st_exteriorring(shape):
    """A polygon's outer ring as a closed line."""
    ring = F.get(col(shape)["parts"], F.lit(0))
    return F.when(col(shape)["kind"] == "POLYGON", F.concat(ring, F.slice(ring, 1, 1)))


@function
def st_interiorrings(shape):
    """A polygon's holes as closed lines."""
    holes = F.slice(col(shape)["parts"], 2, F.greatest(F.size(col(shape)["parts"]) - 1, F.lit(1)))
    return F.when(col(shape)["kind"] == "POLYGON", F.transform(holes, lambda r: F.concat(r, F.slice(r, 1, 1))))


@function
def st_isclosed(line):
    """Whether a line ends where it begins."""
    line = col(line)
    return F.when(F.size(line) > 0, F.element_at(line, 1) == F.element_at(line, -1)).otherwise(False)


@function
def st_isring(line):
    """Closed, of three different points at least, and without one that comes twice."""
    line = col(line)
    inner = F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(1)))
    return st_isclosed(line) & (F.size(inner) >= 3) & (F.size(F.array_distinct(inner)) == F.size(inner))


@function
def st_boundary(shape):
    """Of a line its ends, of a polygon its rings as lines; of points nothing."""
    line = F.get(col(shape)["parts"], F.lit(0))
    ends = F.transform(F.array(F.element_at(line, 1), F.element_at(line, -1)), lambda p: F.array(p))
    rings = F.transform(col(shape)["parts"], lambda r: F.concat(r, F.slice(r, 1, 1)))
    kind = col(shape)["kind"]
    return F.when(kind == "LINESTRING", _shape("MULTIPOINT", F.when(st_isclosed(line), F.slice(ends, 1, 0)).otherwise(ends))).when(kind == "POLYGON", _shape("MULTILINESTRING", rings)).otherwise(_shape("MULTIPOINT", F.slice(ends, 1, 0)))


def _cartesian(p: Column) -> Column:
    lng, lat = _rad(p["lng"]), _rad(p["lat"])
    return F.struct((F.cos(lat) * F.cos(lng)).alias("x"), (F.cos(lat) * F.sin(lng)).alias("y"), F.sin(lat).alias("z"))


def _to_point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(F.degrees(F.atan2(y, x)).alias("lng"), F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"))


@function
def st_centroid_of_points(points):
    """The point of the sphere nearest to the mean of points."""
    made = F.transform(col(points), _cartesian)
    total = lambda part: F.aggregate(made, F.lit(0.0), lambda s, v: s + v[part])
    return F.when(F.size(col(points)) > 0, _to_point(total("x"), total("y"), total("z")))


@function
def st_angle(a, b, c):
    """The angle at b, from the line to a to the line to c, clockwise, in radians from 0 to 2 pi; null if one is b."""
    a, b, c = col(a), col(b), col(c)
    turn = F.pmod(st_azimuth(b, c) - st_azimuth(b, a), F.lit(2 * math.pi))
    return F.when((a != b) & (b != c), turn)


@function
def st_maxdistance(a, b):
    """The longest distance between points of two arrays."""
    each = F.transform(col(a), lambda p: F.array_max(F.transform(col(b), lambda q: _angle(p, q))))
    return F.array_max(each) * EARTH


@function
def st_hausdorffdistance(a, b):
    """How far the farthest point of either array is from the nearest one of the other."""
    a, b = col(a), col(b)
    one = lambda x, y: F.array_max(F.transform(x, lambda p: F.array_min(F.transform(y, lambda q: _angle(p, q)))))
    return F.greatest(one(a, b), one(b, a)) * EARTH


@function
def st_hausdorffdwithin(a, b, metres):
    return st_hausdorffdistance(a, b) <= col(metres)


@function
def st_closestpoint(points, p):
    """The nearest of an array's points; of equally near ones the first."""
    best = F.array_min(F.transform(col(points), lambda q, i: F.struct(_angle(q, col(p)).alias("d"), i.alias("i"), q.alias("q"))))
    return best["q"]


def _let(x: Column, make) -> Column:
    """make(x), with x worked out once however often make has it."""
    return F.get(F.transform(F.array(x), make), F.lit(0))


@function
def st_lineinterpolatepoint(line, share):
    """The point at a share of a line's length, along great circles."""
    share = col(share)

    def edges(points: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: _angle(F.element_at(points, i), F.element_at(points, i + 1)))

    def edge(lengths: Column) -> Column:
        """The edge that the wanted length falls into, and what is left of it there."""
        wanted = F.aggregate(lengths, F.lit(0.0), lambda s, v: s + v) * share
        start = F.struct(F.lit(0).alias("i"), wanted.alias("left"), F.lit(False).alias("done"))
        return F.aggregate(lengths, start, lambda s, v: F.when(s["done"], s).when(s["left"] <= v, F.struct((s["i"] + 1).alias("i"), s["left"].alias("left"), F.lit(True).alias("done"))).otherwise(F.struct((s["i"] + 1).alias("i"), (s["left"] - v).alias("left"), F.lit(False).alias("done"))))

    def ends(points: Column, lengths: Column, found: Column) -> Column:
        whole = F.element_at(lengths, found["i"])
        a, b = F.element_at(points, found["i"]), F.element_at(points, F.least(found["i"] + 1, F.size(points)))
        return F.struct(a.alias("point"), _cartesian(a).alias("a"), _cartesian(b).alias("b"), whole.alias("whole"), F.least(found["left"], whole).alias("left"))

    def between(e: Column) -> Column:
        p, q = F.sin(e["whole"] - e["left"]) / F.sin(e["whole"]), F.sin(e["left"]) / F.sin(e["whole"])
        made = _let(F.struct(*((p * e["a"][k] + q * e["b"][k]).alias(k) for k in "xyz")), lambda v: _to_point(v["x"], v["y"], v["z"]))
        return F.when(e["whole"] < 1e-15, e["point"]).otherwise(made)

    made = _let(col(line), lambda points: _let(edges(points), lambda lengths: _let(edge(lengths), lambda found: _let(ends(points, lengths, found), between))))
    return F.when(F.size(col(line)) > 1, made)


@function
def st_asgeojson(shape):
    """Coordinates as Spark writes doubles."""
    pair = lambda p: F.concat(F.lit("["), p["lng"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit("]"))
    lines = F.transform(col(shape)["parts"], lambda part: F.concat(F.lit("["), F.array_join(F.transform(part, pair), ","), F.lit("]")))
    rings = F.transform(col(shape)["parts"], lambda part: F.concat(F.lit("["), F.array_join(F.transform(F.concat(part, F.slice(part, 1, 1)), pair), ","), F.lit("]")))
    points = F.transform(_points_of(shape), pair)
    many = lambda parts: F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    kind = col(shape)["kind"]
    body = F.when(kind == "POINT", F.get(points, F.lit(0))).when(kind == "LINESTRING", F.get(lines, F.lit(0))).when(kind == "MULTIPOINT", many(points)).when(kind == "MULTILINESTRING", many(lines)).when(kind == "POLYGON", many(rings))
    name = F.element_at(F.create_map(*(F.lit(x) for k in ("Point", "LineString", "Polygon") for x in (k.upper(), k))), F.regexp_replace(kind, "^MULTI", ""))
    return F.concat(F.lit('{"type":"'), F.when(kind.startswith("MULTI"), "Multi").otherwise(""), name, F.lit('","coordinates":'), body, F.lit("}"))


@function
def st_geogfromgeojson(text):
    """Points, lines, polygons, multipoints and multilinestrings."""
    text = col(text)
    kind, body = F.upper(F.get_json_object(text, "$.type")), F.get_json_object(text, "$.coordinates")
    point = lambda c: F.struct(F.get(c, F.lit(0)).alias("lng"), F.get(c, F.lit(1)).alias("lat"))
    one, line, lines = (F.from_json(body, k) for k in ("array<double>", "array<array<double>>", "array<array<array<double>>>"))
    parts = (
        F.when(kind == "POINT", F.array(F.array(point(one))))
        .when(kind == "LINESTRING", F.array(F.transform(line, point)))
        .when(kind == "MULTIPOINT", F.transform(line, lambda c: F.array(point(c))))
        .when(kind == "MULTILINESTRING", F.transform(lines, lambda part: F.transform(part, point)))
        .when(kind == "POLYGON", F.transform(lines, lambda part: F.transform(F.slice(part, 1, F.size(part) - 1), point)))
    )
    return F.when(parts.isNotNull(), F.struct(kind.alias("kind"), parts.alias("parts")))


# The digits of geohashes.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def _halvings(x: Column, low: float, high: float, bits: int) -> Column:
    """The number of the cell among 2^bits that a coordinate lies in."""
    return F.least(F.floor((x - low) / (high - low) * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")


# The digits of base 32 as conv writes them.
BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def _spread(x: Column) -> Column:
    """A number's bits at every other place: its binary digits read in base 4."""
    return F.conv(F.bin(x), 4, 10).cast("long")


@function
def st_geohash(p, length: int = 12):
    """The geohash of a point, of up to 12 characters."""
    p, bits = col(p), 5 * length
    lng, lat = _halvings(p["lng"], -180.0, 180.0, (bits + 1) // 2), _halvings(p["lat"], -90.0, 90.0, bits // 2)
    # the first bit is the longitude's
    code = _spread(lng) + _spread(lat) * 2 if bits % 2 else _spread(lng) * 2 + _spread(lat)
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 32), length, "0"), BASE32, GEOHASH)


@function
def st_geogpointfromgeohash(text):
    """The middle of a geohash's cell; what follows 24 characters is below a double's precision."""

    def pairs(part: Column) -> Column:
        """Digits of base 4: a longitude's bit and a latitude's, with a latitude's to spare where bits are odd."""
        n = F.char_length(part)
        bits = F.concat(F.lpad(F.conv(part, 32, 2), n * 5, F.lit("0")), F.repeat(F.lit("0"), n % 2))
        return F.when(n > 0, F.lpad(F.conv(bits, 2, 4), F.ceil(n * 5 / 2).cast("int"), F.lit("0"))).otherwise("")

    # another character counts as the last digit
    digits = F.translate(F.regexp_replace(F.lower(col(text)), "[^0-9b-hjkmnp-z]", "z"), GEOHASH, BASE32)
    found = F.concat(pairs(F.substr(digits, F.lit(1), F.lit(12))), pairs(F.substr(digits, F.lit(13), F.lit(12))))
    lats = F.floor(F.least(F.char_length(digits), F.lit(24)) * 5 / 2).cast("int")
    place = lambda b, low, high: low + (high - low) * (F.conv(b, 2, 10).cast("double") + 0.5) / F.pow(F.lit(2.0), F.char_length(b))
    return F.struct(place(F.translate(found, "0123", "0011"), -180.0, 180.0).alias("lng"), place(F.left(F.translate(found, "0123", "0101"), lats), -90.0, 90.0).alias("lat"))


def _inside(ring: Column, p: Column) -> Column:
    """Whether a ring goes around a point: edges that a great circle from the point to a pole crosses, counted.

    For rings that keep off the poles and don't go around them; an edge's latitude at a longitude is on its great circle.
    """
    nexts = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(1))), F.slice(ring, 1, 1))

    def crosses(a: Column, b: Column) -> Column:
        # longitudes relative to the point, wrapped to +-180
        wrap = lambda x: F.pmod(x + 180, F.lit(360.0)) - 180
        u, v = wrap(a["lng"] - p["lng"]), wrap(b["lng"] - p["lng"])
        spans = ((u <= 0) & (v > 0) | (v <= 0) & (u > 0)) & (F.abs(u - v) < 180)
        ur, vr = F.radians(u), F.radians(v)
        at = F.atan((F.tan(_rad(a["lat"])) * F.sin(vr) - F.tan(_rad(b["lat"])) * F.sin(ur)) / F.sin(vr - ur))
        return F.when(spans & (at > _rad(p["lat"])), 1).otherwise(0)

    count = F.aggregate(F.zip_with(ring, nexts, crosses), F.lit(0), lambda s, v: s + v)
    return count % 2 == 1


@function
def st_contains(polygon, p):
    """Whether a point is inside a polygon and in none of its holes."""
    parts, p = col(polygon)["parts"], col(p)
    holes = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
    return _inside(F.get(parts, F.lit(0)), p) & ~F.exists(holes, lambda h: _inside(h, p))


for _name in ("st_covers", "st_intersects"):
    FUNCTIONS[_name] = st_contains
for _name in ("st_within", "st_coveredby"):
    FUNCTIONS[_name] = lambda p, polygon: st_contains(polygon, p)
FUNCTIONS["st_disjoint"] = lambda polygon, p: ~st_contains(polygon, p)


@function
def st_intersectsbox(p, lng1, lat1, lng2, lat2):
    """Whether a point lies in a box, which may go over the date line."""
    p, a, b = col(p), col(lng1), col(lng2)
    along = F.when(a <= b, (p["lng"] >= a) & (p["lng"] <= b)).otherwise((p["lng"] >= a) | (p["lng"] <= b))
    return along & (p["lat"] >= col(lat1)) & (p["lat"] <= col(lat2))


@function
def st_extent(p):
    """An aggregate: the box of all points."""
    p = col(p)
    return F.struct(F.min(p["lng"]).alias("xmin"), F.min(p["lat"]).alias("ymin"), F.max(p["lng"]).alias("xmax"), F.max(p["lat"]).alias("ymax"))


@function
def st_union_agg_points(p):
    """An aggregate: all different points as one shape; a group's points come together in one row."""
    return _shape("MULTIPOINT", F.transform(F.array_sort(F.collect_set(col(p))), lambda q: F.array(q)))
