import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import geography as G


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("v")).first()["v"]


def point(lng, lat):
    return G.st_geogpoint(F.lit(lng), F.lit(lat))


def test_points(value):
    assert value(G.st_distance(point(0, 0), point(90, 0))) == pytest.approx(math.pi / 2 * G.EARTH)
    assert value(point(190.0, 10.0)).lng == -170
    assert value(G.st_azimuth(point(0, 0), point(1, 0))) == pytest.approx(math.pi / 2)
    assert value(G.st_azimuth(point(0, 0), point(0, 0))) is None
    assert value(G.st_geogfromtext(F.lit("nonsense"))) is None
    assert value(G.st_geogfromtext(F.lit("point(1.5 -2)"))).lat == -2
    with pytest.raises(Exception, match="latitude"):
        value(point(0, 91))


def test_shapes(value):
    octant = G.st_makeline(point(0, 0), point(90, 0), point(0, 90))
    assert value(G.st_area(octant)) == pytest.approx(4 * math.pi * G.EARTH**2 / 8)
    assert value(G.st_perimeter(octant)) == pytest.approx(1.5 * math.pi * G.EARTH)
    small = G.st_makeline(point(0, 0), point(0.01, 0), point(0.01, 0.01), point(0, 0.01))
    assert value(G.st_area(small)) == pytest.approx((math.radians(0.01) * G.EARTH) ** 2, rel=1e-5)
    assert value(G.st_endpoint(octant)).lat == 90 and value(G.st_pointn(octant, 2)).lng == 90 and value(G.st_pointn(octant, 9)) is None
