"""Distances and boxes on the earth as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from gridlight.constants import BOUNDS, EARTH_RADIUS_M, URBAN_BOX, WGS84_A, WGS84_F

METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


WGS84_B = WGS84_A * (1 - WGS84_F)
# Steps of the two folds: the usual iteration gains two digits a step or more, the other one halves an angle.
INVERSE_STEPS, HALVINGS = 10, 60
NEARLY_OPPOSITE = 3.05


def _let(make, **values: Column) -> Column:
    """``make`` of the values, each worked out once."""
    one = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(one, lambda s: make(*[s[k] for k in values])), 0)


def _series_c(cos2: Column) -> Column:
    return WGS84_F / 16 * cos2 * (4 + WGS84_F * (4 - 3 * cos2))


def _arc_m(sigma: Column, sin_s: Column, cos_s: Column, cos2: Column, cos_mid: Column) -> Column:
    """Metres of an arc of the auxiliary sphere; cos2 is that of the azimuth at the equator, squared, cos_mid that of twice the middle."""
    u = cos2 * ((WGS84_A ** 2 - WGS84_B ** 2) / WGS84_B ** 2)
    big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    mid2 = cos_mid * cos_mid
    off = big_b * sin_s * (cos_mid + big_b / 4 * (cos_s * (2 * mid2 - 1) - big_b / 6 * cos_mid * (4 * sin_s * sin_s - 3) * (4 * mid2 - 3)))
    return WGS84_B * big_a * (sigma - off)


def _iterated(u1: Column, u2: Column, longitude: Column) -> Column:
    """Vincenty's inverse solution: the longitude on the auxiliary sphere by a fold of fixed length."""
    def at(lam):
        x, y = F.cos(u2) * F.sin(lam), F.cos(u1) * F.sin(u2) - F.sin(u1) * F.cos(u2) * F.cos(lam)
        sin_s, cos_s = F.sqrt(x * x + y * y), F.sin(u1) * F.sin(u2) + F.cos(u1) * F.cos(u2) * F.cos(lam)
        sin_a = F.coalesce(F.try_divide(F.cos(u1) * F.cos(u2) * F.sin(lam), sin_s), F.lit(0.0))
        cos2 = 1 - sin_a * sin_a
        # on the equator there is no middle
        mid = F.when(cos2 > 1e-15, cos_s - F.try_divide(2 * F.sin(u1) * F.sin(u2), cos2)).otherwise(0.0)
        return sin_s, cos_s, sin_a, cos2, mid

    def step(lam, _):
        def new(sin_s, cos_s, sin_a, cos2, mid):
            c = _series_c(cos2)
            sigma = F.atan2(sin_s, cos_s)
            return longitude + (1 - c) * WGS84_F * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid * mid - 1)))
        return _let(new, **dict(zip(("sin_s", "cos_s", "sin_a", "cos2", "mid"), at(lam))))

    lam = F.aggregate(F.sequence(F.lit(1), F.lit(INVERSE_STEPS)), longitude, step)
    length = lambda sin_s, cos_s, sin_a, cos2, mid: _arc_m(F.atan2(sin_s, cos_s), sin_s, cos_s, cos2, mid)
    return _let(lambda x: _let(length, **dict(zip(("sin_s", "cos_s", "sin_a", "cos2", "mid"), at(x)))), x=lam)


def _halved(u1: Column, u2: Column, longitude: Column) -> Column:
    """The geodesic of nearly opposite points, where the iteration does not converge: the azimuth at the first point is halved in on,
    as the longitude reached grows with it if that point is the one farther from the equator and south of it."""
    swap = F.abs(u1) < F.abs(u2)
    far, near = F.when(swap, u2).otherwise(u1), F.when(swap, u1).otherwise(u2)
    near = F.when(far > 0, -near).otherwise(near)
    far = F.least(-F.abs(far), F.lit(-1e-15))

    def along(azimuth, b1, b2):
        """(sigma of both points, sine of the azimuth at the equator) of the geodesic that leaves the first one so."""
        sin_0 = F.sin(azimuth) * F.cos(b1)
        away = F.sqrt(F.greatest(F.pow(F.cos(azimuth) * F.cos(b1), F.lit(2.0)) + (F.cos(b2) * F.cos(b2) - F.cos(b1) * F.cos(b1)), F.lit(0.0)))
        return F.atan2(F.sin(b1), F.cos(azimuth) * F.cos(b1)), F.atan2(F.sin(b2), away), sin_0

    def reached(s1, s2, sin_0):
        cos2 = 1 - sin_0 * sin_0
        c, sigma, mid = _series_c(cos2), s2 - s1, F.cos(s1 + s2)
        turn = F.atan2(sin_0 * F.sin(s2), F.cos(s2)) - F.atan2(sin_0 * F.sin(s1), F.cos(s1))
        return turn - (1 - c) * WGS84_F * sin_0 * (sigma + c * F.sin(sigma) * (mid + c * F.cos(sigma) * (2 * mid * mid - 1)))

    def length(s1, s2, sin_0):
        return _arc_m(s2 - s1, F.sin(s2 - s1), F.cos(s2 - s1), 1 - sin_0 * sin_0, F.cos(s1 + s2))

    def solve(b1, b2, lon):
        def step(s, _):
            middle = (s["lo"] + s["hi"]) / 2
            short = _let(lambda m: _let(reached, **dict(zip(("s1", "s2", "sin_0"), along(m, b1, b2)))), m=middle) < lon
            return F.struct(F.when(short, middle).otherwise(s["lo"]).alias("lo"), F.when(short, s["hi"]).otherwise(middle).alias("hi"))
        bounds = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(0.0).alias("lo"), F.lit(math.pi).alias("hi")), step, lambda s: (s["lo"] + s["hi"]) / 2)
        return _let(lambda m: _let(length, **dict(zip(("s1", "s2", "sin_0"), along(m, b1, b2)))), m=bounds)
    return _let(solve, b1=far, b2=near, lon=longitude)


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Length of the geodesic on the WGS84 ellipsoid, in metres, to a fraction of a millimetre for any two points; folds of fixed
    length, no UDF.  Points that are nearly opposite each other are solved for the azimuth instead."""
    reduced = lambda lat: F.atan2((1 - WGS84_F) * F.sin(F.radians(lat)), F.cos(F.radians(lat)))
    turned = F.pmod(F.abs(F.radians(lon2 - lon1)), F.lit(2 * math.pi))
    longitude = F.least(turned, 2 * math.pi - turned)

    def solve(u1, u2, lon):
        x, y = F.cos(u2) * F.sin(lon), F.cos(u1) * F.sin(u2) - F.sin(u1) * F.cos(u2) * F.cos(lon)
        angle = F.atan2(F.sqrt(x * x + y * y), F.sin(u1) * F.sin(u2) + F.cos(u1) * F.cos(u2) * F.cos(lon))
        return F.when(angle > NEARLY_OPPOSITE, _halved(u1, u2, lon)).when((u1 == u2) & (lon == 0), 0.0).otherwise(_iterated(u1, u2, lon))
    return _let(solve, u1=reduced(lat1), u2=reduced(lat2), lon=longitude)


def bounding_box(lat: Column, lon: Column, radius_m: Column) -> dict[str, Column]:
    """Box that holds every point within ``radius_m``."""
    dlat = radius_m / METRES_PER_DEGREE
    dlon = dlat / F.cos(F.radians(F.least(F.abs(lat) + dlat, F.lit(89.9))))
    return {"lat_min": lat - dlat, "lat_max": lat + dlat, "lon_min": lon - dlon, "lon_max": lon + dlon}


def in_bounds(lat: Column, lon: Column, box: dict = BOUNDS) -> Column:
    return lat.between(box["lat_min"], box["lat_max"]) & lon.between(box["lon_min"], box["lon_max"])


def is_urban(lat: Column, lon: Column, box: dict = URBAN_BOX) -> Column:
    return ((lat > box["lat_min"]) & (lat < box["lat_max"])
            & (lon > box["lon_min"]) & (lon < box["lon_max"]))
