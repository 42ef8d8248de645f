"""Distance joins: a grid turns "within r metres" into an equi-join plus an exact test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlight.functions.geo import METRES_PER_DEGREE, haversine_m
from gridlight.operators.skew import skew_join

# The cover is widened by one percent so that it also holds for ellipsoidal
# distances, which differ from spherical ones by up to 0.6 %.
COVER_MARGIN = 1.01
# Rows of a cell that meet in one task: each shard more on one side is a copy of the other side that is sent and stored.
ROWS_PER_SHARD = 65_536


def _steps(max_radius_m: float) -> tuple[float, float, int]:
    lat_step = COVER_MARGIN * max_radius_m / METRES_PER_DEGREE
    lon_cells = max(1, math.floor(360.0 / lat_step))
    return lat_step, 360.0 / lon_cells, lon_cells


def target_cells(df: DataFrame, lat: str, lon: str, max_radius_m: float) -> DataFrame:
    """Each target sits in exactly one cell."""
    lat_step, lon_step, lon_cells = _steps(max_radius_m)
    return (df.withColumn("_cell_y", F.floor(F.col(lat) / lat_step))
            .withColumn("_cell_x", F.pmod(F.floor((F.col(lon) + 180.0) / lon_step), F.lit(lon_cells))))


def cover_degrees(lat: Column, radius_m: Column) -> tuple[Column, Column]:
    """Degrees of latitude and longitude that a circle reaches to either side, with the cover's margin."""
    dlat = COVER_MARGIN * radius_m / METRES_PER_DEGREE
    return dlat, dlat / F.cos(F.radians(F.least(F.abs(lat) + dlat, F.lit(89.9))))


def covering_cells(df: DataFrame, lat: str, lon: str, radius_m: Column, max_radius_m: float) -> DataFrame:
    """Each point is copied to the (normally nine or fewer) cells its circle touches."""
    lat_step, lon_step, lon_cells = _steps(max_radius_m)
    dlat, dlon = cover_degrees(F.col(lat), radius_m)
    y0, y1 = F.floor((F.col(lat) - dlat) / lat_step), F.floor((F.col(lat) + dlat) / lat_step)
    x0 = F.floor((F.col(lon) - dlon + 180.0) / lon_step)
    x1 = F.least(F.floor((F.col(lon) + dlon + 180.0) / lon_step), x0 + (lon_cells - 1))
    return (df.withColumn("_cell_y", F.explode(F.sequence(y0, y1)))
            .withColumn("_x", F.explode(F.sequence(x0, x1)))
            .withColumn("_cell_x", F.pmod(F.col("_x"), F.lit(lon_cells))).drop("_x"))


def radius_join(points: DataFrame, targets: DataFrame, radius: float | str, *, point_id: str, target_id: str,
                point: tuple[str, str] = ("latitude", "longitude"),
                target: tuple[str, str] = ("TRANSFORMER_LAT", "TRANSFORMER_LON"),
                max_radius_m: float | None = None, distance=haversine_m,
                distance_col: str = "distance_m", match: list[str] | None = None) -> DataFrame:
    """All (point, target) pairs no farther apart than ``radius``.

    ``radius`` is a number of metres or the name of a column of ``points``; then
    ``max_radius_m`` sets the cell size.  Larger per-row radii are still exact,
    they only touch more cells.  ``match`` lists columns that must be equal on both
    sides; they join the key, so unequal pairs are never made.  Crowded cells are
    split on both sides (see ``skew_join``).  With one radius for all, points stay in one cell of half the radius and the targets, mostly
    the fewer rows, are copied to the cells their circles touch; with a radius per row it is the points that are copied.

    Pairs outside the box around the circle are never measured.  A ``distance`` other than the great circle costs far
    more than a row, so it is worked out once a pair, and only for pairs whose great circle is within the cover.
    """
    radius_col = F.col(radius) if isinstance(radius, str) else F.lit(float(radius))
    cell = max_radius_m if max_radius_m is not None else float(radius)
    keys, own = ["_cell_y", "_cell_x", *(match or [])], ["_cell_y", "_cell_x", "_dlat", "_dlon"]
    plat, plon, tlat, tlon = (F.col(c) for c in (*point, *target))
    dlat, dlon = cover_degrees(plat, radius_col)
    left, right, rows = points.withColumns({"_dlat": dlat, "_dlon": dlon}), targets, {}
    if isinstance(radius, str):
        left, right = covering_cells(left, *point, radius_col, cell), target_cells(right, *target, cell)
    else:    # one radius for all: a target is within a point's circle if the point is within the target's
        left, right, rows = target_cells(left, *point, cell / 2), covering_cells(right, *target, radius_col, cell / 2), {"rows_per_shard": ROWS_PER_SHARD}
    pairs = skew_join(left, right, keys, point_id, target_id, **rows)
    east = F.pmod(tlon - plon + 180.0, F.lit(360.0)) - 180.0
    pairs = pairs.where((F.abs(tlat - plat) <= F.col("_dlat")) & (F.abs(east) <= F.col("_dlon")))
    d = distance(plat, plon, tlat, tlon)
    if distance is haversine_m:
        return pairs.drop(*own).withColumn(distance_col, d).where(F.col(distance_col) <= radius_col)
    near = pairs.where(haversine_m(plat, plon, tlat, tlon) <= COVER_MARGIN * radius_col).drop(*own)
    # a generator is not copied into the filter, as a projected column would be
    return near.withColumn(distance_col, F.explode(F.filter(F.array(d), lambda x: x <= radius_col)))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; the order must end in a unique key.

    Spark prunes to ``k`` rows per group before the shuffle (window group limit),
    so a crowded group never travels whole.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
