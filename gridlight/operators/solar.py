"""Weather joins, solar features, nearest weather months and generation forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gridlight import constants as C
from gridlight.functions import calendar as CAL, numeric as N, solar as S
from gridlight.operators.skew import skew_join
from gridlight.operators.spatial import top_k
from gridlight.session import cut_lineage


def join_weather(readings: DataFrame, weather: DataFrame) -> DataFrame:
    """Readings with the weather of their site, year and month (one weather row per key)."""
    w = weather.withColumnsRenamed({"Year": "YEAR", "Month": "MONTH"})
    return readings.join(w, ["SITE_ID", "YEAR", "MONTH"], "left")


def solar_features(df: DataFrame, month: str = "MONTH") -> DataFrame:
    """Temperature, cloud, calendar and system features and, where exports are known, the target."""
    m, ghi = F.col(month), F.col("Solar_Irradiance_GHI")
    sin, cos = CAL.encode_cyclic(m, 12)
    df = df.withColumns({"Temp_Efficiency": S.temp_efficiency(F.col("Temperature")),
                         "Temp_Range": F.round(F.col("Max_Temperature") - F.col("Min_Temperature"), 2),
                         "Cloud_Factor": S.cloud_factor(ghi, F.col("Clear_Sky_GHI")),
                         "Month_Sin": F.round(sin, 4), "Month_Cos": F.round(cos, 4), "Days_In_Month": CAL.days_in_month(m)})
    per_kw = S.physics_yield(ghi, F.col("Days_In_Month"))
    out = {"GHI_Adjusted": F.round(ghi * F.col("Temp_Efficiency") + 1e-7, 2),
           "Expected_Generation": F.round(per_kw * F.col("INV_CAPACITY") + 1e-7, 2), "Physics_Pred": F.round(per_kw + 1e-7, 2)}
    if "EXPORT_kWh" in df.columns:
        out["Efficiency"] = F.round(F.try_divide(F.col("EXPORT_kWh"), F.nullif(F.col("INV_CAPACITY"), F.lit(0.0))) + 1e-7, 4)
    return df.withColumns(out)


def merge_forecast(months: DataFrame, forecast: DataFrame, climatology: DataFrame) -> DataFrame:
    """Cell by cell the seasonal forecast, else the climatology, with the provenance of the row.

    ``months`` has (SITE_ID, Year, Month); ``forecast`` is keyed by all three, ``climatology`` by site and month.
    """
    cells = ["Solar_Irradiance_GHI", "Temperature", "Max_Temperature", "Min_Temperature", "Humidity", "Precipitation", "Wind_Speed"]
    f = forecast.select("SITE_ID", "Year", "Month", *[F.col(c).alias(f"f_{c}") for c in cells])
    c = climatology.select("SITE_ID", "Month", "Clear_Sky_GHI", *[F.col(x).alias(f"c_{x}") for x in cells])
    df = months.join(f, ["SITE_ID", "Year", "Month"], "left").join(c, ["SITE_ID", "Month"], "left")
    n = reduce(lambda a, b: a + b, [F.col(f"f_{x}").isNotNull().cast("int") for x in cells])
    df = df.withColumns({x: F.coalesce(f"f_{x}", f"c_{x}") for x in cells}).withColumn(
        "data_source", F.when(n == len(cells), "C3S").when(n == 0, "NASA_TMY").otherwise("HYBRID"))
    t = F.col("Temperature")
    df = df.withColumns({"Max_Temperature": F.coalesce("Max_Temperature", t + 3.0), "Min_Temperature": F.coalesce("Min_Temperature", t - 3.0),
                         "Humidity": F.coalesce("Humidity", F.lit(C.HUMIDITY_DEFAULT))})
    return df.select("SITE_ID", "Year", "Month", *cells, "Clear_Sky_GHI", "data_source")


def climatology(history: DataFrame) -> DataFrame:
    """Typical year: mean of every month and site."""
    cols = [c for c in C.WEATHER_PARAMETERS.values() if c in history.columns]
    return history.groupBy("SITE_ID", "Month").agg(*[F.avg(c).alias(c) for c in cols])


def weather_statistics(weather: DataFrame, params: list[str]) -> DataFrame:
    """Mean, spread and range of each parameter and site, heat index included."""
    df = weather.withColumn("heat_index", S.heat_index(F.col("Temperature"), F.col("Humidity")))
    items = F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).cast("double").alias("x")) for p in [*params, "heat_index"]])
    rows = df.select("SITE_ID", F.explode(items).alias("e")).select("SITE_ID", "e.parameter", "e.x").where("x IS NOT NULL")
    return rows.groupBy("SITE_ID", "parameter").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


def convert_units(df: DataFrame) -> DataFrame:
    """Model-output units (kelvin, W/m2, metres) to the units of the weather table."""
    t, d = S.kelvin_to_celsius(F.col("t2m_k")), F.col("d2m_k") - 273.15
    df = df.withColumn("Temperature", t)
    return df.withColumns({"Humidity": S.relative_humidity(d, F.col("Temperature")), "Solar_Irradiance_GHI": S.irradiance_kwh_per_day(F.col("ssrd_w")),
                           "Precipitation": S.rain_mm_per_day(F.col("tp_m"), CAL.days_in_month(F.col("Month"))), "Wind_Speed": S.wind_speed(F.col("u10"), F.col("v10"))})


HALVINGS, POINTS_A_CELL = 10, 8


def first_step(points: DataFrame, widest: float) -> float:
    """The widest of ``widest``, half of it, a quarter ... whose cells hold few points: ``POINTS_A_CELL`` seen from the average
    point, or twice what the narrowest cells still hold where points lie upon each other.  Counted in one pass."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col("g_lat") / (widest / 2 ** i)).alias("y"), F.floor(F.col("g_lon") / (widest / 2 ** i)).alias("x")) for i in range(HALVINGS + 1)])
    counts = points.select(F.inline(cells)).groupBy("i", "y", "x").agg(F.count(F.lit(1)).cast("double").alias("n"))
    crowd = {r.i: r.crowd for r in counts.groupBy("i").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd")).collect()}    # a row a width
    few = max(POINTS_A_CELL, 2 * crowd.get(HALVINGS, 0.0))
    return widest / 2 ** next((i for i in range(HALVINGS) if crowd.get(i, 0.0) <= few), HALVINGS)


def nearest_cell(sites: DataFrame, grid: DataFrame, keys: list[str], values: list[str], step_deg: float) -> DataFrame:
    """Value of the nearest grid point of every site, however far it is.

    Sites and points meet on cells (nine per site); a point found within one cell's width is the nearest.  The sites
    without one go on to cells of twice the width, so only sites far from the grid are compared with more of it.
    ``step_deg`` is the widest first cell; on a denser grid the first cells are narrower (``first_step``).
    """
    d = (F.col("lat") - F.col("g_lat")) * (F.col("lat") - F.col("g_lat")) + (F.col("lon") - F.col("g_lon")) * (F.col("lon") - F.col("g_lon"))
    order, found, left = F.struct(F.round(d, 12), "g_lat", "g_lon"), [], sites
    points = grid.where("lat IS NOT NULL AND lon IS NOT NULL").select(*values, F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"))
    step = first_step(points, step_deg)
    while True:
        y, x = F.floor(F.col("lat") / step), F.floor(F.col("lon") / step)
        s = left.withColumn("_y", F.explode(F.sequence(y - 1, y + 1))).withColumn("_x", F.explode(F.sequence(x - 1, x + 1)))
        g = points.withColumns({"_y": F.floor(F.col("g_lat") / step), "_x": F.floor(F.col("g_lon") / step)})
        best = s.join(g, ["_y", "_x"]).groupBy(*keys).agg(F.min(d).alias("_d"), *[F.min_by(v, order).alias(v) for v in values])
        near = best if step > 720 else best.where(F.col("_d") <= step * step - 1e-12)
        found.append(near.select(*keys, *values))
        if step > 720 or (left := cut_lineage(left.join(near.select(*keys), keys, "left_anti"))).isEmpty():
            return reduce(DataFrame.unionByName, found)
        step *= 2


# ---- nearest neighbours ------------------------------------------------------------

def scaler(train: DataFrame, features: list[str]) -> Column:
    """Mean and population deviation of the features as one struct (a scalar subquery)."""
    aggs = [x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]
    return train.agg(F.struct(*aggs)).scalar()


def _scaled(df: DataFrame, stats: Column, features: list[str]) -> DataFrame:
    df = df.withColumn("_s", stats)
    return df.withColumns({f"_z{i}": (F.col(f) - F.col(f"_s.m_{f}")) / F.when(F.col(f"_s.s_{f}") > 0, F.col(f"_s.s_{f}")).otherwise(1.0)
                           for i, f in enumerate(features)}).drop("_s")


MOST_PIVOTS = 1024


def _unit(df: DataFrame, z: list[str]) -> DataFrame:
    """Vectors of length one; a vector of length zero has no direction and goes."""
    df = df.withColumn("_length", F.sqrt(reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in z]))).where(F.col("_length") > 0)
    return df.withColumns({c: F.col(c) / F.col("_length") for c in z}).drop("_length")


def _apart(p: Column, z: list[str]) -> Column:
    """Distance of the row's vector and the array ``p``."""
    return F.sqrt(reduce(lambda a, b: a + b, [(F.col(c) - p[i]) * (F.col(c) - p[i]) for i, c in enumerate(z)]))


def metric_cells(reps: DataFrame, z: list[str], most: int = MOST_PIVOTS) -> tuple[DataFrame, Column]:
    """``reps`` with the nearest pivot (``_cell``) and the distance to it (``_dp``), and an array of all cells: pivot, its
    number, rows and radius.

    There are about as many pivots as rows in a cell, ``most`` at most: vectors in the order of their hash, the only
    thing that goes through the driver."""
    wanted = max(1, min(most, round(reps.count() ** 0.5)))
    chosen = reps.select(*z).distinct().orderBy(F.xxhash64(*z), *z).limit(wanted).collect()
    schema = "id int, p array<double>"
    pivots = reps.sparkSession.createDataFrame([(i, list(r)) for i, r in enumerate(chosen)], schema)
    listed = pivots.agg(F.sort_array(F.collect_list(F.struct("id", "p"))).alias("a")).scalar()
    near = F.array_min(F.transform("_pivots", lambda c: F.struct(_apart(c["p"], z).alias("d"), c["id"].alias("id"))))
    placed = reps.withColumn("_pivots", listed).withColumn("_near", near)
    placed = cut_lineage(placed.withColumns({"_cell": F.col("_near.id"), "_dp": F.col("_near.d")}).drop("_pivots", "_near"))
    sizes = placed.groupBy(F.col("_cell").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("_dp").alias("radius"))
    cells = sizes.join(pivots, "id").agg(F.sort_array(F.collect_list(F.struct("id", "p", "n", "radius"))).alias("a")).scalar()
    return placed, cells


def nearest_rows(queries: DataFrame, train: DataFrame, features: list[str], target: str, tie: list[str], k: int = 3, metric: str = "euclidean",
                 pivots: int = MOST_PIVOTS) -> DataFrame:
    """The ``k`` nearest training rows of every distinct query vector, ties by the ``tie`` columns; ``metric`` is euclidean
    distance of the standardised features or 1 - cosine of their vectors (those of length zero take no part).

    Rows of one site share their month's weather, so both sides are first reduced
    to distinct vectors; of the training rows behind a vector only the first ``k``
    by the tie key can matter.  They are dealt to the cells of pivots.  A query first looks into the nearest cells
    that hold ``k`` rows, which tells how far it has to look, and then into the cells that reach so near: by the
    triangle inequality no other row can be closer, nor can one whose distance to the pivot differs from the
    query's by more than that.  So the answer is exact in two rounds whatever the vectors look like; cells that hold many rows
    are split on both sides.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    cosine = metric == "cosine"
    stats = scaler(train, features)
    z = [f"_z{i}" for i in range(len(features))]
    t = _scaled(train.dropna(subset=[*features, target]), stats, features)
    q = _scaled(queries.dropna(subset=features).select(*features).distinct(), stats, features)
    if cosine:
        t, q = _unit(t, z), _unit(q, z)
    reps = cut_lineage(top_k(t.select(*z, target, *tie), z, [F.col(c) for c in tie], k, "_rep").drop("_rep"))
    placed, cells = metric_cells(reps, z, pivots)
    placed = placed.select("_cell", "_dp", *[F.col(c).alias(f"t{c}") for c in z], target, *tie, F.xxhash64(*tie).alias("_t"))
    order = F.sort_array(F.transform("_cells", lambda c: F.struct(_apart(c["p"], z).alias("d"), c["id"].alias("id"), c["n"].alias("n"), c["radius"].alias("radius"))))
    q = cut_lineage(q.withColumn("_cells", cells).withColumn("_cells", order).withColumn("_q", F.xxhash64(*features)))
    chord = F.sqrt(reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"t{c}")) * (F.col(c) - F.col(f"t{c}")) for c in z]))

    def met(asked: DataFrame) -> DataFrame:
        """Pairs of the queries with the rows of their cells, as far apart as ``_reach`` at most."""
        pairs = skew_join(asked.select(*features, *z, "_q", "_reach", F.inline("_look")).withColumnRenamed("id", "_cell"), placed, ["_cell"], "_q", "_t")
        pairs = pairs.where(F.col("_reach").isNull() | (F.abs(F.col("d") - F.col("_dp")) <= F.col("_reach")))
        pairs = pairs.withColumn("_chord", chord).where(F.col("_reach").isNull() | (F.col("_chord") <= F.col("_reach")))
        distance = F.col("_chord") * F.col("_chord") / 2 if cosine else F.col("_chord")
        return pairs.select(*features, distance.alias("distance"), target, *tie)

    ranked = lambda pairs: top_k(pairs, features, [F.round("distance", 9), *[F.col(c) for c in tie]], k)
    # the nearest cells up to the one with which they hold k rows
    start = (f"filter(_cells, (c, i) -> aggregate(slice(_cells, 1, i), 0L, (n, x) -> n + x.n) < {k})")
    first = cut_lineage(ranked(met(q.withColumn("_reach", F.lit(None).cast("double")).withColumn("_look", F.expr(start)))))
    # a little farther than the k-th, as distances are compared to nine digits
    far = F.max(F.when(F.col("rank") == k, F.sqrt(2 * F.col("distance") + 2.1e-9) if cosine else F.col("distance") + 1.1e-9)).alias("_reach")
    reach = first.groupBy(*features).agg(far)
    rest = F.filter("_cells", lambda c: F.col("_reach").isNull() | (c["d"] - c["radius"] <= F.col("_reach") + 1e-12))
    left = F.array_except(rest, F.expr(start))
    second = q.join(reach, features).withColumn("_look", left).where(F.size("_look") > 0)
    return ranked(first.drop("rank").unionByName(met(second)))


def knn_predict(queries: DataFrame, neighbours: DataFrame, features: list[str], target: str) -> DataFrame:
    """Mean target of the neighbours on every query row."""
    means = neighbours.groupBy(*features).agg(F.avg(target).alias(f"predicted_{target}"))
    return queries.join(means, features, "left")


def knn_details(neighbours: DataFrame, features: list[str], target: str, k: int = 3) -> DataFrame:
    """One row per query vector with distance and target of every rank side by side."""
    wide = neighbours.groupBy(*features).pivot("rank", list(range(1, k + 1))).agg(F.max("distance").alias("distance"), F.max(target).alias(target))
    return wide.withColumnsRenamed({f"{i}_{c}": f"match_{i}_{c}" for i in range(1, k + 1) for c in ("distance", target)})


# ---- forecasts -----------------------------------------------------------------------

def generation_forecast(systems: DataFrame, months: DataFrame, on: list[str], efficiency: str = "Efficiency", tariff: float = C.NET_PLUS_TARIFF) -> DataFrame:
    """Generation table of every system over the months of its site."""
    df = systems.join(months, on)
    band = S.generation_band(F.col(efficiency), F.col("size_kw"), tariff)
    return df.withColumns(band)


def annual_generation(forecast: DataFrame, by: list[str]) -> DataFrame:
    return forecast.groupBy(*by).agg(F.sum("Predicted_Export_kWh").alias("annual_kwh"), F.sum("Estimated_Income_LKR").alias("annual_income_lkr"),
                                     F.avg("Confidence_Pct").alias("mean_confidence"))


def model_comparison(df: DataFrame, models: list[str], actual: str = "Efficiency", month: str = "MONTH", band: float = C.MAE_KWH_PER_KW) -> DataFrame:
    """Month means of actual and predicted yields times the mean capacity, with the income band."""
    out = df.groupBy(month).agg(F.avg("INV_CAPACITY").alias("mean_kw"), *[F.avg(c).alias(c) for c in [actual, *models]])
    kw = F.col("mean_kw")
    out = out.withColumns({f"{c}_kwh": F.col(c) * kw for c in [actual, *models]})
    best = F.col(f"{models[0]}_kwh")
    return out.select(month, "mean_kw", *[f"{c}_kwh" for c in [actual, *models]], (best * C.NET_PLUS_TARIFF).alias("income_lkr"),
                      (F.greatest(best - band * kw, F.lit(0.0)) * C.NET_PLUS_TARIFF).alias("income_low_lkr"), ((best + band * kw) * C.NET_PLUS_TARIFF).alias("income_high_lkr"))
