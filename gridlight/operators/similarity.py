"""Similar households: who lives near, has the same tariff, and consumes alike."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from gridlight import constants as C
from gridlight.functions import numeric as N
from gridlight.functions.geo import haversine_m
from gridlight.operators import search
from gridlight.operators.skew import dealt, shuffle_tasks
from gridlight.operators.spatial import covering_cells, radius_join, target_cells, top_k
from gridlight.session import cut_lineage


def candidate_profiles(profiles: DataFrame) -> DataFrame:
    """What a pair needs to know about a household, computed once per household and not per pair.

    ``net_by_month`` holds twelve values, null where a month is missing.
    """
    net = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.try_element_at(F.col("monthly_pattern"), m)["net_consumption"])
    return (profiles.where(F.col("months_with_data") >= 6)
            .select("account_id", "CUSTOMER_LAT", "CUSTOMER_LON", "HAS_SOLAR", "CAL_TARIFF", F.col("PHASE").alias("account_phase"),
                    "annual_total", "annual_average", "household_median", net.alias("net_by_month"),
                    (F.least(F.col("months_with_data") / 12.0, F.lit(1.0)) * (12 - F.col("low_months")) / 12.0).alias("data_quality_score")))


def user_vectors(users: DataFrame) -> DataFrame:
    """The users' months as an array of (m, u); expects ``consumption_months`` as a map of month to kWh."""
    months = F.transform(F.map_entries("consumption_months"), lambda e: F.struct(e["key"].alias("m"), e["value"].cast("double").alias("u")))
    return users.select("user_id", "latitude", "longitude", F.col("has_solar").alias("HAS_SOLAR"), F.col("tariff").alias("CAL_TARIFF"),
                        F.col("phase").alias("user_phase"), F.array_sort(months).alias("user_months"),
                        F.coalesce(F.array_max(F.map_keys("consumption_months")), F.lit(12)).alias("last_user_month"))


def magnitude_score(ratio: Column) -> Column:
    out = None
    for lo, hi, score in C.MAGNITUDE_LADDER:
        cond = ratio.between(lo, hi)
        out = F.when(cond, score) if out is None else out.when(cond, score)
    return out.otherwise(0.0)


def household_pairs(users: DataFrame, profiles: DataFrame, radius_m: float = C.SIMILARITY_RADIUS_M) -> DataFrame:
    """Users and households within the radius that share solar flag and tariff."""
    return radius_join(user_vectors(users), candidate_profiles(profiles), radius_m, point_id="user_id", target_id="account_id",
                       target=("CUSTOMER_LAT", "CUSTOMER_LON"), match=["HAS_SOLAR", "CAL_TARIFF"])


# Moments of the months both sides have, as one fold over the user's few months.
_FIELDS = ["n", "su", "sp", "suu", "spp", "sup", "sm", "smm", "smu", "smp"]
_TERMS = ["1.0D", "e.u", "{p}", "e.u * e.u", "{p} * {p}", "e.u * {p}", "e.m", "e.m * e.m", "e.m * e.u", "e.m * {p}"]


def _moments() -> Column:
    p = "get(net_by_month, e.m - 1)"
    zero = ", ".join(f"'{f}', 0.0D" for f in _FIELDS)
    more = ", ".join(f"'{f}', a.{f} + {t.format(p=p)}" for f, t in zip(_FIELDS, _TERMS))
    none = "CAST(NULL AS DOUBLE)"
    start = f"named_struct({zero}, 'ulo', {none}, 'uhi', {none}, 'plo', {none}, 'phi', {none})"
    step = (f"named_struct({more}, 'ulo', least(a.ulo, e.u), 'uhi', greatest(a.uhi, e.u), "
            f"'plo', least(a.plo, {p}), 'phi', greatest(a.phi, {p}))")
    return F.expr(f"aggregate(user_months, {start}, (a, e) -> IF({p} IS NULL, a, {step}))")


def similarity_scores(pairs: DataFrame, radius_m: float = C.SIMILARITY_RADIUS_M, weights: dict = C.SIMILARITY_WEIGHTS) -> DataFrame:
    """Adds the four part scores and the weighted total to every pair.

    Only the user's own months are compared, so nothing later than the last known
    month is looked at.
    """
    if abs(sum(weights.values()) - 1.0) > 1e-5:
        raise ValueError("similarity weights must sum to 1")
    df = pairs.withColumn("_x", _moments())
    df = df.withColumns({
        "_n": F.col("_x.n"),
        "_ratio": F.expr("IF(_x.sp > 0, try_divide(_x.su, _x.sp), 1.0D)"),
        "_corr": F.expr("IF(_x.uhi > _x.ulo AND _x.phi > _x.plo, try_divide(_x.n * _x.sup - _x.su * _x.sp, sqrt(greatest("
                        "(_x.n * _x.suu - _x.su * _x.su) * (_x.n * _x.spp - _x.sp * _x.sp), 0.0D))), NULL)"),
        "_s1": F.expr("try_divide(_x.n * _x.smu - _x.sm * _x.su, _x.n * _x.smm - _x.sm * _x.sm)"),
        "_s2": F.expr("try_divide(_x.n * _x.smp - _x.sm * _x.sp, _x.n * _x.smm - _x.sm * _x.sm)")})
    shape = F.coalesce((F.col("_corr") + 1) / 2, F.lit(0.5))
    pattern = F.when(F.col("_n") < 2, 0.5).otherwise(N.clip(magnitude_score(F.col("_ratio")) * 0.8 + shape * 0.2, 0.0, 1.0))
    span = F.greatest(F.abs(F.col("_s1")), F.abs(F.col("_s2")), F.lit(50.0))
    complete = (F.size("user_months") >= 2) & (F.col("_n") == F.size("user_months"))
    seasonal = F.when(complete, N.clip(1 - F.abs(F.col("_s1") - F.col("_s2")) / span, 0.0, 1.0)).otherwise(0.5)
    # solar flag and tariff are equal on every pair, the join demands it
    technical = 0.4 + 0.3 + F.when(F.col("user_phase") == F.col("account_phase"), 0.2).otherwise(0.0) + 0.1 * F.col("data_quality_score")
    df = df.withColumns({"geographic_score": F.greatest(F.lit(0.0), 1 - F.col("distance_m") / radius_m),
                         "pattern_score": pattern, "technical_score": technical, "seasonal_score": seasonal})
    total = (F.col("geographic_score") * weights["geographic"] + F.col("pattern_score") * weights["consumption_pattern"]
             + F.col("technical_score") * weights["technical"] + F.col("seasonal_score") * weights["seasonal_compatibility"])
    return df.withColumn("score", F.least(F.lit(1.0), total)).drop("_x", "_n", "_ratio", "_corr", "_s1", "_s2")


PAIR_COLUMNS = ["user_id", "account_id", "score", "distance_m", "last_user_month", "household_median", "annual_total", "annual_average",
                "net_by_month"]


def may_enter(pairs: DataFrame, radius_m: float, weights: dict) -> DataFrame:
    """The pairs that may still score as much as ``_kth``, the score to beat (null: none yet).

    Distance and technical score are known, the rest counts at its most but for the magnitude, whose two sums of the twelve
    months (``_own`` are the user's) cost little; users with a month without a value keep every pair.  The sums come from a
    generator, as the filter would otherwise copy them into the join as often as it names them.
    """
    both = [f"get(net_by_month, {i}) IS NULL OR get(_own, {i}) IS NULL" for i in range(12)]
    total = lambda of: " + ".join(f"IF({b}, 0.0D, {of.format(i=i)})" for i, b in enumerate(both))
    sums = F.inline(F.expr(f"array(named_struct('_bn', {total('1.0D')}, '_bu', {total('get(_own, {i})')}, '_bp', {total('get(net_by_month, {i})')}))"))
    ratio = F.expr("IF(_bp > 0, try_divide(_bu, _bp), 1.0D)")
    pattern = F.when(F.col("_bn") < 2, 0.5).otherwise(magnitude_score(ratio) * 0.8 + 0.2)
    technical = 0.7 + F.when(F.col("user_phase") == F.col("account_phase"), 0.2).otherwise(0.0) + 0.1 * F.col("data_quality_score")
    most = (F.greatest(F.lit(0.0), 1 - F.col("distance_m") / radius_m) * weights["geographic"] + pattern * weights["consumption_pattern"]
            + technical * weights["technical"] + weights["seasonal_compatibility"])
    held = pairs.select("*", sums).where(F.col("_kth").isNull() | F.col("_gaps") | F.coalesce(most + 1e-6 >= F.col("_kth"), F.lit(True)))
    return held.drop("_bn", "_bu", "_bp")


# Rows of a group that one task looks at together, and groups for every task, so that large and small ones even out.
USERS_PER_SHARD, HOUSEHOLDS_PER_SHARD, SPREAD = 32_768, 65_536, 4
USER_COLUMNS = ["user_id", "latitude", "longitude", "user_phase", "user_months", "last_user_month"]
HOUSEHOLD_COLUMNS = ["account_id", "CUSTOMER_LAT", "CUSTOMER_LON", "account_phase", "annual_total", "annual_average", "household_median",
                     "net_by_month", "data_quality_score"]
MATCH = ["HAS_SOLAR", "CAL_TARIFF"]


def candidate_pairs(users: DataFrame, households: DataFrame, k: int, min_score: float, radius_m: float, weights: dict) -> DataFrame:
    """Pairs among which are the ``k`` best of every user: users and households of a cell and kind meet in one task, block by
    block (``search.candidates``).  Users sit in one cell each; households, of which there are fewer, go to all that their circle touches."""
    present = lambda df, lat, lon: df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(MATCH[0]).isNotNull() & F.col(MATCH[1]).isNotNull())
    left = target_cells(present(users, "latitude", "longitude"), "latitude", "longitude", radius_m)
    right = covering_cells(present(households, "CUSTOMER_LAT", "CUSTOMER_LON"), "CUSTOMER_LAT", "CUSTOMER_LON", F.lit(float(radius_m)), radius_m)
    kinds = {f.name: f.dataType for f in left.schema.fields}
    right = right.withColumns({c: F.col(c).cast(kinds[c]) for c in MATCH})
    left, right, on = dealt(left, right, ["_cell_y", "_cell_x", *MATCH], "user_id", "account_id",
                            USERS_PER_SHARD, HOUSEHOLDS_PER_SHARD, SPREAD * shuffle_tasks(users))

    def met(u: pa.Table, h: pa.Table) -> pa.Table:
        i, j = search.candidates(u, h, k, min_score, radius_m, weights)
        u, h = u.select(USER_COLUMNS).take(i), h.select(HOUSEHOLD_COLUMNS).take(j)
        return pa.table([*u.columns, *h.columns], names=[*USER_COLUMNS, *HOUSEHOLD_COLUMNS])

    schema = StructType([*[left.schema[c] for c in USER_COLUMNS], *[right.schema[c] for c in HOUSEHOLD_COLUMNS]])
    pairs = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(met, schema)
    distance = haversine_m(*[F.col(c) for c in ("latitude", "longitude", "CUSTOMER_LAT", "CUSTOMER_LON")])
    return pairs.withColumn("distance_m", distance).where(F.col("distance_m") <= radius_m)


def similar_households(users: DataFrame, profiles: DataFrame, k: int = C.TOP_SIMILAR, min_score: float = C.MIN_SIMILARITY,
                       radius_m: float = C.SIMILARITY_RADIUS_M, weights: dict = C.SIMILARITY_WEIGHTS) -> DataFrame:
    """The ``k`` most similar households of every user, partitioned by user for what follows.

    Bounds of blocks leave a small part of the pairs to be looked at (``candidate_pairs``), and only those that may be among
    the best are scored.  Users with a month without a value, and rows with values that are no plain numbers, are rare; their scores
    have no bound, so all their pairs in the radius are scored.

    The score limit is applied after the ranking: the best ``k`` at or above the
    limit are the best ``k`` overall that pass it, and a filter placed before the
    ranking would be pushed into the join with the whole score formula inlined.
    """
    if abs(sum(weights.values()) - 1.0) > 1e-5:
        raise ValueError("similarity weights must sum to 1")
    no_number = lambda x: ~F.coalesce(F.abs(x) < 1e100, F.lit(False))
    odd_user = F.coalesce(F.exists("user_months", lambda e: no_number(e["u"])), F.lit(True))
    odd_household = no_number(F.col("data_quality_score")) | F.exists("net_by_month", lambda x: x.isNotNull() & no_number(x))
    # a small file of many users is one task's, so they are dealt out first
    dealt_users = users.select("user_id", "latitude", "longitude", "has_solar", "tariff", "phase", "consumption_months").repartition(shuffle_tasks(users))
    everyone = cut_lineage(user_vectors(dealt_users).withColumn("_odd", odd_user))
    households = cut_lineage(candidate_profiles(profiles).withColumn("_odd", F.coalesce(odd_household, F.lit(True))))
    odd, plain = lambda df: df.where("_odd").drop("_odd"), lambda df: df.where("NOT _odd").drop("_odd")
    found = candidate_pairs(plain(everyone), plain(households), k, min_score, radius_m, weights)
    if odd(everyone).isEmpty() and odd(households).isEmpty():
        rest = found.sparkSession.createDataFrame([], found.schema)
    else:
        whole = lambda u, h: radius_join(u, h, radius_m, point_id="user_id", target_id="account_id", target=("CUSTOMER_LAT", "CUSTOMER_LON"), match=MATCH)
        rest = whole(odd(everyone), households.drop("_odd")).unionByName(whole(plain(everyone), odd(households)))
        own = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.get(F.filter("user_months", lambda e: e["m"] == m), 0)["u"])
        rest = may_enter(rest.withColumns({"_own": own, "_gaps": F.lit(False), "_kth": F.lit(None).cast("double")}), radius_m, weights)
    scored = [similarity_scores(pairs, radius_m, weights).select(*PAIR_COLUMNS) for pairs in (found, rest)]
    best = top_k(scored[0].unionByName(scored[1]), ["user_id"], [F.round("score", 9).desc(), F.col("account_id")], k)
    return best.where(F.col("score") >= min_score)
