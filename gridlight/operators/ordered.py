"""Exact order statistics without bringing a whole group, or all its values, into one task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer, and a
window over a whole group sorts it in one task.  Both are fine for a household's
months, neither is for "all readings of April".  Here a double becomes a whole
number of the same order, and its leading bits a prefix.  The first pass counts
rows per group and prefix, which the map side folds to a few hundred rows.  The
counts tell in which prefix a rank lies, so the second pass sends only the rows
of those prefixes on, folded to (value, count), and they are placed by their next
bits before they are put in order.  Values packed closely together (a million coordinates
in a hundredth of a degree) therefore still end up in small groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlight.session import cut_lineage

# Bits below the prefixes of the two passes: sign, exponent and 8 bits of the fraction, then 16 more of these.
FIRST, SECOND = 44, 28
BROADCAST_ROWS = 100_000


def with_order_key(df: DataFrame, value: str, name: str = "_key") -> DataFrame:
    """Adds a whole number that grows as the double ``value`` does: for positive numbers the exponent, then the 52 bits of the fraction.

    Zeros of both signs are 0, infinities lie beyond all numbers, and NaN is the largest, as in Spark's own order.  The
    steps are columns of their own, as in one expression each use of a step would work it out again."""
    fraction = lambda x: (x * float(1 << 52)).try_cast("bigint")
    v, a, e, power, least = F.col(value), F.col("_a"), F.col("_e"), F.col("_power"), 2.0 ** -1022
    steps = df.withColumn("_a", F.abs(v)).withColumn("_e", F.least(F.greatest(F.floor(F.log2("_a")).cast("double"), F.lit(-1022.0)), F.lit(1023.0))).withColumn("_power", F.pow(F.lit(2.0), "_e"))
    # the logarithm may be off by one next to a power of two
    steps = steps.withColumn("_off", F.when(power > a, -1.0).when(power * 2 <= a, 1.0).otherwise(0.0))
    whole = a / power / F.when(F.col("_off") == 1, 2.0).when(F.col("_off") == -1, 0.5).otherwise(1.0)
    normal = (e + F.col("_off") + 1023).cast("bigint") * F.lit(1 << 52) + fraction(whole - 1)
    steps = steps.withColumn("_size", F.when(a < least, fraction(a / least)).when(a == float("inf"), F.lit(2047 << 52)).otherwise(normal))
    key = F.when(F.isnan(v), F.lit((1 << 63) - 1)).when(v < 0, -F.col("_size")).otherwise(F.col("_size"))
    return steps.withColumn(name, key).drop("_a", "_e", "_power", "_off", "_size")


def value_bucket(v: Column) -> Column:
    """A bucket number that never decreases as ``v`` grows, 256 to the octave; one expression, for histograms to look at."""
    return F.floor(F.signum(v) * F.log2(1 + F.abs(v)) * 256)


def histogram(df: DataFrame, by: list[str], value: str, measures: dict[str, Column] | None = None) -> DataFrame:
    """One row per group and distinct value with summed measures (row count by default)."""
    measures = measures or {"n": F.lit(1)}
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v"))
    return rows.agg(*[F.sum(c).alias(m) for m, c in measures.items()])


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys are equal; the columns of ``keys`` come from the left."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    met = reduce(lambda x, y: x & y, [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys])
    return left.join(other, met, how).drop(*[f"_r_{k}" for k in keys])


def known(df: DataFrame) -> DataFrame:
    """``df``, of a few rows a group, worked out once: with ``BROADCAST_ROWS`` rows or fewer it goes to what it is joined with, which
    stays where it is; if there are so many groups that it has more, both sides are shuffled."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _with_prefixes(df: DataFrame, value: str) -> DataFrame:
    return with_order_key(df, value).withColumns({"_p": F.shiftright("_key", FIRST), "_q": F.shiftright("_key", SECOND)}).drop("_key")


def _prefixed(df: DataFrame, by: list[str], value: str, measures: dict[str, Column]) -> DataFrame:
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"), *[c.alias(m) for m, c in measures.items()])
    return _with_prefixes(rows, "v")


def _running(rows: DataFrame, group: list[str], order: str, measures: list[str], start: str = "") -> DataFrame:
    """Adds ``_c_<m>``, the total up to and including each row; with ``start`` the totals begin with ``<start><m>``."""
    upto = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", *[(F.sum(m).over(upto) + (F.col(f"{start}{m}") if start else F.lit(0))).alias(f"_c_{m}") for m in measures])


def running_totals(hist: DataFrame, by: list[str], measures: list[str], value: str = "v") -> DataFrame:
    """Adds ``cum_<m>`` (running total up to and including the value) and ``total_<m>`` per group.

    Totals are accumulated over the prefixes of a group, over the longer prefixes of a prefix and over the values of these."""
    rows = _with_prefixes(hist, value)
    before = lambda df, mark: df.select(*[c for c in df.columns if not c.startswith("_c_")], *[(F.col(f"_c_{m}") - F.col(m)).alias(f"{mark}{m}") for m in measures])
    first = before(_first_pass(rows, by, measures), "_before_").drop(*measures)
    longer = rows.groupBy(*by, "_p", "_q").agg(*[F.sum(m).alias(m) for m in measures])
    second = before(_running(same(longer, first, [*by, "_p"]), [*by, "_p"], "_q", measures, "_before_"), "_start_").drop(*measures, *[f"_before_{m}" for m in measures])
    last = _running(same(rows, second, [*by, "_p", "_q"]), [*by, "_p", "_q"], value, measures, "_start_")
    return last.select(*hist.columns, *[F.col(f"_c_{m}").alias(f"cum_{m}") for m in measures], *[f"total_{m}" for m in measures])


def _first_pass(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Totals per prefix, up to it (``_c_``) and of the whole group (``total_``)."""
    counts = rows.groupBy(*by, "_p").agg(*[F.sum(m).alias(m) for m in measures])
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return _running(counts.select("*", *[F.sum(m).over(whole).alias(f"total_{m}") for m in measures]), by, "_p", measures)


def _second_pass(rows: DataFrame, chosen: DataFrame, by: list[str], measures: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the chosen prefixes folded to values, and their totals per longer prefix, up to it within the group.

    ``chosen`` has ``_before_<m>``, the totals before the prefix, and what else is to be carried along."""
    keys = [*by, "_p"]
    few = same(rows, chosen.select(*keys), keys)
    values = cut_lineage(few.groupBy(*by, "_p", "_q", "v").agg(*[F.sum(m).alias(m) for m in measures]))    # the second and last scan
    placed = same(values.groupBy(*by, "_p", "_q").agg(*[F.sum(m).alias(m) for m in measures]), chosen, keys)
    return values, _running(placed, keys, "_q", measures, "_before_")


def _rank_picks(df: DataFrame, by: list[str], value: str, measure: Column, wanted: Column) -> DataFrame:
    """(by, total, rank, v): the value at which the running total of ``measure`` first exceeds each element of ``wanted``,
    an array over ``total_n``."""
    rows = _prefixed(df, by, value, {"n": measure})
    holds = lambda ranks: F.filter(ranks, lambda r: (F.col("_c_n") - F.col("n") <= r) & (r < F.col("_c_n")))
    first = _first_pass(rows, by, ["n"]).withColumn("_ranks", holds(F.array_distinct(wanted))).where(F.size("_ranks") > 0)
    chosen = known(first.select(*by, "_p", (F.col("_c_n") - F.col("n")).alias("_before_n"), "total_n", "_ranks"))    # a few rows a group
    values, placed = _second_pass(rows, chosen, by, ["n"])
    there = placed.withColumn("_ranks", holds(F.col("_ranks"))).where(F.size("_ranks") > 0)
    there = there.select(*by, "_p", "_q", (F.col("_c_n") - F.col("n")).alias("_start_n"), "total_n", "_ranks")
    keys = [*by, "_p", "_q"]
    last = _running(same(values, there, keys), keys, "v", ["n"], "_start_")
    return last.select(*by, "total_n", "v", F.explode(holds(F.col("_ranks"))).alias("rank"))


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group: one row, one column per entry of ``probs``.

    All probabilities share the two passes; nulls are left out, null groups are groups."""
    position = lambda p, n: F.lit(float(p)) * (n - 1)
    n = F.col("total_n")
    wanted = F.array(*[side(position(p, n)).cast("bigint") for p in probs.values() for side in (F.floor, F.ceil)])
    picks = _rank_picks(df, by, value, F.lit(1), wanted)
    at = lambda side, p: F.max(F.when(F.col("rank") == side(position(p, n)), F.col("v")))
    out = picks.groupBy(*by).agg(F.max("total_n").alias("n"), *[at(side, p).alias(f"_{name}_{k}") for name, p in probs.items() for k, side in (("lo", F.floor), ("hi", F.ceil))])

    def between(name: str, p: float) -> Column:
        """From the nearer of the two ends, as numpy does: next to a large step the other way loses digits."""
        low, high, share = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), position(p, F.col("n")) - F.floor(position(p, F.col("n")))
        return F.when(share < 0.5, low + share * (high - low)).otherwise(high - (1 - share) * (high - low))

    return out.select(*by, "n", *[between(name, p).alias(name) for name, p in probs.items()])


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Smallest value whose cumulative weight reaches half of the group's weight; weights are not negative."""
    rows = _prefixed(df, by, value, {"w": F.col(weight)})
    first = _first_pass(rows, by, ["w"])
    reach = Window.partitionBy(*by, "_on").orderBy("_p") if by else Window.partitionBy("_on").orderBy("_p")
    first = first.withColumn("_on", F.col("_c_w") >= F.col("total_w") / 2).withColumn("_r", F.row_number().over(reach)).where("_on AND _r = 1")
    chosen = known(first.select(*by, "_p", (F.col("_c_w") - F.col("w")).alias("_before_w"), "total_w"))
    values, _ = _second_pass(rows, chosen, by, ["w"])
    # what stands before is a sum in another order, so the last value of the prefix counts as reached whatever the last bit says
    keys = [*by, "_p"]
    last = _running(same(values.drop("_q"), chosen, keys), keys, "v", ["w"], "_before_")
    found = last.groupBy(*by).agg(F.min(F.when(F.col("_c_w") >= F.col("total_w") / 2, F.col("v"))).alias("m"), F.max("v").alias("top"))
    return found.select(*by, F.coalesce("m", "top").alias("weighted_median"))


def ks_statistic(df: DataFrame, by: list[str], value: str, is_recent: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of recent against baseline rows per group, by branch and bound."""
    both = (F.col("total_n1") > 0) & (F.col("total_n2") > 0)
    gaps = reduce(DataFrame.unionByName, [x.select(*by, "_gap", "total_n1", "total_n2") for x in gap_levels(df, by, value, is_recent)])
    return gaps.groupBy(*by).agg(F.max(F.when(both, F.col("_gap"))).alias("ks_statistic"), F.max("total_n1").alias("n_recent"), F.max("total_n2").alias("n_baseline"))


def gap_levels(df: DataFrame, by: list[str], value: str, is_recent: Column) -> list[DataFrame]:
    """The gap of the two distributions at the end of every prefix, of every longer prefix and at every value that can matter.

    Inside a prefix the gap cannot exceed what it would be if all rows of one side came first; only prefixes for which
    that beats the largest gap known so far are counted by their longer prefixes, and only of longer ones of that kind are
    the values themselves exchanged.  So what is sent has a bound that does not grow with the rows."""
    two = ["n1", "n2"]
    rows = _prefixed(df, by, value, {"n1": is_recent.cast("long"), "n2": (~is_recent).cast("long")})
    side = lambda c, m: F.coalesce(F.try_divide(c, F.col(f"total_{m}")), F.lit(0.0))
    share = lambda a, b: F.abs(side(a, "n1") - side(b, "n2"))
    gap = share(F.col("_c_n1"), F.col("_c_n2"))
    most = F.greatest(share(F.col("_c_n1"), F.col("_c_n2") - F.col("n2")), share(F.col("_c_n1") - F.col("n1"), F.col("_c_n2")))
    start = lambda mark: [(F.col(f"_c_{m}") - F.col(m)).alias(f"{mark}{m}") for m in two]
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    best = lambda known: F.greatest(known, F.max("_gap").over(whole))
    totals = ["total_n1", "total_n2", "_best"]

    def level(near: DataFrame, keys: list[str], new: str) -> DataFrame:
        """Rows within ``near``, one for each value of ``new``, with the gap at its end."""
        counts = same(rows, near.select(*keys), keys).groupBy(*dict.fromkeys([*keys, new])).agg(*[F.sum(m).alias(m) for m in two])
        return _running(same(counts, near, keys), keys, new, two, "_start_").withColumn("_gap", gap)

    first = known(_first_pass(rows, by, two).withColumn("_gap", gap).withColumn("_best", best(F.lit(0.0))))    # counts, not rows
    near = first.where(most > F.col("_best")).select(*by, "_p", *start("_start_"), *totals)
    second = known(level(near, [*by, "_p"], "_q").withColumn("_best", best(F.col("_best"))))
    nearer = second.where(most > F.col("_best")).select(*by, "_p", "_q", *start("_start_"), *totals)
    return [first, second, level(nearer, [*by, "_p", "_q"], "v")]
