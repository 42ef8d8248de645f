"""The households that may be among a user's most similar ones, found block by block.

Users and households of one group are cut into blocks of neighbours: rows that lie close, consume about as much and
change alike over the months.  What two blocks know of each other (distance, range of the levels, range of the slopes)
bounds the score of every pair of them, so a block of users meets the most promising blocks of households first and
stops when the bound of the next one is below the worst score its users hold.  Only arrays of numbers are looked at here,
and the scores only tell which pairs are kept: the final ones are worked out by ``similarity.similarity_scores``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridlight import constants as C
from gridlight.functions.geo import EARTH_RADIUS_M

USER_BLOCK, HOUSEHOLD_BLOCK = 64, 512
# Scores here may differ from the final ones by rounding; bounds and limits leave this much room.
SLACK = 1e-6


def column(table: pa.Table, name: str) -> np.ndarray:
    return pc.cast(table.column(name), pa.float64()).to_numpy()


def months(table: pa.Table, name: str) -> np.ndarray:
    """Rows of twelve values, NaN where a month is missing."""
    return pc.list_flatten(table.column(name).combine_chunks()).to_numpy(zero_copy_only=False).astype(float).reshape(-1, 12)


def months_given(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The same from lists of (m, u), and the length of every list."""
    lists = table.column(name).combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out, pairs = np.full((len(lists), 12), np.nan), pc.list_flatten(lists)
    rows, m = np.repeat(np.arange(len(lists)), size), pairs.field("m").to_numpy(zero_copy_only=False)
    known = (m >= 1) & (m <= 12)
    out[rows[known], m[known] - 1] = pairs.field("u").to_numpy(zero_copy_only=False)[known]
    return out, size


def on_sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1) * EARTH_RADIUS_M


def blocks(features: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and the starts of its blocks (with the end): halves along the widest feature, down to ``size`` rows."""
    order, starts, todo = np.arange(len(features)), [], [(0, len(features))]
    while todo:
        a, b = todo.pop()
        rows = order[a:b]
        if b - a <= size:
            starts.append(a)
            continue
        part = features[rows]
        widest = part[:, np.argmax(part.max(0) - part.min(0))]
        half = (b - a) // 2
        order[a:b] = rows[np.argpartition(widest, half)]
        todo += [(a + half, b), (a, a + half)]
    return order, np.array([*starts, len(features)])


class Side:
    """One side's rows that compare over the same months: sums, slopes and what is needed of a block."""

    def __init__(self, xyz: np.ndarray, values: np.ndarray, over: list[int]):
        """``values`` are NaN outside ``over``; sums are taken in the order of the months, as the final scores take them."""
        n, zero = float(len(over)), np.zeros(len(values))
        self.xyz, self.values = xyz, [np.ascontiguousarray(values[:, m - 1]) for m in over]
        self.sum, self.squares, self.by_month, sm, smm = zero, zero.copy(), zero.copy(), 0.0, 0.0
        for m, v in zip(over, self.values):
            self.sum, self.squares, self.by_month, sm, smm = self.sum + v, self.squares + v * v, self.by_month + m * v, sm + m, smm + m * m
        self.flat = np.ptp(self.values, axis=0) == 0 if over else zero == 0
        self.spread = n * self.squares - self.sum * self.sum
        self.slope = (n * self.by_month - sm * self.sum) / (n * smm - sm * sm) if len(over) > 1 else zero

    def features(self, radius_m: float, weights: dict) -> np.ndarray:
        """Coordinates in which a step costs about as much score in any direction."""
        level = np.log(np.maximum(self.sum, 1e-3)) * (2 * weights["consumption_pattern"])
        return np.column_stack([self.xyz * (weights["geographic"] / radius_m), level, self.slope * (weights["seasonal_compatibility"] / 50)])

    def sorted(self, order: np.ndarray) -> Side:
        for name in ("xyz", "sum", "squares", "flat", "spread", "slope"):
            setattr(self, name, np.ascontiguousarray(getattr(self, name)[order]))
        self.values = [v[order] for v in self.values]
        return self

    def bounds(self, starts: np.ndarray) -> dict[str, np.ndarray]:
        at, n = starts[:-1], np.diff(starts)
        least, most = (lambda x: np.minimum.reduceat(x, at)), (lambda x: np.maximum.reduceat(x, at))
        centre = np.add.reduceat(self.xyz, at) / n[:, None]
        reach = most(np.linalg.norm(self.xyz - np.repeat(centre, n, 0), axis=1))
        return {"centre": centre, "reach": reach, "low": least(self.sum), "high": most(self.sum), "down": least(self.slope), "up": most(self.slope)}


def ladder(ratio: np.ndarray, high: np.ndarray | None = None) -> np.ndarray:
    """The score of a ratio, or the best one between ``ratio`` and ``high``."""
    high = ratio if high is None else high
    out = np.zeros(ratio.shape)
    for lo, hi, score in reversed(C.MAGNITUDE_LADDER):
        np.copyto(out, score, where=(ratio <= hi) & (high >= lo))
    return out


def block_scores(u: dict, h: dict, compared: bool, complete: bool, radius_m: float, weights: dict) -> np.ndarray:
    """No pair of the user block ``u`` (one row of bounds) and a household block scores more; -inf where all are too far apart."""
    apart = np.maximum(np.linalg.norm(h["centre"] - u["centre"], axis=1) - h["reach"] - u["reach"], 0.0)
    geographic = np.maximum(1 - apart / radius_m, 0.0)
    pattern, seasonal = 0.5, 0.5
    if compared:
        with np.errstate(all="ignore"):
            low = np.where(u["low"] >= 0, u["low"] / h["high"], -np.inf)
            high = u["high"] / np.where(u["high"] >= 0, h["low"], h["high"])
            # a household that feeds in more than it takes counts as alike
            pattern = np.where(h["low"] > 0, ladder(low, high), 1.0) * 0.8 + 0.2
    if complete:
        steepest = np.maximum.reduce([np.abs(h["down"]), np.abs(h["up"]), np.full(len(apart), max(50.0, abs(u["down"]), abs(u["up"])))])
        gap = np.maximum(np.maximum(h["down"] - u["up"], u["down"] - h["up"]), 0.0)
        seasonal = np.maximum(1 - gap / steepest, 0.0)
    most = (geographic * weights["geographic"] + pattern * weights["consumption_pattern"] + h["technical"] * weights["technical"]
            + seasonal * weights["seasonal_compatibility"])
    return np.where(apart <= radius_m * (1 + 1e-9) + 1e-3, np.minimum(most, 1.0) + SLACK, -np.inf)


def candidates(users: pa.Table, households: pa.Table, k: int, min_score: float, radius_m: float, weights: dict) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs, among them the best ``k`` of every user that reach ``min_score`` and all that tie with the last of these."""
    if not (len(users) and len(households)):
        return np.empty(0, int), np.empty(0, int)
    (own, size), net = months_given(users, "user_months"), months(households, "net_by_month")
    u_xyz, h_xyz = on_sphere(column(users, "latitude"), column(users, "longitude")), on_sphere(column(households, "CUSTOMER_LAT"), column(households, "CUSTOMER_LON"))
    middle = h_xyz.mean(0)
    u_xyz, h_xyz = u_xyz - middle, h_xyz - middle
    phases = pa.chunked_array([*users.column("user_phase").chunks, *households.column("account_phase").chunks]).combine_chunks().dictionary_encode().indices
    phase = phases.to_numpy(zero_copy_only=False).astype(float)      # NaN, which equals nothing, where null
    u_phase, h_phase = phase[:len(own)], phase[len(own):]
    quality = column(households, "data_quality_score")
    bit = 1 << np.arange(12)
    u_mask, h_mask = ~np.isnan(own) @ bit, ~np.isnan(net) @ bit
    held = np.full((len(own), k), min_score - SLACK)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    kinds, kind = np.unique(np.stack([u_mask, size], 1), axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    for i, (mask, given) in enumerate(kinds):
        us = np.flatnonzero(kind == i)
        both = h_mask & int(mask)
        for months_both in np.unique(both):
            hs = np.flatnonzero(both == months_both)
            over = [m for m in range(1, 13) if int(months_both) >> (m - 1) & 1]
            complete = given >= 2 and len(over) == given
            _search(us, Side(u_xyz[us], own[us], over), u_phase[us], hs, Side(h_xyz[hs], net[hs], over), h_phase[hs], quality[hs],
                    len(over), bool(complete), held, found, radius_m, weights)
    if not found:
        return np.empty(0, int), np.empty(0, int)
    ui, hi, score = (np.concatenate(x) for x in zip(*found))
    keep = score >= held[ui].min(1) - SLACK
    return ui[keep], hi[keep]


def _search(us, u: Side, u_phase, hs, h: Side, h_phase, quality, n: int, complete: bool, held: np.ndarray, found: list, radius_m: float, weights: dict) -> None:
    """Raises ``held``, the best scores of every user, by the households ``hs`` and adds the pairs that reached the worst of them to ``found``."""
    u_order, u_starts = blocks(u.features(radius_m, weights), USER_BLOCK)
    h_order, h_starts = blocks(h.features(radius_m, weights), HOUSEHOLD_BLOCK)
    us, u_phase, u = us[u_order], u_phase[u_order], u.sorted(u_order)
    hs, h_phase, quality, h = hs[h_order], h_phase[h_order], quality[h_order], h.sorted(h_order)
    u_bounds, h_bounds = u.bounds(u_starts), h.bounds(h_starts)
    h_bounds["technical"] = 0.9 + 0.1 * np.maximum.reduceat(quality, h_starts[:-1])
    h_sum = np.where(h.sum > 0, h.sum, 1.0)
    feeds_in = np.flatnonzero(h.sum <= 0)
    h_lengths, u_lengths = (h.xyz ** 2).sum(1), (u.xyz ** 2).sum(1)
    for b, (a, z) in enumerate(zip(u_starts[:-1], u_starts[1:])):
        most = block_scores({name: x[b] for name, x in u_bounds.items()}, h_bounds, n >= 2, complete, radius_m, weights)
        worst = held[us[a:z]].min(1)
        for c in np.argsort(-most, kind="stable"):
            if most[c] < worst.min():
                break
            p, q = h_starts[c], h_starts[c + 1]
            square = u_lengths[a:z, None] + h_lengths[None, p:q] - 2 * (u.xyz[a:z] @ h.xyz[p:q].T)
            apart = np.sqrt(np.maximum(square, 0.0, out=square), out=square)
            if radius_m > 10_000:     # below, chord and arc agree to a millimetre
                apart = 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(apart / (2 * EARTH_RADIUS_M), 1.0))
            # what a pair scores at most, before its shape and seasons are looked at
            score = np.maximum(1 - apart / radius_m, 0.0) * weights["geographic"] + (weights["technical"] * (0.9 + 0.1 * quality[p:q]) + weights["seasonal_compatibility"] * (1.0 if complete else 0.5))
            if n >= 2:
                ratio = u.sum[a:z, None] / h_sum[None, p:q]
                if len(feeds_in):
                    ratio[:, feeds_in[(feeds_in >= p) & (feeds_in < q)] - p] = 1.0
                magnitude = ladder(ratio)
                score += weights["consumption_pattern"] * (0.8 * magnitude + 0.2)
            else:
                score += weights["consumption_pattern"] * 0.5
            i, j = np.nonzero((score + SLACK >= worst[:, None]) & (apart <= radius_m * (1 + 1e-9) + 1e-3))
            if not len(i):
                continue
            ui, hj = i + a, j + p
            total = np.maximum(1 - apart[i, j] / radius_m, 0.0) * weights["geographic"]
            total += weights["technical"] * (0.7 + np.where(u_phase[ui] == h_phase[hj], 0.2, 0.0) + 0.1 * quality[hj])
            if n >= 2:
                products = 0.0
                for x, y in zip(u.values, h.values):
                    products = products + x[ui] * y[hj]
                under = np.sqrt(np.maximum(u.spread[ui] * h.spread[hj], 0.0))
                shaped = ~u.flat[ui] & ~h.flat[hj] & (under > 0)
                shape = np.where(shaped, ((n * products - u.sum[ui] * h.sum[hj]) / np.where(shaped, under, 1.0) + 1) / 2, 0.5)
                total += weights["consumption_pattern"] * np.clip(magnitude[i, j] * 0.8 + shape * 0.2, 0.0, 1.0)
            else:
                total += weights["consumption_pattern"] * 0.5
            if complete:
                steepest = np.maximum(np.maximum(np.abs(u.slope[ui]), np.abs(h.slope[hj])), 50.0)
                total += weights["seasonal_compatibility"] * np.clip(1 - np.abs(u.slope[ui] - h.slope[hj]) / steepest, 0.0, 1.0)
            else:
                total += weights["seasonal_compatibility"] * 0.5
            total = np.minimum(total, 1.0)
            near = np.flatnonzero(total >= worst[i] - SLACK)
            if not len(near):
                continue
            i, j, total = i[near], j[near], total[near]
            order = np.lexsort((-total, i))
            i, j, total = i[order], j[order], total[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            k = held.shape[1]
            new = np.full((z - a, k), -np.inf)
            new[i[place < k], place[place < k]] = total[place < k]
            merged = np.concatenate([held[us[a:z]], new], 1)
            merged.partition(k, axis=1)
            held[us[a:z]] = merged[:, k:]
            worst = merged[:, k:].min(1)
            still = total >= worst[i] - SLACK
            found.append((us[i[still] + a], hs[j[still] + p], total[still]))
