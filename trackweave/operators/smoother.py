"""Smoothing of a gap in the coordinates along and across the great circle between its ends."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .ranges import points_within

# The two grids of (measurement std in m, acceleration std along, across in m/s2).
GRIDS = {
    "compact": ([250.0, 500.0, 1000.0], [0.005, 0.01, 0.02, 0.05], [0.001, 0.003, 0.006, 0.01]),
    "deep": ([100.0, 250.0, 500.0, 1000.0, 2000.0], [0.001, 0.003, 0.005, 0.01, 0.02, 0.05, 0.1], [0.0005, 0.001, 0.003, 0.005, 0.01, 0.02]),
}
ENDS = ("lat0", "lon0", "lat1", "lon1")


def parameter_grid(name: str) -> list[tuple[float, float, float]]:
    return list(itertools.product(*GRIDS[name]))


def context_points(dense: DataFrame, ends: DataFrame, context: int, before: int | None = 64, after: int | None = 32) -> DataFrame:
    """The last ``before`` dense points up to each gap's start and the first ``after`` from its end on, ends included; None: all."""
    hit = points_within(ends, dense, F.col("t0") - context, F.col("t1") + context, ["t", "event_id", "latitude", "longitude"]).where("t <= t0 OR t >= t1")
    if before is None and after is None:
        return hit
    side = F.col("t") <= F.col("t0")
    near = Window.partitionBy("segment_id", "first").orderBy(*[F.when(side, -F.col(c)).otherwise(F.col(c)) for c in ("t", "event_id")])
    rows = hit.withColumn("first", side).withColumn("__r", F.row_number().over(near))
    return rows.where(F.col("__r") <= F.when(F.col("first"), before or 1 << 31).otherwise(after or 1 << 31)).drop("__r", "first")


def context_measurements(dense: DataFrame, ends: DataFrame, context: int, before: int | None = 64, after: int | None = 32) -> DataFrame:
    """The points of ``context_points``, one a time: that of the largest event_id."""
    last = Window.partitionBy("segment_id", "t").orderBy(F.desc("event_id"))
    return context_points(dense, ends, context, before, after).withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")


def gap_rows(measured: DataFrame, targets: DataFrame, ends: DataFrame) -> DataFrame:
    """The timeline of each gap: measured points, in metres along and across, and the times asked for (``event_id``)."""
    along, across = geo.along_cross_m(*map(F.col, (*ENDS, "latitude", "longitude")))
    seen = measured.select("segment_id", "t", along.alias("along_m"), across.alias("cross_m"), F.lit(None).cast("long").alias("event_id"))
    asked = targets.join(ends.select("segment_id", "icao24", "seq"), ["icao24", "seq"])
    nothing = F.lit(None).cast("double")
    return seen.unionByName(asked.select("segment_id", "t", nothing.alias("along_m"), nothing.alias("cross_m"), "event_id"))


#: Values of one quantity that a batch of gaps may have: gaps times steps times parameter sets times two axes.
CELLS = 1 << 18
#: Start variances of the speeds along and across (m/s).
SPEED_STD = np.array([250.0, 50.0])


@dataclass
class Motion:
    """Positions, speeds and their covariances on two axes, which are independent; any leading dimensions, the last is the axis."""

    x: np.ndarray
    v: np.ndarray
    xx: np.ndarray
    xv: np.ndarray
    vv: np.ndarray

    @classmethod
    def start(cls, x: np.ndarray, v: np.ndarray, r: np.ndarray) -> Motion:
        """From a first position and speed; ``r``, the variance of a measurement, has the dimensions of the result."""
        full = np.zeros(np.broadcast_shapes(x.shape, r.shape))
        return cls(full + x, full + v, full + 4 * r, full.copy(), full + SPEED_STD**2)

    def predicted(self, dt: np.ndarray, q: np.ndarray) -> Motion:
        return Motion(
            self.x + dt * self.v, self.v, self.xx + 2 * dt * self.xv + dt**2 * self.vv + q * dt**4 / 4,
            self.xv + dt * self.vv + q * dt**3 / 2, self.vv + q * dt**2,
        )

    def updated(self, z: np.ndarray, r: np.ndarray) -> Motion:
        """With a measured position; where ``z`` is NaN nothing was measured."""
        seen = ~np.isnan(z)
        gain = np.where(seen, self.xx / (self.xx + r), 0.0)
        speed_gain = np.where(seen, self.xv / (self.xx + r), 0.0)
        off = np.where(seen, z, self.x) - self.x
        return Motion(self.x + gain * off, self.v + speed_gain * off, self.xx - gain * self.xx, self.xv - gain * self.xv, self.vv - speed_gain * self.xv)

    def smoothed(self, dt: np.ndarray, ahead: Motion, x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and speed here, given those smoothed one step on (``x``, ``v``) and what was predicted for there (``ahead``)."""
        a, b, c = self.xx + dt * self.xv, self.xv, self.xv + dt * self.vv
        det = ahead.xx * ahead.vv - ahead.xv**2
        dx, dv = (x - ahead.x) / det, (v - ahead.v) / det
        ex, ev = ahead.vv * dx - ahead.xv * dv, ahead.xx * dv - ahead.xv * dx
        return self.x + a * ex + b * ev, self.v + c * ex + self.vv * ev


def smooth_batch(t: np.ndarray, z: np.ndarray, params: np.ndarray) -> np.ndarray:
    """Positions (gap, step, parameter set, axis) of many gaps side by side.

    ``t`` (gap, step) in seconds, ``z`` (gap, step, axis), NaN where nothing was measured. A short gap goes on with
    steps of no time. Each gap has a measurement.
    """
    gaps, n = t.shape
    r, q = (params[:, :1] ** 2)[None] + np.zeros(2), (params[:, 1:] ** 2)[None]
    known = ~np.isnan(z[:, :, 0])
    first, row = known.argmax(axis=1), np.arange(gaps)
    later = known & (np.arange(n) > first[:, None])
    second = np.where(later.any(axis=1), later.argmax(axis=1), first)
    start = z[row, first]
    speed = (z[row, second] - start) / np.maximum(t[row, second] - t[row, first], 1.0)[:, None]
    steps = np.diff(t, axis=1, prepend=t[:, :1])[:, :, None, None]
    now = Motion.start(start[:, None], speed[:, None], r)
    before, after = [], []
    for i in range(n):
        if i:
            now = now.predicted(steps[:, i], q)
        before.append(now)
        now = now.updated(z[:, i, None], r)
        after.append(now)
    out = np.empty((gaps, n, len(params), 2))
    x, v = now.x, now.v
    out[:, n - 1] = x
    for i in range(n - 2, -1, -1):
        x, v = after[i].smoothed(steps[:, i + 1], before[i + 1], x, v)
        out[:, i] = x
    return out


def _smooth(t: np.ndarray, z: np.ndarray, params: np.ndarray) -> np.ndarray:
    """One gap: positions (step, parameter set, axis)."""
    return smooth_batch(t[None], z[None], params)[0]


def _smoothed_gaps(gap: np.ndarray, t: np.ndarray, z: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Positions (row, parameter set, axis) of rows in order of gap and time; NaN for gaps without a measurement.

    Rows of one time are one step, whose measurement is the first row's. Gaps of like length go side by side; parameter sets
    go one after the other where a single gap is long.
    """
    new_gap = np.diff(gap, prepend=gap[:1] - 1) != 0
    new_step = new_gap | (np.diff(t, prepend=t[:1] - 1) != 0)
    step = np.cumsum(new_step) - 1
    at = np.flatnonzero(new_step)
    own = (np.cumsum(new_gap) - 1)[at]  # the gap of each step
    begin = np.flatnonzero(np.diff(own, prepend=-1))
    sizes = np.diff(begin, append=len(own))
    some = np.add.reduceat(~np.isnan(z[at, 0]), begin) > 0
    found = np.full((len(at), len(grid), 2), np.nan)
    order = np.flatnonzero(some)[np.argsort(sizes[some], kind="stable")]
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * sizes[order[j]] * len(grid) * 2 <= CELLS:
            j += 1
        part = order[i:j]
        n = sizes[part].max()
        place = np.minimum(np.arange(n), sizes[part, None] - 1) + begin[part, None]
        real = np.arange(n) < sizes[part, None]
        times = (t[at[place]] - t[at[begin[part]]][:, None]) / 1e6
        seen = np.where(real[:, :, None], z[at[place]], np.nan)
        sets = max(1, CELLS // (2 * n * len(part)))
        for k in range(0, len(grid), sets):
            found[place[real], k : k + sets] = smooth_batch(times, seen, grid[k : k + sets])[real]
        i = j
    return found[step]


def smooth_gaps(rows: DataFrame, params: list[tuple[float, float, float]]) -> DataFrame:
    """(segment_id, event_id, param_id, along_m, cross_m) for each time asked for and each parameter set.

    Whole gaps meet in sorted batches and are smoothed side by side. Gaps without a measurement give none.
    """
    grid = np.array(params, dtype=float)
    k = len(grid)
    order = ["segment_id", "t", F.col("along_m").isNull(), "event_id"]
    # dealt by a hash of the key: an exchange by the key itself goes where a join has dealt by it, and the parts of a join
    # may be read in pieces at run time, so that a gap would come to several tasks
    ordered = rows.select("segment_id", "t", "along_m", "cross_m", "event_id").repartition(F.xxhash64("segment_id")).sortWithinPartitions(*order)

    def answers(table: pa.Table) -> Iterator[pa.RecordBatch]:
        coded = table["segment_id"].combine_chunks().dictionary_encode()
        z = np.stack([table[c].to_numpy() for c in ("along_m", "cross_m")], axis=1)
        gap, t, wanted = coded.indices.to_numpy(), table["t"].to_numpy(), table["event_id"].is_valid().to_numpy()
        sets = max(1, 4 * CELLS // len(table))  # of a long gap few parameter sets at a time
        for j in range(0, k, sets):
            own = np.arange(j, min(j + sets, k), dtype=np.int32)
            got = _smoothed_gaps(gap, t, z, grid[own])
            every = np.flatnonzero(wanted & ~np.isnan(got[:, 0, 0]))
            each = max(1, CELLS // len(own))
            for asked in (every[i : i + each] for i in range(0, len(every), each)):
                events = table["event_id"].take(pa.array(asked)).to_numpy().astype(np.int64)
                made = [coded.take(pa.array(np.repeat(asked, len(own)))).cast(pa.string()), pa.array(np.repeat(events, len(own))), pa.array(np.tile(own, len(asked))), *(pa.array(got[asked, :, axis].ravel()) for axis in (0, 1))]
                yield pa.RecordBatch.from_arrays(made, names=["segment_id", "event_id", "param_id", "along_m", "cross_m"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size * k * 2 >= CELLS:
                table = pa.Table.from_batches(held)
                last = table["segment_id"][size - 1].as_py()
                names = table["segment_id"].combine_chunks()
                cut = pc.index(names, pa.scalar(last)).as_py()  # the last gap may go on
                if cut:
                    yield from answers(table.slice(0, cut))
                held, size = table.slice(cut).to_batches(), size - cut
        if size:
            yield from answers(pa.Table.from_batches(held))

    return ordered.mapInArrow(run, "segment_id string, event_id long, param_id int, along_m double, cross_m double")


def path_position(along: Column, across: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a place along and across the great circle between the columns ``lat0`` .. ``lon1``."""
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    point = lambda p: F.struct(p[0].alias("lat"), p[1].alias("lon"))

    def share(s):
        total = F.greatest(geo.haversine_m(*(s[c] for c in ENDS)), F.lit(1.0))
        return F.struct(s.alias("s"), clip(s["along"] / total).alias("tau"), F.least(F.lit(0.01), 10_000.0 / total).alias("eps"))

    def points(x):
        ends = [x["s"][c] for c in ENDS]
        at = {"here": x["tau"], "before": clip(x["tau"] - x["eps"]), "after": clip(x["tau"] + x["eps"])}
        return F.struct(x["s"]["across"].alias("across"), *[geo.great_circle_point(*ends, t).alias(name) for name, t in at.items()])

    def course(x):
        own = geo.bearing_deg(x["before"]["lat"], x["before"]["lon"], x["after"]["lat"], x["after"]["lon"])
        return F.struct(x["here"].alias("here"), x["across"].alias("across"), (own + F.when(x["across"] >= 0, 90.0).otherwise(-90.0)).alias("course"))

    def of(step):
        return lambda s: step(s["s"])

    place = F.struct(*[F.col(c).alias(c) for c in ENDS], along.alias("along"), across.alias("across"))
    for step in (share, points, course, lambda x: point(geo.destination(x["here"]["lat"], x["here"]["lon"], x["course"], F.abs(x["across"])))):
        place = geo.let(of(step), s=place)
    return place["lat"], place["lon"]


def positions(smoothed: DataFrame, ends: DataFrame) -> DataFrame:
    lat, lon = path_position(F.col("along_m"), F.col("cross_m"))
    return smoothed.join(ends.select("segment_id", *ENDS), "segment_id").withColumn("smooth_lat", lat).withColumn("smooth_lon", lon)


def errors(placed: DataFrame, truth: DataFrame) -> DataFrame:
    """``placed`` with ``km``, the distance from where the report truly was."""
    e = placed.join(truth.select("event_id", "latitude", "longitude"), "event_id")
    return e.withColumn("km", geo.haversine_m(*map(F.col, ("latitude", "longitude", "smooth_lat", "smooth_lon"))) / 1000)


def tune(placed: DataFrame, truth: DataFrame, params: list[tuple[float, float, float]]) -> DataFrame:
    """One row a parameter set, best first: mean and median over gaps of a gap's mean error. Of equal ones the first is best."""
    e = errors(placed, truth)
    score = e.groupBy("param_id", "segment_id").agg(F.avg("km").alias("km")).groupBy("param_id").agg(F.avg("km").alias("mean_km"), F.median("km").alias("median_km"), F.count("*").alias("flights"))
    grid = e.sparkSession.createDataFrame([(i, *map(float, p)) for i, p in enumerate(params)], "param_id int, measurement_std_m double, accel_along double, accel_cross double")
    return score.join(F.broadcast(grid), "param_id").orderBy("mean_km", "param_id")  # the grid has at most 210 rows


def better_by(own: Column, base: Column) -> Column:
    """Improvement over a base in per cent; a base of nothing counts as next to nothing."""
    return (1 - own / F.greatest(base, F.lit(1e-9))) * 100


def compare_with_base(waypoints: DataFrame, keys: list[str]) -> DataFrame:
    """Of each flight: number of waypoints, mean and median error of both ways, improvements. ``waypoints``: keys, kalman_km, baseline_km."""
    m = waypoints.groupBy(*keys).agg(F.count("*").alias("n_waypoints"), *[f(f"{way}_km").alias(f"{way}_{name}_error_km") for way in ("kalman", "baseline") for name, f in (("mean", F.avg), ("median", F.median))])
    return m.select("*", *[better_by(F.col(f"kalman_{n}_error_km"), F.col(f"baseline_{n}_error_km")).alias(f"improvement_{n}_pct") for n in ("mean", "median")])


def summarize_split(waypoints: DataFrame, split: str = "split", flight: str = "segment_id") -> DataFrame:
    """Of each split: flights, mean and median of flights' mean errors, 90th percentile over all waypoints, improvements."""
    flights = waypoints.groupBy(split, flight).agg(*[F.avg(f"{w}_km").alias(f"{w}_km") for w in ("kalman", "baseline")])
    means = flights.groupBy(split).agg(F.count("*").alias("n_flights"), *[f(f"{w}_km").alias(f"{w}_{n}_error_km") for w in ("kalman", "baseline") for n, f in (("mean", F.avg), ("median", F.median))])
    tails = waypoints.groupBy(split).agg(*[F.percentile(f"{w}_km", F.lit(0.9)).alias(f"{w}_p90_error_km") for w in ("kalman", "baseline")])
    improved = [better_by(F.col(f"kalman_{n}_error_km"), F.col(f"baseline_{n}_error_km")).alias(f"improvement_{n}_pct") for n in ("mean", "median")]
    return means.join(tails, split).select("*", *improved)


def tuning(rows: DataFrame, ends: DataFrame, truth: DataFrame, splits: DataFrame, params: list[tuple[float, float, float]]) -> DataFrame:
    """One row for each of ``params``, best first, by the gaps of split ``val``; none, if there is no such gap. ``splits``: segment_id, split."""
    val = rows.join(splits.where("split = 'val'").select("segment_id"), "segment_id", "left_semi")
    return tune(positions(smooth_gaps(val, params), ends), truth, params)


def tuned(rows: DataFrame, ends: DataFrame, truth: DataFrame, splits: DataFrame, params: list[tuple[float, float, float]]) -> tuple[tuple[float, float, float], DataFrame]:
    """The best of ``params`` on the gaps of split ``val``, and the table of all; without such gaps an error.

    ``splits``: segment_id, split. The table has a row a parameter set.
    """
    table = tuning(rows, ends, truth, splits, params)
    best = table.first()
    if best is None:
        raise ValueError("no gap of the validation split can be smoothed")
    return params[best["param_id"]], table
