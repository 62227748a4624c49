"""Cleaning, resampling and reconstruction of tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.tables import stage
from .ranges import points_within

MINUTE = 60_000_000


def keep_first(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return points.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def clean(points: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with key, time and a valid position; one a key and time."""
    ok = points.dropna(subset=[*keys, "t", "latitude", "longitude"]).where(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))
    return keep_first(ok, [*keys, "t"], ["event_id"])


def drop_spikes(points: DataFrame, keys: list[str], cap_kt: float | dict[str, float], tie: str = "event_id", radius: float = geo.RADIUS_M) -> DataFrame:
    """Without isolated spikes: points too fast to reach and to leave while their neighbours fit each other.

    A stack of kept points is enough: while its top is a spike between the one below and the next, it goes. A track
    in which no point is a spike between its own neighbours cannot lose any, so that only the others meet in a task.
    ``cap_kt`` may give a cap for each value of the last key; tracks of other values stay as they are.
    """

    def metres(a, b):
        la, lb = np.radians(a[1]), np.radians(b[1])
        h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(b[2] - a[2]) / 2) ** 2
        return 2 * radius * np.arcsin(np.sqrt(min(1.0, max(0.0, h))))

    def knots(a, b):
        dt = (b[0] - a[0]) / 1e6
        return metres(a, b) / 1000 * geo.KM_TO_NM / (dt / 3600) if dt > 0 else None

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["t", tie])
        cap = cap_kt[group[keys[-1]].iloc[0]] if isinstance(cap_kt, dict) else cap_kt
        kept: list[tuple] = []
        for row in zip(group["t"], group["latitude"], group["longitude"], range(len(group))):
            while len(kept) >= 2:
                s = knots(kept[-2], kept[-1]), knots(kept[-1], row), knots(kept[-2], row)
                if None in s or not (s[0] > cap and s[1] > cap and s[2] <= cap):
                    break
                kept.pop()
            kept.append(row)
        return group.iloc[[k[3] for k in kept]]

    w = Window.partitionBy(*keys).orderBy("t", tie)
    here = F.struct("t", "latitude", "longitude")
    a, b = F.lag(here).over(w), F.lead(here).over(w)

    def kt(p, q):
        return geo.speed_kt(geo.haversine_m(p["latitude"], p["longitude"], q["latitude"], q["longitude"], radius), (q["t"] - p["t"]) / 1e6)

    # by a little more than the cap both ways, so that rounding in another engine cannot hide a spike
    caps = F.create_map(*[F.lit(x) for c in cap_kt.items() for x in c])[F.col(keys[-1])] if isinstance(cap_kt, dict) else F.lit(float(cap_kt))
    legs = points.select(*keys, caps.alias("cap"), kt(a, here).alias("to"), kt(here, b).alias("off"), kt(a, b).alias("past"))
    some = legs.where("to > cap * 0.999999 AND off > cap * 0.999999 AND past <= cap * 1.000001").select(*keys).distinct()
    rest = points.join(some, keys, "left_anti")
    return rest.select(*points.columns).unionByName(points.join(some, keys, "left_semi").select(*points.columns).groupBy(*keys).applyInPandas(one, points.schema))


def _filled(df: DataFrame, keys: list[str], values: list[str], time: str = "t") -> DataFrame:
    """``df`` with ``values`` linear in time between the nearest known ones; none outside of them.

    The next known values are the last ones in the reverse order: both windows run on with each row, while one up to the
    end of a track would be gone through again at every row.
    """
    known = F.struct(*[F.when(F.col(v).isNotNull(), F.struct(F.col(time).alias("t"), F.col(v).alias("v"))).alias(v) for v in values])
    upto = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda name, order: {f"__{name}{i}": F.last(F.col("__known")[v], ignorenulls=True).over(upto(order)) for i, v in enumerate(values)}
    every = df.withColumn("__known", known).withColumns(last("p", F.asc(time))).withColumns(last("n", F.desc(time)))

    def fill(i):
        p, n = F.col(f"__p{i}"), F.col(f"__n{i}")
        return F.when(n["t"] == p["t"], p["v"]).otherwise(p["v"] + (n["v"] - p["v"]) * ((F.col(time) - p["t"]) / (n["t"] - p["t"])))

    return every.select(*[fill(values.index(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def resample(points: DataFrame, keys: list[str], values: list[str], step: int, exact: bool) -> DataFrame:
    """Values on a grid of ``step``. Exact: only samples on the grid count, which spans the samples outward.

    Otherwise the grid starts at the first sample and ends by the last one, and all samples count.
    """
    ends = points.groupBy(*keys).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    if exact:
        ends = ends.select(*keys, (F.floor(F.col("a") / step) * step).alias("a"), (F.ceil(F.col("b") / step) * step).alias("b"))
    grid = ends.select(*keys, F.explode(F.sequence("a", "b", F.lit(step))).alias("t"), F.lit(True).alias("on"))
    samples = points.select(*keys, "t", *values)
    # the grid exchanges once with the samples, and both windows keep to that
    every = grid.join(samples, [*keys, "t"], "left" if exact else "full")
    return _filled(every.select(*keys, "t", "on", *values), keys, values).where("on").drop("on")


def anchors(points: DataFrame, segments: DataFrame, context: int) -> DataFrame:
    """Of each segment: last dense point before and first after it, within ``context``."""
    hit = points_within(segments.select("segment_id", "icao24", "seq", "s0", "s1"), points, F.col("s0") - context, F.col("s1") + context, ["t", "latitude", "longitude"])
    before, after = F.col("t") < F.col("s0"), F.col("t") > F.col("s1")
    point = F.struct("t", "latitude", "longitude")
    got = hit.groupBy("segment_id", "icao24", "seq").agg(F.max(F.when(before, point)).alias("a"), F.min(F.when(after, point)).alias("b"))
    got = got.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return got.select("segment_id", "icao24", "seq", *[F.col(f"{s}.{c}").alias(f"{n}{i}") for s, i in (("a", 0), ("b", 1)) for c, n in (("t", "t"), ("latitude", "lat"), ("longitude", "lon"))])


def anchor_values(points: DataFrame, segments: DataFrame, context: int, columns: dict[str, str]) -> DataFrame:
    """(segment_id, before_anchor_*, after_anchor_*): values of ``columns`` at the last dense point before and the first after each segment."""
    hit = points_within(segments.select("segment_id", "icao24", "s0", "s1"), points, F.col("s0") - context, F.col("s1") + context, ["t", "event_id", *columns])
    at = F.struct("t", "event_id")
    sides = (("before", F.max_by, F.col("t") < F.col("s0")), ("after", F.min_by, F.col("t") > F.col("s1")))
    return hit.groupBy("segment_id").agg(*[pick(c, F.when(on, at)).alias(f"{side}_anchor_{n}") for c, n in columns.items() for side, pick, on in sides])


def baseline(points: DataFrame, ends: DataFrame) -> DataFrame:
    """Great-circle position at each point's time, and its distance from the point."""
    j = points.join(ends, ["icao24", "seq"])
    tau = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))))
    j = j.withColumn("tau", tau)
    lat, lon = geo.great_circle(*map(F.col, ("lat0", "lon0", "lat1", "lon1")), F.col("tau"))
    j = j.withColumn("base_lat", lat).withColumn("base_lon", lon)
    return j.withColumn("error_m", geo.haversine_m(*map(F.col, ("latitude", "longitude", "base_lat", "base_lon"))))


def dense_track(ends: DataFrame, step: int = MINUTE) -> DataFrame:
    """Points of the great circle, about one a ``step``, at least both ends."""
    n = F.greatest(F.lit(2), F.floor((F.col("t1") - F.col("t0")) / step) + 1)
    d = ends.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    lat, lon = geo.great_circle(*map(F.col, ("lat0", "lon0", "lat1", "lon1")), F.col("i") / (F.col("n") - 1))
    return d.withColumn("latitude", lat).withColumn("longitude", lon)


#: Values of one quantity that a batch of tracks may have: tracks times steps times two axes.
CELLS = 1 << 18


def smooth_tracks(t: np.ndarray, z: np.ndarray, sigma_m: float, q: float) -> np.ndarray:
    """Positions (track, step, axis) of a constant-velocity filter and its pass back, many tracks side by side.

    ``t`` (track, step) in seconds, ``z`` (track, step, axis) in metres. The axes have the same covariances and are else independent.
    A short track goes on with steps whose time is NaN; what is found for those does not count, and its pass back begins at its last step.
    """
    tracks, n = t.shape
    r, dt = sigma_m**2, np.maximum(np.diff(t, axis=1, prepend=t[:, :1]), 0.0)
    ahead, here = np.empty((n, 3, tracks)), np.empty((n, 3, tracks))  # covariances predicted and updated: place, both, speed
    before, after = np.empty((n, 2, tracks, 2)), np.empty((n, 2, tracks, 2))  # places and speeds
    xx, xv, vv = np.full(tracks, 4 * r), np.zeros(tracks), np.full(tracks, 250.0**2)
    x, v = z[:, 0].copy(), np.zeros((tracks, 2))
    for i in range(n):
        d = dt[:, i]
        x = x + d[:, None] * v
        xx, xv, vv = xx + 2 * d * xv + d**2 * vv + q * d**3 / 3, xv + d * vv + q * d**2 / 2, vv + q * d
        ahead[i], before[i] = (xx, xv, vv), (x, v)
        gain, speed_gain, off = xx / (xx + r), xv / (xx + r), z[:, i] - x
        x, v = x + gain[:, None] * off, v + speed_gain[:, None] * off
        xx, xv, vv = xx - gain * xx, xv - gain * xv, vv - speed_gain * xv
        here[i], after[i] = (xx, xv, vv), (x, v)
    out = np.empty((tracks, n, 2))
    length = (~np.isnan(t)).sum(axis=1)
    x, v = after[n - 1]
    out[:, n - 1] = x
    for i in range(n - 2, -1, -1):
        last = (length - 1 == i)[:, None]
        d, (xx, xv, vv), (a, b, c) = dt[:, i + 1], here[i], ahead[i + 1]
        det = a * c - b * b
        dx, dv = x - before[i + 1, 0], v - before[i + 1, 1]
        ex, ev = (c[:, None] * dx - b[:, None] * dv) / det[:, None], (a[:, None] * dv - b[:, None] * dx) / det[:, None]
        x = after[i, 0] + (xx + d * xv)[:, None] * ex + xv[:, None] * ev
        v = after[i, 1] + (xv + d * vv)[:, None] * ex + vv[:, None] * ev
        x, v = np.where(last, after[i, 0], x), np.where(last, after[i, 1], v)
        out[:, i] = x
    return out


def kalman_smooth(points: DataFrame, keys: list[str], sigma_m: float = 2000.0, q: float = 0.01) -> DataFrame:
    """Constant-velocity filter and Rauch-Tung-Striebel smoother of local east and north; tracks of like length go side by side.

    Whole tracks meet in sorted batches. Rows whose time or place is not known are left out.
    """
    k, names, most = geo.RADIUS_M * np.pi / 180, points.columns, CELLS

    def coded(table: pa.Table, c: str) -> np.ndarray:
        return table[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()

    def answers(table: pa.Table) -> pa.RecordBatch:
        cols = [table[c].to_numpy() for c in ("t", "latitude", "longitude")]
        new = np.ones(len(table), bool)
        new[1:] = np.any([np.diff(coded(table, c)) != 0 for c in keys], axis=0)
        begin = np.flatnonzero(new)
        sizes = np.diff(begin, append=len(table))
        track = np.cumsum(new) - 1
        la0, lo0 = cols[1][begin], cols[2][begin]
        shrink = np.cos(np.radians(la0))
        t = (cols[0] - cols[0][begin][track]) / 1e6
        z = np.stack([(cols[2] - lo0[track]) * k * shrink[track], (cols[1] - la0[track]) * k], axis=1)
        found, order, i = np.empty((len(table), 2)), np.argsort(sizes, kind="stable"), 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j + 1 - i) * sizes[order[j]] * 2 <= most:
                j += 1
            part = order[i:j]
            steps = np.arange(sizes[part].max())
            real = steps < sizes[part, None]
            place = np.minimum(steps, sizes[part, None] - 1) + begin[part, None]
            found[place[real]] = smooth_tracks(np.where(real, t[place], np.nan), z[place], sigma_m, q)[real]
            i = j
        lat, lon = la0[track] + found[:, 1] / k, lo0[track] + found[:, 0] / (k * shrink[track])
        own = [table[c].combine_chunks() for c in names]
        return pa.RecordBatch.from_arrays([*own, pa.array(lat), pa.array(lon)], names=[*names, "smooth_lat", "smooth_lon"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in (b for b in batches if b.num_rows):
            held.append(b)
            size += b.num_rows
            if size * 2 >= most:
                table = pa.Table.from_batches(held)
                same = np.ones(size, bool)
                for c in keys:  # the last track may go on
                    own = coded(table, c)
                    same &= own == own[-1]
                cut = size - int(np.argmin(same[::-1])) if not same.all() else 0
                if cut:
                    yield answers(table.slice(0, cut))
                held, size = table.slice(cut).to_batches(), size - cut
        if size:
            yield answers(pa.Table.from_batches(held))

    known = points.dropna(subset=["t", "latitude", "longitude"])
    # written first: read straight from a plan that was dealt by aircraft and day, tracks of several days came in parts
    ordered = stage(known).repartition(*keys).sortWithinPartitions(*keys, "t", "event_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return ordered.mapInArrow(run, f"{schema}, smooth_lat double, smooth_lon double")
