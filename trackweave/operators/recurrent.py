"""Sequences for a recurrent network, and its forward pass over a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from .ranges import points_within

FEATURES = 6


def features(points: DataFrame) -> DataFrame:
    """``x``: the six features of a point; what is missing or not finite is zero."""
    z = lambda c, mean, std: (F.col(c) - mean) / std
    parts = [z("latitude", 53.0, 8.0), z("longitude", -30.0, 25.0), z("velocity_mps", 240.0, 30.0), F.sin(F.radians("heading_deg")), F.cos(F.radians("heading_deg")), z("altitude_m", 10500.0, 1000.0)]
    return points.withColumn("x", F.array(*[F.coalesce(F.when(~F.isnan(p), p), F.lit(0.0)) for p in parts]))


def padded(dense: DataFrame, ends: DataFrame, context: int, before: int = 64, after: int = 32) -> DataFrame:
    """Arrays of features of the last points before and the first after each gap, of fixed lengths, with masks.

    Those before are padded on the left, those after on the right; the padding is zeros.
    """
    hit = points_within(ends.select("segment_id", "icao24", "t0", "t1"), features(dense), F.col("t0") - context, F.col("t1") + context, ["t", "event_id", "x"])
    first = F.col("t") <= F.col("t0")
    order = [F.when(first, -F.col("t")).otherwise(F.col("t")), F.when(first, -F.col("event_id")).otherwise(F.col("event_id"))]
    near = F.row_number().over(Window.partitionBy("segment_id", "first").orderBy(*order))
    rows = hit.where("t <= t0 OR t >= t1").withColumn("first", first).withColumn("n", near).where(F.col("n") <= F.when(F.col("first"), before).otherwise(after))
    row = F.struct("t", "event_id", "x")
    got = rows.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.when(F.col("first"), row))).alias("b"), F.array_sort(F.collect_list(F.when(~F.col("first"), row))).alias("a"))
    zero = F.array(*[F.lit(0.0)] * FEATURES)
    pad = lambda c, n: F.array_repeat(zero, F.lit(n) - F.size(c))
    ones, none = lambda c: F.array_repeat(F.lit(1.0), F.size(c)), lambda c, n: F.array_repeat(F.lit(0.0), F.lit(n) - F.size(c))
    return got.select(
        "segment_id", F.concat(pad("b", before), F.col("b.x")).alias("before_seq"), F.concat(none("b", before), ones("b")).alias("before_mask"),
        F.concat(F.col("a.x"), pad("a", after)).alias("after_seq"), F.concat(ones("a"), none("a", after)).alias("after_mask"),
    )


def samples(dense: DataFrame, targets: DataFrame, ends: DataFrame, context: int, before: int = 64, after: int = 32, waypoints: int = 32) -> DataFrame:
    """One row a gap: padded sequences, the first ``waypoints`` targets (share of the way, baseline, true place), duration."""
    n = F.row_number().over(Window.partitionBy("segment_id").orderBy("t", "event_id"))
    j = targets.select("icao24", "seq", "event_id", "t", "latitude", "longitude").join(ends, ["icao24", "seq"]).withColumn("n", n).where(F.col("n") <= waypoints)
    tau = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))))
    lat, lon = geo.great_circle(*map(F.col, ("lat0", "lon0", "lat1", "lon1")), F.col("tau"))
    j = j.withColumn("tau", tau).withColumn("base_lat", lat).withColumn("base_lon", lon)
    way = F.array_sort(F.collect_list(F.struct("n", "event_id", "tau", "base_lat", "base_lon", "latitude", "longitude")))
    w = j.groupBy("segment_id").agg(way.alias("w"), F.first(F.col("t1") - F.col("t0")).alias("gap_us"))
    w = w.select("segment_id", (F.col("gap_us") / 1e6).alias("gap_seconds"), *[F.col(f"w.{c}").alias(f"way_{c}") for c in ("event_id", "tau", "base_lat", "base_lon", "latitude", "longitude")])
    return padded(dense, ends, context, before, after).join(w, "segment_id")


def shapes(hidden: int = 160, layers: int = 2) -> dict[str, tuple[int, ...]]:
    """Names and shapes of the weights: 1,045,795 numbers at the default sizes."""
    h, out = hidden, {}
    for name, directions in (("before", ("", "_reverse")), ("after", ("",))):
        for layer in range(layers):
            wide = FEATURES if layer == 0 else h * len(directions)
            for way in directions:
                out |= {f"{name}.w_ih_{layer}{way}": (3 * h, wide), f"{name}.w_hh_{layer}{way}": (3 * h, h), f"{name}.b_ih_{layer}{way}": (3 * h,), f"{name}.b_hh_{layer}{way}": (3 * h,)}
    out |= {"h0.w": (h, 3 * h + 1 + FEATURES), "h0.b": (h,)}
    out |= {"decoder.w_ih_0": (3 * h, 3), "decoder.w_hh_0": (3 * h, h), "decoder.b_ih_0": (3 * h,), "decoder.b_hh_0": (3 * h,)}
    return out | {"head.w_0": (128, h), "head.b_0": (128,), "norm.w": (128,), "norm.b": (128,), "head.w_1": (64, 128), "head.b_1": (64,), "head.w_2": (3, 64), "head.b_2": (3,)}


def seeded_weights(seed: int = 42, hidden: int = 160, layers: int = 2) -> dict[str, np.ndarray]:
    """Weights drawn at random, for a network that is still to be trained: small, with no biases."""
    rng = np.random.default_rng(seed)
    return {k: np.ones(s) if k == "norm.w" else np.zeros(s) if len(s) == 1 else rng.normal(0, 1 / np.sqrt(s[1]), s) for k, s in shapes(hidden, layers).items()}


def write_weights(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    """The weights as a table: a row a tensor, of a number of values that the sizes fix."""
    rows = [(name, list(w.shape), np.asarray(w, float).ravel().tolist()) for name, w in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.parquet(path)


def checked(weights: dict[str, np.ndarray], hidden: int, layers: int) -> dict[str, np.ndarray]:
    """``weights``, if they are those of a network of these sizes and all finite; else an error that says what is wrong."""
    want = shapes(hidden, layers)
    wrong = [f"{k}: not there" for k in want.keys() - weights.keys()] + [f"{k}: not of this network" for k in weights.keys() - want.keys()]
    wrong += [f"{k}: shape {weights[k].shape} instead of {want[k]}" for k in want.keys() & weights.keys() if weights[k].shape != want[k]]
    wrong += [f"{k}: not finite" for k in want.keys() & weights.keys() if not np.isfinite(weights[k]).all()]
    if wrong:
        raise ValueError("; ".join(sorted(wrong)))
    return weights


_LOADED: dict[tuple, dict[str, np.ndarray]] = {}


def load_weights(path: str, hidden: int = 160, layers: int = 2) -> dict[str, np.ndarray]:
    """The weights at ``path``, read once in a process and checked against the sizes."""
    if (path, hidden, layers) not in _LOADED:
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        table = ds.dataset(folder, filesystem=store, format="parquet", exclude_invalid_files=True).to_table()
        rows = zip(table["name"].to_pylist(), table["shape"].to_pylist(), table["values"])
        _LOADED[path, hidden, layers] = checked({name: np.asarray(v.values.to_numpy(zero_copy_only=False)).reshape(shape) for name, shape, v in rows}, hidden, layers)
    return _LOADED[path, hidden, layers]


#: Arrays of a sample, their features and lengths (fixed values: steps before and after, waypoints).
TENSORS = {"before_seq": FEATURES, "before_mask": None, "after_seq": FEATURES, "after_mask": None}


def write_tensors(rows: DataFrame, path: str) -> None:
    """Samples with a ``split`` as arrays of 32-bit floats, in a folder a split."""
    cast = {c: F.col(c).cast("array<array<float>>" if wide else "array<float>") for c, wide in TENSORS.items()}
    rows.withColumns(cast).write.partitionBy("split").parquet(path)


def read_tensors(spark: SparkSession, path: str, split: str | None = None, before: int = 64, after: int = 32) -> DataFrame:
    """What `write_tensors` wrote, of one split or all; an array of another shape is an error where it is met."""
    rows = spark.read.parquet(path)
    rows = rows if split is None else rows.where(F.col("split") == split)
    for c, wide in TENSORS.items():
        size = before if c.startswith("before") else after
        right = F.size(c) == size
        if wide:
            right = right & F.forall(c, lambda x: F.size(x) == wide)  # noqa: B023
        rows = rows.withColumn(c, F.when(right, F.col(c)).otherwise(F.raise_error(F.lit(f"{c}: not of {size} steps"))))
    return rows


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _gelu(x: np.ndarray) -> np.ndarray:
    """By the error function's rational approximation in Abramowitz and Stegun 7.1.26, right to 1.5e-7."""
    u = np.abs(x) / np.sqrt(2)
    k = 1 / (1 + 0.3275911 * u)
    tail = k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * np.exp(-u * u)
    return 0.5 * x * (1 + np.sign(x) * (1 - tail))


def _gru(w: dict, name: str, x: np.ndarray, lengths: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All states and the last one of a batch (row, step, feature); beyond its length a row keeps its state."""
    tail = name.rsplit(".", 1)
    wi, wh, bi, bh = (w[f"{tail[0]}.{k}_{tail[1]}"] for k in ("w_ih", "w_hh", "b_ih", "b_hh"))
    inputs, out = x @ wi.T + bi, np.empty((*x.shape[:2], h.shape[1]))
    for i in range(x.shape[1]):
        (ri, zi, ni), (rh, zh, nh) = np.split(inputs[:, i], 3, axis=1), np.split(h @ wh.T + bh, 3, axis=1)
        z = _sigmoid(zi + zh)
        new = (1 - z) * np.tanh(ni + _sigmoid(ri + rh) * nh) + z * h
        h = np.where((i < lengths)[:, None], new, h)
        out[:, i] = h
    return out, h


def _backwards(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row's first ``length`` steps in reverse; the rest stays."""
    i = np.arange(x.shape[1])[None]
    return np.take_along_axis(x, np.where(i < lengths[:, None], lengths[:, None] - 1 - i, i)[:, :, None], axis=1)


def _encode(w: dict, name: str, x: np.ndarray, lengths: np.ndarray, hidden: int, layers: int, both: bool) -> list[np.ndarray]:
    for layer in range(layers):
        start = np.zeros((len(x), hidden))
        out, last = _gru(w, f"{name}.{layer}", x, lengths, start)
        ends = [last]
        if both:
            back, first = _gru(w, f"{name}.{layer}_reverse", _backwards(x, lengths), lengths, start)
            out, ends = np.concatenate([out, _backwards(back, lengths)], axis=2), [last, first]
        x = out
    return ends


def forward(w: dict, before: np.ndarray, before_mask: np.ndarray, after: np.ndarray, after_mask: np.ndarray, gap_seconds: np.ndarray, way: np.ndarray) -> np.ndarray:
    """Corrections (row, waypoint, 3) to the baseline, for a batch; ``way`` holds share, baseline latitude and longitude.

    An encoder reads as many steps from the front as the mask has ones, padding on the left included.
    """
    hidden = w["h0.w"].shape[0]
    layers = sum(k.startswith("after.w_hh") for k in w)
    count = lambda m: np.maximum(m.sum(axis=1).astype(int), 1)
    ends = _encode(w, "before", before, count(before_mask), hidden, layers, True) + _encode(w, "after", after, count(after_mask), hidden, layers, False)
    steps = before_mask.shape[1]
    last = steps - 1 - np.argmax(before_mask[:, ::-1] > 0, axis=1)
    dynamic = np.where((before_mask > 0).any(axis=1)[:, None], before[np.arange(len(before)), last], 0.0)
    h0 = np.tanh(np.concatenate([*ends, gap_seconds[:, None] / 6000, dynamic], axis=1) @ w["h0.w"].T + w["h0.b"])
    x, _ = _gru(w, "decoder.0", way, np.full(len(way), way.shape[1]), h0)
    x = x @ w["head.w_0"].T + w["head.b_0"]
    x = (x - x.mean(axis=2, keepdims=True)) / np.sqrt(x.var(axis=2, keepdims=True) + 1e-5) * w["norm.w"] + w["norm.b"]
    return _gelu(_gelu(x) @ w["head.w_1"].T + w["head.b_1"]) @ w["head.w_2"].T + w["head.b_2"]


#: Samples that go through the network side by side: the states of all steps of a part are held at once (about 0.5 MB a sample).
TOGETHER = 128


def in_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of ``frames`` in order, at most ``TOGETHER`` at a time."""
    for f in frames:
        for i in range(0, len(f), TOGETHER):
            yield f.iloc[i : i + TOGETHER]


def infer(table: DataFrame, weights: dict[str, np.ndarray] | str, hidden: int = 160, layers: int = 2) -> DataFrame:
    """(segment_id, event_id, latitude, longitude, altitude_ft) for each waypoint of ``samples``.

    ``weights`` is the path of a weights table, which each worker reads once, or the weights themselves, which are broadcast:
    their number is fixed by the sizes (about 8 MB), not by the data.
    """
    shared = None if isinstance(weights, str) else table.sparkSession.sparkContext.broadcast(weights)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid = lambda c: np.stack([np.stack(v) for v in c])
        for f in in_parts(frames):
            n = f["way_tau"].map(len).to_numpy()
            way = np.zeros((len(f), n.max(), 3))
            for i, parts in enumerate(zip(f["way_tau"], f["way_base_lat"], f["way_base_lon"])):
                way[i, : n[i]] = np.stack(parts, axis=1)
            r = forward(shared.value if shared else load_weights(weights, hidden, layers), grid(f["before_seq"]), np.stack(f["before_mask"]), grid(f["after_seq"]), np.stack(f["after_mask"]), f["gap_seconds"].to_numpy(), way)
            on = np.arange(n.max())[None] < n[:, None]
            yield pd.DataFrame({
                "segment_id": np.repeat(f["segment_id"].to_numpy(), n), "event_id": np.concatenate(list(f["way_event_id"])),
                "latitude": (way[:, :, 1] + r[:, :, 0])[on], "longitude": (way[:, :, 2] + r[:, :, 1])[on], "altitude_ft": (35000 + 5000 * r[:, :, 2])[on],
            })

    return table.mapInPandas(batches, "segment_id string, event_id long, latitude double, longitude double, altitude_ft double")
