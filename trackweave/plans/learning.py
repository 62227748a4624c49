"""Queries of the recurrent network: its tensors, weights and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import numbering
from ..operators import recurrent as N
from ..sources.reports import points
from ..sources.tables import shared_folder
from .queries import CONTEXT, _anc, _pts, _seg, query, r
from .smoothing import _SPLITS

_X = ["(latitude - 53.0) / 8.0", "(longitude + 30.0) / 25.0", "(velocity_mps - 240.0) / 30.0", "sin(radians(heading_deg))", "cos(radians(heading_deg))", "(altitude_m - 10500.0) / 1000.0"]
_NEAR = f"""near AS (SELECT a.segment_id, p.t <= a.t0 AS early, {', '.join(f'CAST({x} AS FLOAT) AS x{i}' for i, x in enumerate(_X))},
 row_number() OVER (PARTITION BY a.segment_id, p.t <= a.t0 ORDER BY CASE WHEN p.t <= a.t0 THEN -p.t ELSE p.t END, CASE WHEN p.t <= a.t0 THEN -p.event_id ELSE p.event_id END) AS n
 FROM anc a JOIN adsb p ON p.icao24 = a.icao24 AND p.t >= a.t0 - {CONTEXT} AND p.t < a.t1 + {CONTEXT} WHERE p.t <= a.t0 OR p.t >= a.t1),
cells AS (SELECT segment_id, early, unnest(generate_series(0, CASE WHEN early THEN 63 ELSE 31 END)) AS pos FROM anc, (SELECT unnest([true, false]) AS early))"""


def _samples(spark, d):
    return N.samples(points(spark, d, "adsb"), _pts(spark, d), _anc(spark, d), CONTEXT)


@query()
def ml_sequences(spark, d):
    """One row of fixed-length arrays a gap, as a recurrent network takes it."""
    return _samples(spark, d)


@query(f""", {_SPLITS}, {_NEAR} SELECT split, c.segment_id, CASE WHEN c.early THEN 'before' ELSE 'after' END AS side, CAST(c.pos AS INTEGER) AS pos, CASE WHEN n IS NULL THEN 0 ELSE 1 END AS mask, {', '.join(f'round(coalesce(CAST(x{i} AS DOUBLE), 0.0), 6) AS x{i}' for i in range(6))}
 FROM cells c JOIN splits USING (segment_id) LEFT JOIN near b ON b.segment_id = c.segment_id AND b.early = c.early AND c.pos = CASE WHEN c.early THEN 64 - n ELSE n - 1 END""")
def ml_tensors(spark, d):
    """The arrays of all samples, written by split and read back, a row a step."""
    path = shared_folder(spark)
    seg = _seg(spark, d)
    splits = seg.join(numbering.split_of_keys(seg, "icao24"), "icao24").select("segment_id", "split")
    N.write_tensors(_samples(spark, d).join(splits, "segment_id"), path)
    t = N.read_tensors(spark, path)
    sides = [t.select("split", "segment_id", F.lit(side).alias("side"), F.posexplode(F.arrays_zip(F.col(f"{side}_seq").alias("x"), F.col(f"{side}_mask").alias("m"))).alias("pos", "s")) for side in ("before", "after")]
    return sides[0].unionByName(sides[1]).select("split", "segment_id", "side", "pos", F.col("s.m").cast("int").alias("mask"), *[F.round(F.col("s.x")[i].cast("double"), 6).alias(f"x{i}") for i in range(6)])


@query(f""", p AS (SELECT a.segment_id, p.event_id, p.t, t0, t1, row_number() OVER (PARTITION BY a.segment_id ORDER BY p.t, p.event_id) AS n FROM pts p JOIN anc a ON a.icao24 = p.icao24 AND a.seq = p.seq)
 SELECT segment_id, event_id, CAST(n - 1 AS INTEGER) AS pos, round(least(1.0, greatest(0.0, (t - t0) / (t1 - t0))), 6) AS tau, round((t1 - t0) / 1e6, 3) AS gap_seconds FROM p WHERE n <= 32""")
def ml_targets(spark, d):
    """The waypoints of all samples, a row each."""
    return _samples(spark, d).select("segment_id", "gap_seconds", F.posexplode(F.arrays_zip("way_event_id", "way_tau")).alias("pos", "w")).select("segment_id", F.col("w.way_event_id").alias("event_id"), "pos", F.round("w.way_tau", 6).alias("tau"), r("gap_seconds", 3))


@query()
def gru_infer(spark, d):
    """Forward pass of the recurrent network of 160 units over all gaps; its weights, from a seed, are kept as a table."""
    path = shared_folder(spark)
    N.write_weights(spark, N.seeded_weights(), path)
    return N.infer(_samples(spark, d), path).select("segment_id", "event_id", r("latitude", 4), r("longitude", 4), r("altitude_ft", 2))
