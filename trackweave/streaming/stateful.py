"""Streams with a state for each key: sessions that close by a timer, the best row of each key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.smoother import Motion
from .tables import finish, stream_latest

#: The state of such streams is kept by this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

REPORT = "t long, event_id long, latitude double, longitude double"
SEGMENT = "icao24 string, s0 long, s1 long, n_points long, lat0 double, lon0 double, lat1 double, lon1 double"


class Sessions(StatefulProcessor):
    """Reports wait until the watermark has passed them, so that they count in order; a session closes once none can join it.

    The state of an aircraft is one open session and its reports within the allowed lateness.
    """

    def __init__(self, gap: int, least: int = 2):
        self.gap, self.least = gap, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", REPORT)
        self.open = handle.getValueState("open", "s0 long, s1 long, n_points long, lat0 double, lon0 double, lat1 double, lon1 double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.waiting.appendList([(int(t), int(e), float(a), float(b)) for t, e, a, b in zip(part["t"], part["event_id"], part["latitude"], part["longitude"])])
        yield from self.advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def advance(self, key, now: int) -> Iterator[pd.DataFrame]:
        every = sorted(self.waiting.get()) if self.waiting.exists() else []
        left = [x for x in every if x[0] >= now]
        session = tuple(self.open.get()) if self.open.exists() else None
        closed = []
        for t, _, lat, lon in every[: len(every) - len(left)]:
            if session is not None and t - session[1] > self.gap:
                closed.append(session)
                session = None
            session = (t, t, 1, lat, lon, lat, lon) if session is None else (session[0], t, session[2] + 1, session[3], session[4], lat, lon)
        if session is not None and now > session[1] + self.gap:
            closed.append(session)
            session = None
        self.waiting.clear()
        if left:
            self.waiting.put(left)
        self.open.clear()
        if session is not None:
            self.open.update(session)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        next_ = [x[0] for x in left[:1]] + ([session[1] + self.gap] if session is not None else [])
        if next_:
            self.handle.registerTimer(min(next_) // 1000 + 1)
        rows = [(key[0], *s) for s in closed if s[2] >= self.least and s[1] > s[0]]
        if rows:
            yield pd.DataFrame(rows, columns=["icao24", "s0", "s1", "n_points", "lat0", "lon0", "lat1", "lon1"])

    def close(self) -> None:
        pass


GAP_ROW = "t long, along_m double, cross_m double, event_id long"
PLACE = "segment_id string, event_id long, along_m double, cross_m double"


class GapFilter(StatefulProcessor):
    """The filter of a gap goes forward as the watermark passes its reports; once the gap is closed, the pass back gives its places.

    The state of a gap is what waits for the watermark, and of each step what was predicted and what was known after it.
    """

    def __init__(self, params: tuple[float, float, float]):
        self.r, self.q = np.full(2, params[0] ** 2), np.array(params[1:]) ** 2

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", GAP_ROW)
        self.steps = handle.getListState("steps", "t long, events array<long>, predicted array<double>, known array<double>")
        self.last = handle.getValueState("last", "t long, known array<double>")
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.until.update((int(part["until"].iloc[0]),))
            plain = lambda x: None if pd.isna(x) else float(x)
            self.waiting.appendList([(int(t), plain(a), plain(c), None if pd.isna(e) else int(e)) for t, a, c, e in zip(part["t"], part["along_m"], part["cross_m"], part["event_id"])])
        yield from self.advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def advance(self, key, now: int) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0]
        closed = now > until
        every = sorted((tuple(x) for x in self.waiting.get()), key=lambda x: x[0]) if self.waiting.exists() else []
        ready = [x for x in every if closed or x[0] < now]
        line: dict[int, tuple[np.ndarray, list[int]]] = {}
        for t, along, cross, event in ready:
            z, events = line.setdefault(t, (np.full(2, np.nan), []))
            if along is not None and np.isnan(z[0]):
                z[:] = along, cross
            if event is not None:
                events.append(event)
        state = self.last.get() if self.last.exists() else None
        now_at, motion = (state[0], _motion(state[1])) if state is not None else (None, None)
        seen = [t for t, (z, _) in line.items() if not np.isnan(z[0])]
        if motion is None and (len(seen) >= 2 or (closed and seen)):  # the first two measurements give the speed to start with
            a, b = seen[0], seen[min(1, len(seen) - 1)]
            motion = Motion.start(line[a][0], (line[b][0] - line[a][0]) / max((b - a) / 1e6, 1.0), self.r)
        if motion is not None:
            for t, (z, events) in line.items():
                motion = motion.predicted(np.float64((t - now_at) / 1e6), self.q) if now_at is not None else motion
                known = motion.updated(z, self.r)
                self.steps.appendValue((t, events, _flat(motion), _flat(known)))
                now_at, motion = t, known
            left = [x for x in every if not (closed or x[0] < now)]
        else:
            left = every
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.waiting.clear()
        if not closed:
            if left:
                self.waiting.put(left)
            if motion is not None and now_at is not None:
                self.last.update((now_at, _flat(motion)))
            waits = [x[0] for x in left if x[0] >= now]
            self.handle.registerTimer(min([until, *waits]) // 1000 + 1)
            return
        rows = self.back(key[0]) if self.steps.exists() else []
        for value in (self.steps, self.last, self.until):
            value.clear()
        if rows:
            yield pd.DataFrame(rows, columns=["segment_id", "event_id", "along_m", "cross_m"])

    def back(self, name: str) -> list[tuple]:
        steps = list(self.steps.get())
        out: list[tuple] = []
        x = v = None
        for i in range(len(steps) - 1, -1, -1):
            known = _motion(steps[i][3])
            if x is None:
                x, v = known.x, known.v
            else:
                x, v = known.smoothed(np.float64((steps[i + 1][0] - steps[i][0]) / 1e6), _motion(steps[i + 1][2]), x, v)
            out.extend((name, int(e), float(x[0]), float(x[1])) for e in steps[i][1])
        return out

    def close(self) -> None:
        pass


def _flat(m: Motion) -> list[float]:
    return np.concatenate([m.x, m.v, m.xx, m.xv, m.vv]).tolist()


def _motion(values) -> Motion:
    return Motion(*np.array(values, float).reshape(5, 2))


def stream_smoothed(rows: DataFrame, params: tuple[float, float, float], out: str, checkpoint: str, time: str = "time", late: str = "4 hours") -> DataFrame:
    """Smoothed places along and across of the gap rows in a stream (segment_id, t, along_m, cross_m, event_id, until, a time).

    A gap is given once the watermark has passed ``until``. Rows that come ``late`` or less after a newer one count as if in order.
    """
    cols = ["segment_id", "t", "along_m", "cross_m", "event_id", "until", time]
    return _with_state(rows.withWatermark(time, late).select(*cols), "segment_id", GapFilter(params), PLACE, out, checkpoint)


def _with_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, out: str, checkpoint: str) -> DataFrame:
    spark = rows.sparkSession
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        got = rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")
        finish(got.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    finally:
        spark.conf.set(STORE[0], before)
    return spark.read.schema(schema).parquet(out)


def stream_segments(reports: DataFrame, gap: int, out: str, checkpoint: str, time: str = "time", late: str = "4 hours") -> DataFrame:
    """Segments of the stream ``reports`` (icao24, event_id, t, latitude, longitude, a time), each given once when it closes.

    A session that runs on over the end of a run stays in the state, so that the run in which it closes gives it, whole.
    Reports that come ``late`` or less after a newer one count as if in order. An empty stream gives no segment.
    """
    rows = reports.withWatermark(time, late).select("icao24", "t", "event_id", "latitude", "longitude", time)
    return _with_state(rows, "icao24", Sessions(gap), SEGMENT, out, checkpoint)


def stream_best(rows: DataFrame, key: str, order: list[Column], out: str, checkpoint: str) -> DataFrame:
    """The best row of each key as of the last batch: a better one that comes later replaces it, by all of ``order``.

    The state of a key is its best row; ``order`` must tell any two rows apart.
    """
    named = {f"o{i}": c for i, c in enumerate(order)}
    ranked = rows.select(F.col(key), F.struct(*[c.alias(n) for n, c in named.items()], F.struct(*[F.col(c) for c in rows.columns if c != key]).alias("row")).alias("best"))
    best = ranked.groupBy(key).agg(F.min("best").alias("best")).select(key, "best.row.*")
    return stream_latest(best, [key], out, checkpoint)
