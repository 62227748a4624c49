"""A polled source of live state vectors as a stream: snapshots by poll, a failed poll is an empty one."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Seconds between polls, and how old a position may be.
POLL = 90
#: Polls to a folder of snapshots.
BLOCK = 960

# Places in a state vector (fixed values).
ICAO24, CALLSIGN, COUNTRY, CONTACT, LONGITUDE, LATITUDE, BARO, GROUND, VELOCITY, HEADING, GEO = 0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 13

SCHEMA = "poll long, contact long, icao24 string, callsign string, country string, latitude double, longitude double, altitude_m double, on_ground boolean, velocity_mps double, heading_deg double"


class Polls(InputPartition):
    def __init__(self, block: int, first: int, last: int):
        self.block, self.first, self.last = block, first, last


class LiveReader(DataSourceStreamReader):
    """Offsets are numbers of polls. Options: path, first and last poll; box (south, north, west, east); failing: polls that are divisible by it fail."""

    def __init__(self, options: dict):
        self.path, self.first, self.last = options["path"], int(options["first"]), int(options["last"])
        self.box = [float(x) for x in options["box"].split(",")] if options.get("box") else None
        self.failing = int(options.get("failing", 0))

    def initialOffset(self) -> dict:
        return {"poll": self.first}

    def latestOffset(self) -> dict:
        return {"poll": max(self.first, self.last + 1)}

    def partitions(self, start: dict, end: dict) -> list[Polls]:
        a, b = start["poll"], end["poll"]
        return [Polls(k, max(a, k * BLOCK), min(b, (k + 1) * BLOCK)) for k in range(a // BLOCK, -(-b // BLOCK)) if a < b]

    def fetched(self, block: int) -> Iterator[tuple[int, list]]:
        """The polls of a folder, a line at a time: no more than one poll is held."""
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(f"{self.path}/block={block}")
        for f in store.get_file_info(fs.FileSelector(folder)):
            if f.path.endswith(".txt"):
                with io.TextIOWrapper(store.open_input_file(f.path), encoding="utf-8", newline="\n") as lines:
                    for line in lines:
                        snapshot = json.loads(line)
                        yield snapshot["time"] // POLL, snapshot.get("states") or []

    def read(self, partition: Polls) -> Iterator[tuple]:
        polls = self.fetched(partition.block)
        while True:
            try:
                poll, states = next(polls)
            except (StopIteration, OSError):  # the service does not answer: its polls are empty, and the stream goes on
                return
            if partition.first <= poll < partition.last and not (self.failing and poll % self.failing == 0):
                for s in states:
                    row = vector(poll, s)
                    if row is not None and (self.box is None or (row[5] is not None and row[6] is not None and self.box[0] <= row[5] <= self.box[1] and self.box[2] <= row[6] <= self.box[3])):
                        yield row

    def commit(self, end: dict) -> None:
        pass


def vector(poll: int, s: list | None) -> tuple | None:
    """A state vector as a row; unknown heights count by the other sensor, unknown speeds and courses as zero."""
    if not s:
        return None
    number = lambda x: None if x is None else float(x)
    return (poll, s[CONTACT], s[ICAO24], (s[CALLSIGN] or "").strip(), s[COUNTRY] or "", number(s[LATITUDE]), number(s[LONGITUDE]), float(s[GEO] or s[BARO] or 0), bool(s[GROUND]), float(s[VELOCITY] or 0), float(s[HEADING] or 0))


class LiveStates(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_states"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LiveReader:
        return LiveReader(self.options)


def write_snapshots(reports: DataFrame, path: str, keep: int = 2) -> None:
    """What a service that keeps a position for ``keep`` polls would have answered: the newest report of each aircraft, a line a poll.

    ``reports``: icao24, callsign, t (microseconds), latitude, longitude, baro_m, altitude_m, on_ground, velocity_mps, heading_deg, event_id.
    """
    first = F.floor(F.col("t") / (POLL * 1_000_000)) + 1
    seen = reports.withColumn("poll", F.explode(F.sequence(first, first + keep - 1)))
    text = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    none = F.lit("null")
    contact = F.floor(F.col("t") / 1_000_000).cast("string")
    values = [text(F.col("icao24")), text(F.col("callsign")), none, contact, contact, plain("longitude"), plain("latitude"), plain("baro_m"), plain("on_ground"), plain("velocity_mps"), plain("heading_deg"), none, none, plain("altitude_m")]
    newest = seen.groupBy("poll", "icao24").agg(F.max_by(F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]")), F.struct("t", "event_id")).alias("state"))
    lines = newest.groupBy("poll").agg(F.array_sort(F.collect_list("state")).alias("s"))  # the aircraft of one poll
    line = F.concat(F.lit('{"time":'), (F.col("poll") * POLL).cast("string"), F.lit(',"states":['), F.array_join("s", ","), F.lit("]}"))
    lines.select(line.alias("value"), F.floor(F.col("poll") / BLOCK).alias("block")).repartition("block").write.partitionBy("block").text(path)


def airborne(states: DataFrame, metres: float = 7000.0, speed: float = 150.0) -> DataFrame:
    """Fresh positions of aircraft that fly high and fast, in feet and knots."""
    fresh = F.col("poll") * POLL - F.col("contact") <= POLL
    up = states.where(~F.col("on_ground") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & (F.col("altitude_m") >= metres) & (F.col("velocity_mps") >= speed) & fresh)
    whole = lambda c: F.round(c).cast("long")
    return up.select("poll", "icao24", "callsign", "latitude", "longitude", whole(F.col("altitude_m") * 3.28084).alias("alt_ft"), whole(F.col("velocity_mps") * 1.94384).alias("vel_kts"), "heading_deg")


def poll_range(reports: DataFrame) -> tuple[int, int]:
    """First and last poll with a report."""
    r = reports.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    return (0, -1) if r.a is None else (r.a // (POLL * 1_000_000) + 1, r.b // (POLL * 1_000_000) + 2)
