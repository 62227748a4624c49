"""Repair of the turn structure of conversations by signatures that are solved once.

A conversation becomes a string of a symbol a row, for its role and fault. Strings recur, so each distinct
one is solved once, by memoised recursion over rows and states of the grammar, and the answers are joined
back. Long conversations are cut into pieces: a piece is solved for every state it may begin and end in,
and the pieces of a conversation are put together in order, so that a conversation of any length needs no
task of its own for more than one row a piece. Edits are then replayed on the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows and bytes of text after which a piece ends.
PIECE_ROWS, PIECE_BYTES = 128, 1 << 20
#: Costs of an edit: to keep a row, to give it another role, to delete it, to insert one, and to leave one truncated.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

# Roles' initials must be (s?(ua)+)?. States: at the start, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_KEPT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A}
_NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # of a row that gets the role that must follow
_ENDS = (START, AFTER_A)
#: What it costs at most to go on from one state (row) as from another (column): a worse state is dropped.
_DETOUR = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))

Best = dict[int, tuple[int, str]]


def solve(signature: str) -> list[Best]:
    """For each state before the rows: by the state after them, least cost and the ASCII-least edits of that cost.

    Symbols: x must be deleted; s, u, a by role, o another role, in capitals where the text is truncated.
    """
    memo: dict[tuple[int, int, int], Best] = {}

    def best(i: int, q: int, inserted: int) -> Best:
        if (i, q, inserted) in memo:
            return memo[i, q, inserted]
        ways: list[tuple[int, str, Best]] = []
        if i < len(signature):
            symbol = signature[i]
            ways.append((DELETE, "D", best(i + 1, q, 0)))
            if symbol != "x":
                late = TRUNCATED * symbol.isupper()
                kept = _KEPT.get((q, symbol.lower()))
                if kept is not None:
                    ways.append((KEEP + late, "K", best(i + 1, kept, 0)))
                ways.append((REROLE + late, "R", best(i + 1, _NEXT[q], 0)))
        if inserted < 2:  # two lead from any state to any that can be reached
            ways.append((INSERT, "I", best(i, _NEXT[q], inserted + 1)))
        out: Best = {q: (0, "")} if i == len(signature) else {}
        for cost, edit, rest in ways:
            for end, (more, edits) in rest.items():
                now = (cost + more, edit + edits)
                if end not in out or now < out[end]:
                    out[end] = now
        memo[i, q, inserted] = out
        return out

    return [best(0, q, 0) for q in range(4)]


class Chain:
    """The pieces of one conversation, put together in order; what all ways have in common is handed on at once."""

    def __init__(self):
        self.ways: dict[int, tuple[int, str, list[tuple]]] = {START: (0, "", [])}
        self.edits: list[str] = []

    def add(self, place: tuple, table: list[Best]) -> Iterator[tuple]:
        new: dict[int, tuple[int, str, list[tuple]]] = {}
        for q, (cost, edits, steps) in self.ways.items():
            for end, (more, own) in table[q].items():
                now = (cost + more, edits + own)
                if end not in new or now < new[end][:2]:
                    new[end] = (*now, [*steps, (place, q, own)])
        self.ways = {q: w for q, w in new.items() if not any(w[0] > v[0] + _DETOUR[p][q] for p, v in new.items())}
        while len({w[2][0] if w[2] else None for w in self.ways.values()}) == 1 and next(iter(self.ways.values()))[2]:
            step = next(iter(self.ways.values()))[2][0]
            self.edits.append(step[2])
            self.ways = {q: (c, e[len(step[2]) :], s[1:]) for q, (c, e, s) in self.ways.items()}
            yield step

    def end(self) -> tuple[int, str, list[tuple]]:
        cost, edits, steps = min(self.ways[q] for q in _ENDS if q in self.ways)
        return cost, "".join(self.edits) + edits, steps


def replay(signature: str, edits: str, state: int) -> list[tuple[int | None, str | None, str]]:
    """What stays of a piece, in order: number of the row (None: inserted), new role (None: its own) and edit."""
    out: list[tuple[int | None, str | None, str]] = []
    row, q = 0, state
    for edit in edits:
        if edit == "K":
            q = _KEPT[q, signature[row].lower()]
            out.append((row, None, edit))
        elif edit != "D":
            q = _NEXT[q]
            out.append((None if edit == "I" else row, "user" if q == AFTER_U else "assistant", edit))
        row += edit != "I"
    return out


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults planted by the CRC-32 of ``conv:turn``; null roles and texts are one space."""
    conv, turn = F.col(f"`{conv_col}`"), F.col(f"`{turn_col}`")
    name = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    plain = rows.select(conv.alias("conv"), turn.alias("turn"), *[F.coalesce(F.col(f"`{c}`"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))], (F.crc32(name) % 20).alias("way"))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("way") == 3, 2).otherwise(1)
    return plain.where("way <> 0").select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("__copy")).drop("__copy")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text) with c, row, key, order columns, initial and fault: blank, duplicate, truncated or null."""
    rows = rows.select("conv", "turn", *[F.coalesce(n, F.lit(" ")).alias(n) for n in ("role", "text")])
    c = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    key = F.unhex(F.sha2(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text"), 256))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    first = F.substring("role", 1, 1)
    base = rows.select(
        "conv", "turn", "role", "text", c.alias("c"), F.monotonically_increasing_id().alias("row"), key.alias("key"), blank.alias("blank"), whole.alias("whole"),
        F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("initial"), F.octet_length("text").alias("bytes"),
    )
    base = materialize(base, "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), F.col("row").alias("row"))
    firsts = base.where("NOT blank").groupBy("c", "key").agg(F.min(place).alias("at")).select(F.col("at.row").alias("row"), F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(~F.col("whole"), "truncated")
    return base.join(firsts, "row", "left").withColumn("fault", fault)


def places(marked: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(c, part, seq, off, row, symbol, initial): rows in order within conversations, in pieces. A piece ends with its part of the sorted table at the latest."""
    must, late = F.col("fault").isin("blank", "duplicate"), F.col("fault") == "truncated"
    symbol = F.when(must, "x").when(late, F.upper("initial")).otherwise(F.col("initial"))
    order = ["c", F.col("turn").asc_nulls_first(), "role", "key", "row"]
    small = marked.select("c", "turn", "role", "key", "row", symbol.alias("symbol"), "initial", "bytes")
    ordered = small.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "row", "symbol", "initial", "bytes")

    def cut(batches):
        from pyspark import TaskContext

        part, last, seq, off, size = TaskContext.get().partitionId(), None, -1, 0, 0
        for b in batches:
            c, own = b.column(0).to_pylist(), b.column(4).to_pylist()
            seqs, offs = [], []
            for name, n in zip(c, own):
                if name != last or off >= piece_rows or size >= piece_bytes:
                    last, seq, off, size = name, seq + 1, 0, 0
                seqs.append(seq)
                offs.append(off)
                off, size = off + 1, size + n
            made = [b.column(0), pa.array([part] * len(c), pa.int32()), pa.array(seqs, pa.int64()), pa.array(offs, pa.int32()), *b.columns[1:4]]
            yield pa.RecordBatch.from_arrays(made, names=["c", "part", "seq", "off", "row", "symbol", "initial"])

    return materialize(ordered.mapInArrow(cut, "c string, part int, seq long, off int, row long, symbol string, initial string"), "places")


def solutions(signatures: DataFrame) -> DataFrame:
    """(signature, cost, edits) of distinct signatures: sixteen of each, by the states before and after; -1: none."""

    def run(batches):
        for b in batches:
            costs, edits = [], []
            for s in b.column(0).to_pylist():
                table = [t.get(end, (-1, "")) for t in solve(s) for end in range(4)]
                costs.append([cost for cost, _ in table])
                edits.append([own for _, own in table])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(costs, pa.list_(pa.int64())), pa.array(edits, pa.list_(pa.string()))], names=["signature", "cost", "edits"])

    return signatures.select("signature").distinct().mapInArrow(run, "signature string, cost array<long>, edits array<string>")


def _illegal(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def chained(pieces: DataFrame) -> DataFrame:
    """Of each piece (c, part, seq, signature, state, edits), and of each conversation, with no part, (c, cost, illegal, edits).

    The pieces of a conversation pass one task in order, a row a piece.
    """
    ordered = pieces.select("c", "part", "seq", "signature", "initials", "cost", "edits").repartition("c").sortWithinPartitions("c", "part", "seq")
    names = ["c", "part", "seq", "signature", "state", "edits", "cost", "illegal"]

    def run(batches):
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        out: list[tuple] = []
        chain, name, before, illegal = Chain(), None, "", 0

        def finish():
            if name is not None:
                cost, edits, steps = chain.end()
                out.extend((name, *place, q, own, None, None) for place, q, own in steps)
                out.append((name, None, None, None, None, edits, cost, illegal))

        def flushed():
            made = [pa.array(column, kind) for column, kind in zip(zip(*out), kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, names=names)

        for b in batches:
            for c, part, seq, signature, initials, cost, edits in zip(*(b.column(i).to_pylist() for i in range(7))):
                if c != name:
                    finish()
                    chain, name, before, illegal = Chain(), c, "", 0
                illegal += _illegal(before + initials)
                before = initials[-1:]
                table = [{end: (cost[4 * q + end], edits[4 * q + end]) for end in range(4) if cost[4 * q + end] >= 0} for q in range(4)]
                out.extend((name, *place, q, own, None, None) for place, q, own in chain.add((part, seq, signature), table))
                if len(out) >= 4096:
                    yield flushed()
        finish()
        if out:
            yield flushed()

    return ordered.mapInArrow(run, "c string, part int, seq long, signature string, state int, edits string, cost long, illegal long")


def _replayed(chosen: DataFrame) -> DataFrame:
    """(c, part, seq, ord, off, new_role, edit) of what stays."""

    def run(batches):
        for b in batches:
            of, rows = [], []
            for i, (signature, state, edits) in enumerate(zip(*(b.column(k).to_pylist() for k in (3, 4, 5)))):
                for n, step in enumerate(replay(signature, edits, state)):
                    of.append(i)
                    rows.append((n, *step))
            own = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(3)), *own], names=["c", "part", "seq", "ord", "off", "new_role", "edit"])

    cols = chosen.select("c", "part", "seq", "signature", "state", "edits")
    return cols.mapInArrow(run, "c string, part int, seq long, ord int, off int, new_role string, edit string")


@dataclass
class Repaired:
    """``rows``: c, part, seq, ord (their order), role, text and edit of the repaired conversations; ``summary``: a row a conversation with rows."""

    rows: DataFrame
    summary: DataFrame


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> Repaired:
    """The cheapest edits of the conversations in ``rows`` (conv, turn, role, text), and what they make of them.

    Rows are taken by turn, nulls first, those of one turn by role and then by a hash of role and text. Null conversations are
    one, null roles and texts one space. A role without letters has an initial that no grammar takes. Repeated rows are duplicates of the first. No rows give none.
    The summary has c, conv, counts of blank, duplicate, truncated and illegal, gaps, cost and audit.
    """
    marked = materialize(faults(rows), "marked")
    placed = places(marked, piece_rows, piece_bytes)
    strings = F.array_sort(F.collect_list(F.struct("off", "symbol", "initial")))  # at most ``piece_rows``
    joined = lambda name: F.array_join(F.transform("s", lambda x: x[name]), "")
    pieces = placed.groupBy("c", "part", "seq").agg(strings.alias("s")).select("c", "part", "seq", joined("symbol").alias("signature"), joined("initial").alias("initials"))
    pieces = materialize(pieces, "pieces")
    chosen = materialize(chained(pieces.join(solutions(pieces), "signature")), "chosen")
    acts = materialize(_replayed(chosen.where("part IS NOT NULL")), "acts")
    own = acts.where("off IS NOT NULL").join(placed.select("c", "part", "seq", "off", "row"), ["c", "part", "seq", "off"]).join(marked.select("row", "role", "text"), "row")
    own = own.select("c", "part", "seq", "ord", F.coalesce("new_role", "role").alias("role"), "text", "edit")
    fresh = acts.where("off IS NULL").select("c", "part", "seq", "ord", F.col("new_role").alias("role"), F.lit("").alias("text"), "edit")
    count = lambda kind: F.sum(F.when(F.col("fault") == kind, 1).otherwise(0))
    turns = marked.groupBy("c", "turn").agg(F.first("conv").alias("conv"), *[count(k).alias(k) for k in ("blank", "duplicate", "truncated")])
    wide = F.col("turn").cast("decimal(20,0)")
    gaps = F.coalesce(F.max(wide) - F.min(wide) + 1 - F.count("turn"), F.lit(0)).cast("long")
    stats = turns.groupBy("c").agg(F.first("conv").alias("conv"), gaps.alias("gaps"), *[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")])
    ends = chosen.where("part IS NULL").select("c", "illegal", "cost", F.col("edits").alias("audit"))
    return Repaired(own.unionByName(fresh), stats.join(ends, "c"))


def digests(rows: DataFrame) -> DataFrame:
    """(c, sha256) of the repaired ``role:text``, joined by line feeds.

    Pieces become one text each where they lie; a digest by its definition reads its texts in order, so that those of
    a conversation then stream through one task, which holds one piece at a time.
    """
    line = F.concat(F.col("role"), F.lit(":"), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    texts = rows.groupBy("c", "part", "seq").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
    ordered = texts.repartition("c").sortWithinPartitions("c", "part", "seq").select("c", "text")

    def run(batches):
        name, h = None, hashlib.sha256()
        for b in batches:
            out = []
            for c, text in zip(b.column(0).to_pylist(), b.column(1)):
                if c != name:
                    if name is not None:
                        out.append((name, h.hexdigest()))
                    name, h = c, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(text.as_buffer())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], names=["c", "sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([h.hexdigest()], pa.string())], names=["c", "sha256"])

    return ordered.mapInArrow(run, "c string, sha256 string")


def audit(rows: DataFrame, conv_col: str = "conv_id", piece_rows: int = PIECE_ROWS, **columns: str) -> DataFrame:
    """A row for each conversation of ``rows`` after `damage`, also for those that lose all rows; nulls, ties and repeats as in `repair`."""
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{conv_col}`").cast("string")), F.lit("")).alias("c")
    every = rows.groupBy(name).agg(F.first(f"`{conv_col}`").alias("conv_id"))
    fixed = repair(damage(rows, conv_col, **columns), piece_rows)
    whole = every.join(fixed.summary.drop("conv"), "c", "left").join(digests(fixed.rows), "c", "left")
    numbers = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
