"""Repair of conversations against an exhaustive search and a plain pass over whole conversations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from trackweave.llm import dialogues

GRAMMAR = re.compile("(s?(ua)+)?")
GAPS = ["", "u", "a", "uu", "ua", "au", "aa"]


def searched(signature):
    """Every choice for every row and every gap."""
    best = None
    choices = [[("D", "", 3)] + ([] if x == "x" else [("K", x.lower(), x.isupper()), ("R", "u", 2 + x.isupper()), ("R", "a", 2 + x.isupper())]) for x in signature]
    for rows in itertools.product(*choices):
        for gaps in itertools.product(GAPS, repeat=len(signature) + 1):
            roles = gaps[0] + "".join(r[1] + g for r, g in zip(rows, gaps[1:]))
            if GRAMMAR.fullmatch(roles):
                cost = sum(r[2] for r in rows) + 2 * sum(map(len, gaps))
                edits = "I" * len(gaps[0]) + "".join(r[0] + "I" * len(g) for r, g in zip(rows, gaps[1:]))
                best = min(best or (cost, edits), (cost, edits))
    return best


def whole(signature):
    table = dialogues.solve(signature)[dialogues.START]
    return min(table[q] for q in (dialogues.START, dialogues.AFTER_A) if q in table)


def test_solutions_are_the_cheapest_and_least():
    symbols = "xsuaoSUAO"
    cases = ["", *symbols, *map("".join, itertools.product(symbols, repeat=2))]
    random.seed(1)
    for s in cases + ["".join(random.choice(symbols) for _ in range(3)) for _ in range(12)]:
        assert whole(s) == searched(s), s


def test_pieces_chained_equal_the_whole():
    random.seed(2)
    for _ in range(400):
        s = "".join(random.choice("xsuaoSUAOuaua") for _ in range(random.randint(0, 40)))
        chain, at, steps = dialogues.Chain(), 0, []
        while at < len(s):
            n = random.randint(1, 6)
            steps += list(chain.add((0, at, s[at : at + n]), dialogues.solve(s[at : at + n])))
            at += n
        cost, edits, rest = chain.end()
        assert (cost, edits) == whole(s)
        assert "".join(x[2] for x in steps + rest) == edits


ROWS = [
    (1, 0, "user", "Hi there."), (1, 1, "assistant", "Hello!"), (1, 2, "user", "cut off"), (1, 3, "assistant", "Fine. \n"), (1, 4, "assistant", "Fine. \n"),
    (2, None, "system", "Rules."), (2, None, None, None), (2, 7, "tool", "x."), (2, 9, "user", ""), (2, 9, "user", "\x1c"), (2, 12, "", "e?"),
    (None, 1, "user", "No id."), (None, None, "assistant", "Nor a turn."), (3, 5, "assistant", "a" * 300_000 + "."), (4, 1, None, "\t\n"),
    (5, 1, "User", "Case?"), (5, 2, "assistant", "Same."), (5, 3, "user", "Case?"), (5, 4, "assistant", "Same."), (5, 4, "assistant", "Same."),
]


def rows_of(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(c + 10_000 * k if c is not None else None, t, r, x) for k in range(1, 6) for c, t, r, x in ROWS]
    random.seed(5)
    return rows + [(99, t, random.choice(["user", "assistant", "system", "x"]), random.choice(["One.", "Two", "Three!", "", f"T{t}."])) for t in range(500)]


def plain(rows):
    """The contract, conversation by conversation; ties within a turn as `repair` states them."""
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t, " " if role is None else role, " " if text is None else text))
    out = {}
    for c, own in convs.items():
        after = []
        for t, role, text in own:
            way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            if way:
                row = (t, "user" if way == 4 else role, "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text)
                after += [row, row] if way == 3 else [row]
        key = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), key(r)))
        seen, symbols, count = set(), "", defaultdict(int)
        initials = [r[1][:1] if r[1][:1] in ("s", "u", "a") else "o" for r in after]
        for (_, role, text), i in zip(after, initials):
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            symbols += "x" if fault in ("blank", "duplicate") else i.upper() if fault else i
        cost, edits = whole(symbols)
        lines, row = [], 0
        roles = ""
        for e in edits:
            if e in "RI":
                role = "assistant" if roles[-1:] == "u" else "user"
                lines.append(f"{role}:{after[row][2] if e == 'R' else ''}")
                roles += role[0]
            elif e == "K":
                lines.append(f"{after[row][1]}:{after[row][2]}")
                roles += after[row][1][0]
            row += e != "I"
        turns = [r[0] for r in after if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        assert GRAMMAR.fullmatch(roles)
        out[c] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("piece_rows", [dialogues.PIECE_ROWS, 2])
def test_audit_of_whole_tables(spark, sf_dir, piece_rows):
    rows = rows_of(spark, sf_dir)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, row string, cost int").repartition(5)
    got = dialogues.audit(df, piece_rows=piece_rows).collect()
    want = plain(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogues.audit(df).collect() == []
    lost = spark.createDataFrame([(c, t, "user", "x.") for c in range(40) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0], "conv_id long, turn long, role string, text string")
    rows = dialogues.audit(lost).collect()
    assert rows and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows)


def test_sql_of_odd_rows(spark, sf_dir):
    """The SQL gives what the plain pass gives."""
    import duckdb
    import pandas as pd

    from trackweave.llm.queries import OP11_SQL

    rows = rows_of(spark, sf_dir)
    con = duckdb.connect()
    con.register("t", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.sql("CREATE VIEW conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM t")
    got = {r[0]: tuple(r[1:]) for r in con.sql(OP11_SQL).fetchall()}
    want = plain([r for r in rows if r[0] != 99])
    assert all(got[c] == want[c] for c in want)
