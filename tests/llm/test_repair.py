import random
from hashlib import sha256
from itertools import product
from zlib import crc32

import duckdb
import pyarrow as pa
import pytest

from mailspark.llm.oracles import ORACLES
from mailspark.llm.repair import (
    SEGMENT, _Fold, chosen_edits, damaged, faulty_turns, repair_report, repaired_turns, segment_moves, segments,
)

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SYMBOLS = "suaSUA-?!"


def search(turns):
    """Cheapest, least audit by a search over the states of the grammar, turn by turn."""
    edges = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {0: (0, "")}
    for symbol in turns:
        ways, found = [(state, *way, 0) for state, way in best.items()], {}
        for state, cost, audit, inserted in ways:
            if inserted < 3:
                ways += [(q, cost + 3, audit + "I", inserted + 1) for c, q in edges[state].items() if c != "s"]
            nexts = [(state, cost + 4, audit + "D")]
            if symbol != "-":
                cut = 3 if symbol in "SUA!" else 0
                nexts += [(q, cost + cut, audit + "K") for c, q in edges[state].items() if c == symbol.lower()]
                nexts += [(q, cost + cut + 3, audit + "R") for c, q in edges[state].items() if c != "s"]
            for q, *way in nexts:
                found[q] = min(found.get(q, tuple(way)), tuple(way))
        best = found
    tails = {0: (0, ""), 1: (6, "II"), 2: (3, "I"), 3: (0, "")}
    return min((cost + tails[q][0], audit + tails[q][1]) for q, (cost, audit) in best.items())


def folded(turns, size):
    fold = _Fold()
    for at in range(0, len(turns), size):
        part = turns[at:at + size]
        moves = [{"start": p, "end": q, "cost": c, "audit": a}
                 for p in ((0,) if at == 0 else range(4)) for q, c, a in segment_moves(part, p)]
        stays = [{"turn": 0, "h0": 0, "h1": 0} for symbol in part if symbol != "-"]
        fold.add({"conv_id": 0, "slice": 0, "seq": at, "turns": part, "front": "u", "back": "a", "illegal": 0, "stays": stays, "moves": moves})
    last = list(fold.chosen())[-1]
    return last["cost"], last["audit"]


def test_alignment_is_the_cheapest_and_least_of_all():
    for length in (1, 2, 3):
        for turns in map("".join, product(SYMBOLS, repeat=length)):
            assert folded(turns, SEGMENT) == search(turns), turns


@pytest.mark.parametrize("size", [1, 3, SEGMENT])
def test_segments_do_not_change_the_audit(size):
    rng = random.Random(size)
    for _ in range(60):
        turns = "".join(rng.choice("uauauauau" + SYMBOLS) for _ in range(rng.randint(2, 60)))
        assert folded(turns, size) == search(turns), turns


def report(spark, rows, extra=""):
    table = spark.createDataFrame(rows, SCHEMA + extra)
    return sorted(map(tuple, repair_report(damaged(table), table).collect()), key=repr)


def by_sql(rows):
    db = duckdb.connect()
    columns = list(zip(*[r[:4] for r in rows])) if rows else [[], [], [], []]
    conversations = pa.table({
        "conv_id": pa.array(columns[0], pa.int64()), "turn": pa.array(columns[1], pa.int64()),
        "role": pa.array(columns[2], pa.string()), "text": pa.array(columns[3], pa.string())})
    db.register("conversations", conversations)
    return sorted(db.sql(ORACLES["op13_conversation_repair"]).fetchall(), key=repr)


def test_nulls_ties_repeats_and_odd_roles(spark):
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "tool", "User", "", None, "s", "anyone"]
    texts = ["Yes.", "No", " ", "", None, "What?\n", "é", "One. two", "\x0bEnd!\t", "a:b\nc."]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, t, rng.choice(roles[:3]), f"{t}.") for t in range(6)]
    rows += [(70, None, "user", "Null first."), (70, None, "assistant", "Then."), (70, -5, "user", "x."), (71, None, None, None)]
    rows += [(72, 3, "user", "same."), (72, 3, "user", "same."), (72, 3, "assistant", "same."), (72, 9, "user", "same.")]
    got = report(spark, rows)
    assert got == by_sql(rows)
    assert len(got) == 64 and any(r[7] for r in got)


def test_a_conversation_without_rows_after_damage(spark):
    lost = [n for n in range(1000) if crc32(f"{n}:0".encode()) % 20 == 0][:2]
    assert report(spark, [(n, 0, "user", "x.") for n in lost]) == [(n, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest()) for n in lost]


def test_empty_table_and_other_columns(spark):
    assert report(spark, []) == []
    extra = ", h0 string, copies string, stays string, edits string, place string, first string, slice string, `of` string, own string, kind string"
    rows = [(1, t, "ua"[t % 2], f"{t}.") for t in range(6)]
    assert report(spark, [(*r, *["x"] * 10) for r in rows], extra) == by_sql(rows)


def test_a_long_conversation_over_many_tasks(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]) if t % 9 == 0 else ("user", "assistant")[t % 2], f"turn {t % 150}.") for t in range(400)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"{c} {t}?") for c in range(2, 40) for t in range(4)]
    assert report(spark, rows) == by_sql(rows)
    table = spark.createDataFrame(rows, SCHEMA)
    parts = segments(faulty_turns(table)).where("conv_id = 1")
    assert parts.select("slice").distinct().count() > 1
    assert max(len(r["turns"]) for r in parts.collect()) <= SEGMENT


def test_very_many_copies_of_one_turn(spark):
    rows = [(1, 0, "user", "again.")] * 3000 + [(1, 1, "assistant", "yes.")]
    table = spark.createDataFrame(rows, SCHEMA)
    turns = faulty_turns(table)
    assert turns.count() == 2
    edits = chosen_edits(segments(turns))
    audit = edits.where("audit IS NOT NULL").collect()[0]
    assert audit["audit"] == "K" + "D" * 2999 + "K" and audit["cost"] == 4 * 2999
    kept = repaired_turns(table, edits).orderBy("slice", "seq", "place").select("role", "text").collect()
    assert [tuple(r) for r in kept] == [("user", "again."), ("assistant", "yes.")]


def test_a_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", " " * 500_000 + "no end"), (1, 2, "user", "." + " " * 500_000)]
    assert report(spark, rows) == by_sql(rows)
