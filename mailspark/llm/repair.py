"""Conversation repair by alignment to the alternating grammar.

A conversation reads well if its role initials are ``(s?(ua)+)?``: perhaps a system turn,
then user and assistant in turns. ``repaired`` finds the cheapest edits that get there:
Keep (0), Rerole to user or assistant (3), Delete (4) and Insert an empty user or
assistant turn (3); a truncated turn that is not deleted costs 3 more, and blank turns
and repetitions must be deleted. Of equally cheap edits the audit, the initials of the
edits in order, is the ASCII-least.

**Alignment.** For one target string of the grammar this is Wagner-Fischer. All feasible
lengths of the target are tried, nearest first; Ukkonen bands leave out the cells that
cannot come below the incumbent cost, which starts as the cost of keeping or reroling
all turns that may stay. The audits of equally cheap lengths are backtraced and compared.

**Long conversations.** Rows are range-partitioned by conversation and turn, so that a
conversation may span many tasks, and cut into segments of at most ``SEGMENT`` turns. A
segment is aligned for every state of the grammar it can start in (nothing yet, after s,
after u, after a) to every state it can end in; segments of equal signature are aligned
once per task. An insert belongs to the segment of the turn after it, so of one segment's
audits none is the beginning of another, and the cheapest, least audits of the segments
can be put together one after the other, with costs and ranks alone.

Cases: a null conv_id is a conversation; a null turn comes first; a null role or text is
one space, so a null text is blank and a null role fits nowhere. Rows with one turn are
ordered by role and a hash of the text. Repeated rows are repetitions, also of one turn;
equal rows of a turn are counted before any shuffle. Texts may have any length, and only
role and text of turns that stay are read again. Empty tables give empty results, columns
other than the four are not read. What cannot be spread is a digest over a whole
conversation, which is a stream in the order of its turns (``digests``, in constant memory),
and its audit, one character per turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailspark.session import stored

SEGMENT = 32
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# States of the grammar: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_NONE = 1 << 60
_BLANKS = " \t\n\x0b\x0c\r"


# Alignment of one segment

def _targets(start: int, length: int) -> list[tuple[str, int]]:
    """The strings of a length that the grammar goes on with, and where they end."""
    if length == 0:
        return [("", start)]
    if start == START:
        plain = ("ua" * length)[:length]
        with_s = "s" + ("ua" * length)[:length - 1]
        end = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}
        return [(t, end[t[-1]]) for t in (plain, with_s)]
    turn = "au" if start == AFTER_U else "ua"
    out = (turn * length)[:length]
    return [(out, AFTER_U if out[-1] == "u" else AFTER_A)]


def _fit(symbol: str, target: str) -> int:
    """Cost of a turn as one character of the target. Symbols are role initials, upper
    case if truncated, ``-`` for a turn that must go and ``?`` or ``!`` for other roles."""
    if symbol == "-":
        return _NONE
    cut = TRUNCATED if symbol in "SUA!" else 0
    if symbol.lower() == target:
        return KEEP + cut
    return REROLE + cut if target != "s" else _NONE


def _align(turns: str, target: str, incumbent: int) -> tuple[int, str] | None:
    """Cheapest and least audit that makes ``target`` of ``turns`` and ends with a turn,
    or None if it costs more than the incumbent."""
    n, m = len(turns), len(target)
    stays = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        stays[i] = stays[i + 1] + (turns[i] != "-")
    # What every alignment pays: lost turns, and 3 for a truncated one either way, after
    # which deleting it costs 1 more.
    cut = sum(c in "SUA!" for c in turns)
    base = DELETE * (n - stays[0]) + TRUNCATED * cut
    drop = DELETE - TRUNCATED if cut else DELETE

    def apart(turns_: int, chars: int) -> int:
        return INSERT * (chars - turns_) if chars > turns_ else drop * (turns_ - chars)

    if base + apart(stays[0], m) > incumbent:
        return None
    # Cost to go, from the last turn back; after the last turn nothing is inserted.
    table: list[dict[int, int]] = [{} for _ in range(n + 1)]
    table[n] = {m: 0}
    for i in range(n - 1, -1, -1):
        below, row = table[i + 1], table[i]
        used = stays[0] - stays[i]
        delete = DELETE
        for j in range(m, -1, -1):
            if base + apart(used, j) + apart(stays[i], m - j) > incumbent:
                continue
            cost = below.get(j, _NONE) + delete
            if j < m:
                cost = min(cost, below.get(j + 1, _NONE) + _fit(turns[i], target[j]))
                if target[j] != "s":
                    cost = min(cost, row.get(j + 1, _NONE) + INSERT)
            if cost < _NONE:
                row[j] = cost
    total = table[0].get(0, _NONE)
    if total >= _NONE or total > incumbent:
        return None
    audit, i, j = [], 0, 0
    while i < n:
        left = table[i][j]
        if table[i + 1].get(j, _NONE) + DELETE == left:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and table[i].get(j + 1, _NONE) + INSERT == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return total, "".join(audit)


def _ends(turns: str, start: int) -> list[int]:
    """States that a segment can end in."""
    if start in (AFTER_U, AFTER_A):
        return [AFTER_U, AFTER_A]
    after_s = start == AFTER_S or "s" in turns.lower()
    return [start, *([AFTER_S] if start == START and after_s else []), AFTER_U, AFTER_A]


@lru_cache(maxsize=1 << 14)
def segment_moves(turns: str, start: int) -> tuple[tuple[int, int, str], ...]:
    """``(end, cost, audit)``: the cheapest and least audit to every end of a segment."""
    stay = sum(c != "-" for c in turns)
    cut = sum(c in "SUA!" for c in turns)
    base = DELETE * (len(turns) - stay) + TRUNCATED * cut
    step_cost = min(INSERT, DELETE - TRUNCATED if cut else DELETE)

    def straight(target: str) -> int:
        place = iter(target)
        return min(_NONE, sum(DELETE if c == "-" else _fit(c, next(place)) for c in turns))

    incumbent = {end: _NONE for end in _ends(turns, start)}
    for target, end in _targets(start, stay):
        if end in incumbent:
            incumbent[end] = straight(target)
    best: dict[int, tuple[int, str]] = {}
    # Lengths further and further from the number of turns that may stay.
    apart = 0
    while base + step_cost * apart <= max(incumbent.values()):
        for length in {max(stay - apart, 0), stay + apart}:
            for target, end in _targets(start, length):
                found = _align(turns, target, incumbent[end]) if end in incumbent else None
                if found is not None and (end not in best or found < best[end]):
                    best[end] = found
                    incumbent[end] = found[0]
        apart += 1
    return tuple((end, *found) for end, found in sorted(best.items()))


# Turns and segments

def _spaced(rows: DataFrame) -> DataFrame:
    """The four columns; a null role or text is one space."""
    blank = F.lit(" ")
    return rows.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"h0": F.xxhash64("role", "text"), "h1": F.xxhash64(F.lit("turn"), "role", "text")})


def faulty_turns(rows: DataFrame) -> DataFrame:
    """One narrow row per different turn of a conversation, with its ``copies`` and
    faults: ``blank``, ``first`` (not seen earlier) and ``cut`` (truncated)."""
    ending = F.rtrim("text", F.lit(_BLANKS))
    turns = _hashed(_spaced(rows)).select(
        "conv_id", "turn", "role", "h0", "h1", (ending == "").alias("blank"),
        (~F.right(ending, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    turns = turns.groupBy(*turns.columns).agg(F.count("*").alias("copies"))
    turns = stored(turns, "turns")
    seen = turns.groupBy("conv_id", "h0", "h1").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("earliest"))
    seen = seen.select(F.col("conv_id").alias("of"), F.col("h0").alias("of0"), F.col("h1").alias("of1"), F.col("earliest.turn").alias("earliest"))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("h0") == F.col("of0")) & (F.col("h1") == F.col("of1"))
    joined = turns.join(seen, same).withColumn("first", F.col("turn").eqNullSafe(F.col("earliest")))
    return joined.select(*turns.columns, "first")


_MOVES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_STAYS = pa.list_(pa.struct([("turn", pa.int64()), ("h0", pa.int64()), ("h1", pa.int64())]))
_SEGMENT = pa.schema([
    ("conv_id", pa.int64()), ("slice", pa.int32()), ("seq", pa.int64()), ("turns", pa.string()), ("front", pa.string()),
    ("back", pa.string()), ("illegal", pa.int64()), ("stays", _STAYS), ("moves", _MOVES),
])
_SEGMENT_DDL = (
    "conv_id bigint, slice int, seq bigint, turns string, front string, back string, illegal bigint, "
    "stays array<struct<turn: bigint, h0: bigint, h1: bigint>>, "
    "moves array<struct<start: int, `end`: int, cost: bigint, audit: string>>")
_LEGAL = {"su", "ua", "au"}


class _Segment:
    """Turns of one conversation that follow each other in one task."""

    def __init__(self, conv, first: bool):
        self.conv, self.first = conv, first
        self.turns, self.initials, self.stays = [], [], []

    def add(self, symbol: str, initial: str, stay: dict | None) -> None:
        self.turns.append(symbol)
        self.initials.append(initial)
        if stay is not None:
            self.stays.append(stay)

    def row(self, slice_: int, seq: int) -> dict:
        turns = "".join(self.turns)
        starts = (START,) if self.first else (START, AFTER_S, AFTER_U, AFTER_A)
        moves = [{"start": p, "end": q, "cost": c, "audit": a} for p in starts for q, c, a in segment_moves(turns, p)]
        illegal = sum(x + y not in _LEGAL for x, y in zip(self.initials, self.initials[1:]))
        return {"conv_id": self.conv, "slice": slice_, "seq": seq, "turns": turns, "front": self.initials[0],
                "back": self.initials[-1], "illegal": illegal, "stays": self.stays, "moves": moves}


def _symbol(initial: str, cut: bool) -> str:
    if initial not in ("s", "u", "a"):
        return "!" if cut else "?"
    return initial.upper() if cut else initial


def segments(turns: DataFrame) -> DataFrame:
    """Conversations in segments of at most ``SEGMENT`` turns, with the moves of each.

    Written down, since a second evaluation could draw other range bounds.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Segment]]:
        open_: _Segment | None = None
        for batch in batches:
            for row in batch.to_pylist():
                if open_ is None:
                    # Where the task begins, the conversation may have begun before.
                    open_, slice_ = _Segment(row["conv_id"], row["slice"] == 0), row["slice"]
                elif open_.conv != row["conv_id"]:
                    yield slice_, open_
                    open_ = _Segment(row["conv_id"], True)
                initial = row["role"][:1]
                stays = row["first"] and not row["blank"]
                for copy in range(row["copies"]):
                    if len(open_.turns) == SEGMENT:
                        yield slice_, open_
                        open_ = _Segment(row["conv_id"], False)
                    if copy == 0 and stays:
                        open_.add(_symbol(initial, row["cut"]), initial, {k: row[k] for k in ("turn", "h0", "h1")})
                    else:
                        open_.add("-", initial, None)
        if open_ is not None:
            yield slice_, open_

    def run(batches):
        held = []
        for seq, (slice_, segment) in enumerate(cut(batches)):
            held.append(segment.row(slice_, seq))
            if len(held) == 256:
                yield pa.RecordBatch.from_pylist(held, _SEGMENT)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, _SEGMENT)

    order = ["conv_id", "turn", "role", "h0", "h1"]
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    columns = [*order, "blank", "cut", "copies", "first"]
    dealt = dealt.select(*columns, F.spark_partition_id().alias("slice"))
    return stored(dealt.mapInArrow(run, _SEGMENT_DDL), "segments")


# Putting segments together

_TAIL = {START: (0, ""), AFTER_S: (6, "II"), AFTER_U: (3, "I"), AFTER_A: (0, "")}
_EDITS = pa.list_(pa.struct([
    ("place", pa.int32()), ("role", pa.string()), ("turn", pa.int64()), ("h0", pa.int64()), ("h1", pa.int64()), ("old", pa.bool_())]))
_CHOSEN = pa.schema([
    ("conv_id", pa.int64()), ("slice", pa.int32()), ("seq", pa.int64()), ("cost", pa.int64()), ("illegal", pa.int64()),
    ("audit", pa.string()), ("edits", _EDITS),
])
_CHOSEN_DDL = (
    "conv_id bigint, slice int, seq bigint, cost bigint, illegal bigint, audit string, "
    "edits array<struct<place: int, role: string, turn: bigint, h0: bigint, h1: bigint, old: boolean>>")


def _edits(state: int, audit: str, stays: list[dict], turns: str) -> list[dict]:
    """The turns that an audit leaves; ``role`` is null where the turn keeps its own."""
    out, left, symbols = [], iter(stays), iter(turns)
    for edit in audit:
        if edit == "D":
            if next(symbols) != "-":
                next(left)
            continue
        role = "assistant" if state == AFTER_U else "user"
        place = {"place": len(out), "role": role, "turn": None, "h0": None, "h1": None, "old": False}
        system = False
        if edit != "I":
            system = next(symbols).lower() == "s" and edit == "K"
            place |= next(left) | {"old": True}
        if edit == "K":
            place["role"] = None
        state = AFTER_S if system else AFTER_A if state == AFTER_U else AFTER_U
        out.append(place)
    return out


class _Fold:
    """The cheapest and least audit of a conversation, segment by segment."""

    def __init__(self):
        # State to cost and rank; ranks order the audits so far.
        self.states = {START: (0, 0)}
        self.back: list[dict[int, tuple[int, str]]] = []
        self.rows: list[dict] = []
        self.illegal, self.last = 0, None

    def add(self, row: dict) -> None:
        found: dict[int, tuple[int, int, str, int]] = {}
        for move in row["moves"]:
            if move["start"] in self.states:
                cost, rank = self.states[move["start"]]
                way = (cost + move["cost"], rank, move["audit"], move["start"])
                found[move["end"]] = min(found.get(move["end"], way), way)
        order = sorted(found, key=lambda q: found[q][1:3])
        self.states = {q: (found[q][0], order.index(q)) for q in found}
        self.back.append({q: (way[3], way[2]) for q, way in found.items()})
        self.illegal += row["illegal"] + (self.last is not None and self.last + row["front"] not in _LEGAL)
        self.last = row["back"]
        self.rows.append({k: row[k] for k in ("conv_id", "slice", "seq", "turns", "stays")})

    def chosen(self) -> Iterator[dict]:
        cost, _, end = min((cost + _TAIL[q][0], rank, q) for q, (cost, rank) in self.states.items())
        pieces, state = [], end
        for back in reversed(self.back):
            state, piece = back[state]
            pieces.append((state, piece))
        pieces.reverse()
        pieces[-1] = (pieces[-1][0], pieces[-1][1] + _TAIL[end][1])
        whole = "".join(piece for _, piece in pieces)
        for at, (row, (state, piece)) in enumerate(zip(self.rows, pieces)):
            last = at == len(pieces) - 1
            yield {k: row[k] for k in ("conv_id", "slice", "seq")} | {
                "cost": cost, "illegal": self.illegal, "audit": whole if last else None,
                "edits": _edits(state, piece, row["stays"], row["turns"])}


def chosen_edits(parts: DataFrame) -> DataFrame:
    """Per segment the edits that were chosen; on the last of a conversation also its
    ``audit``, ``cost`` and ``illegal`` neighbours."""
    def run(batches):
        held, fold, conv = [], None, None
        for batch in batches:
            for row in batch.to_pylist():
                if fold is None or conv != row["conv_id"]:
                    if fold is not None:
                        held.extend(fold.chosen())
                    fold, conv = _Fold(), row["conv_id"]
                fold.add(row)
                if len(held) >= 256:
                    yield pa.RecordBatch.from_pylist(held, _CHOSEN)
                    held = []
        if fold is not None:
            held.extend(fold.chosen())
        for at in range(0, len(held), 256):
            yield pa.RecordBatch.from_pylist(held[at:at + 256], _CHOSEN)

    order = ["conv_id", "slice", "seq"]
    return stored(parts.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, _CHOSEN_DDL), "edits")


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``conv_id, slice, seq, place, role, text`` of the repaired conversations; a
    conversation is its rows in the order of slice, seq and place."""
    keys = ["conv_id", "turn", "h0", "h1"]
    places = edits.select("conv_id", "slice", "seq", F.inline("edits"))
    texts = _hashed(_spaced(rows)).where(F.trim("text", F.lit(_BLANKS)) != "")
    texts = texts.groupBy(*keys).agg(F.first("role").alias("own"), F.first("text").alias("text"))
    texts = texts.select(*[F.col(k).alias(f"of_{k}") for k in keys], "own", "text")
    same = None
    for k in keys:
        equal = F.col(k).eqNullSafe(F.col(f"of_{k}"))
        same = equal if same is None else same & equal
    old = places.where("old").join(texts, same).select(
        "conv_id", "slice", "seq", "place", F.coalesce("role", "own").alias("role"), "text")
    new = places.where("NOT old").select("conv_id", "slice", "seq", "place", "role", F.lit("").alias("text"))
    return old.unionByName(new)


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` over ``role:text``, joined by newlines, as a stream."""
    names = ["conv_id", "repaired_sha256"]

    def run(batches):
        def out(conv, state):
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()])], names)

        state, conv = None, None
        for batch in batches:
            for one, role, text in zip(batch.column(0), batch.column(4), batch.column(5)):
                if state is None or conv != one.as_py():
                    if state is not None:
                        yield out(conv, state)
                    state, conv = sha256(), one.as_py()
                else:
                    state.update(b"\n")
                state.update(f"{role.as_py()}:{text.as_py()}".encode())
        if state is not None:
            yield out(conv, state)

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "slice", "seq", "place")
    return dealt.mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with the faults that the query plants, by a checksum of the place."""
    rows = _spaced(conversations)
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(place) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnRenamed("conv_id", "of")
    return left.join(right, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")


def repair_report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` of every conversation in ``conversations``, of which ``rows`` are
    the turns to repair."""
    turns = stored(faulty_turns(rows), "faults")
    edits = chosen_edits(segments(turns))
    many, one, none = F.col("copies"), F.lit(1), F.lit(0)
    fresh = F.col("first") & ~F.col("blank")
    counts = turns.groupBy("conv_id").agg(
        F.sum(F.when(F.col("blank"), many).otherwise(none)).alias("blank"),
        F.sum(F.when(F.col("blank"), none).when(F.col("first"), many - one).otherwise(many)).alias("duplicate"),
        F.sum(F.when(fresh & F.col("cut"), one).otherwise(none)).alias("truncated"),
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    found = edits.where("audit IS NOT NULL").select("conv_id", "illegal", "cost", "audit")
    sums = digests(repaired_turns(rows, edits))
    all_ = conversations.select(F.col("conv_id").cast("bigint")).distinct()
    joined = _beside(_beside(_beside(all_, counts), found), sums)
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = sha256(b"").hexdigest()
    return joined.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
