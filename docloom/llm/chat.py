"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system message, then user and assistant in turns, ending with the assistant. Each
turn of a conversation may be kept (0), given another role (3, or 1 if its role is unknown), merged into the message
before it (1, and the price of another role if they differ), and empty messages may be inserted before it (2 each). A
dynamic programme over the automaton's states (start, after system, after user, after assistant) finds the cheapest
repair; of equally cheap ones it prefers keeping to merging, merging to inserting, inserting to relabelling, at the
latest turn where they differ. The repaired sequence is rendered in pieces: each turn's `fragment` closes the message before it,
opens what is inserted and its own, and the fragments of a conversation in order are its transcript.

Long conversations. Rows are range-partitioned by (conv_id, turn, role, text), so one conversation may lie in many
partitions, and cut into segments of at most SEGMENT turns. Segments of one conversation are joined by matrices from
state to state: the least cost, and, for each last state, which first state is preferred among equally cheap ones (32
numbers a segment). That order is the one the tie rule gives, whatever was paid before the segment, so the product of the
matrices gives each segment the very first and last state that the uncut repair has; then all segments are repaired on
their own. The repair does not depend on where a conversation is cut. No task holds a conversation's texts.

Defined results: turns are ordered by turn (null first), role and text, so repeated rows stay and ties are settled; `place`
numbers them from 0 in each conversation. `inserted` names the empty messages before a turn, `inserted_after` those after
the last turn. A null or unknown role is unknown; roles are compared in lower case without surrounding blanks. A null text
is empty. Rows with a null conv_id are one conversation. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, slices

ROLES = ("", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
KNOWN = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
MERGE, INSERT, RELABEL, GUESS = 1, 2, 3, 1
SEGMENT = 512
FAR = 1 << 40

#: Messages that must be inserted after a state so that the role may follow; absent where the role can't follow.
INSERTS = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, USER): (ASSISTANT,), (USER, ASSISTANT): (),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: Messages that must be inserted at the end.
ENDING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _moves() -> dict[int, list[list[tuple[int, int, str, tuple[int, ...]]]]]:
    """For each given role (0: unknown) and state after: (cost, state before, operation, inserted), the preferred first."""
    out = {}
    for given in range(4):
        price = lambda role: 0 if role == given else RELABEL if given else GUESS  # noqa: B023, E731
        into: list[list[tuple[int, int, str, tuple[int, ...]]]] = [[] for _ in ROLES]
        for (before, role), inserted in INSERTS.items():
            name = "keep" if role == given else "relabel"
            into[role].append((price(role) + INSERT * len(inserted), before, name, inserted))
        for state in (SYSTEM, USER, ASSISTANT):
            into[state].append((MERGE + price(state), state, "merge" if state == given else "relabel+merge", ()))
        rank = lambda m: (m[0], m[2] != "keep" or bool(m[3]), m[2] != "merge", m[2] != "keep", m[2], m[1])
        out[given] = [sorted(ways, key=rank) for ways in into]
    return out


MOVES = _moves()


def role_of(role: str | None) -> int:
    return KNOWN.get((role or "").strip().lower(), 0)


def advance(costs: list[int], given: int) -> tuple[list[int], list[tuple[int, int, str, tuple[int, ...]] | None]]:
    """Costs of the states after one turn, and the move that each is reached by."""
    after, moves = [FAR] * 4, [None] * 4
    for state in (SYSTEM, USER, ASSISTANT):
        for move in MOVES[given][state]:
            total = costs[move[1]] + move[0]
            if total < after[state]:
                after[state], moves[state] = total, move
    return after, moves


def segment_matrix(roles: list[int]) -> list[int]:
    """Costs from each state to each, row by row, then the places of the first states for each last state, row by row.

    A first state's place says how the tie rule orders it among the four: by the last move on its way, then by the place
    that the state before that move had. Ways from two first states never share all moves, so places differ where both
    reach the last state.
    """
    costs = [[0 if s == first else FAR for s in range(4)] for first in range(4)]
    places = [[first for _ in range(4)] for first in range(4)]
    for given in roles:
        after, order = [[FAR] * 4 for _ in range(4)], [[0] * 4 for _ in range(4)]
        for state in (SYSTEM, USER, ASSISTANT):
            ways = []
            for first in range(4):
                total, i = min((min(costs[first][move[1]] + move[0], FAR), i) for i, move in enumerate(MOVES[given][state]))
                after[first][state] = total
                ways.append((total >= FAR, i, places[first][MOVES[given][state][i][1]], first))
            for place, way in enumerate(sorted(ways)):
                order[way[3]][state] = place
        costs, places = after, order
    return [x for row in costs for x in row] + [x for row in places for x in row]


def best_end(costs: list[int]) -> int:
    """The cheapest last state, counting what must be inserted; the assistant first among equals."""
    return min((ASSISTANT, USER, SYSTEM, START), key=lambda s: (costs[s] + INSERT * len(ENDING[s]), s != ASSISTANT, s))


def repair(roles: list[int], first: int = START, last: int | None = None) -> list[tuple[int, str, tuple[int, ...]]]:
    """(role, operation, inserted before) of each turn, from state `first` to state `last` (None: the cheapest end)."""
    costs, trail = [0 if s == first else FAR for s in range(4)], []
    for r in roles:
        costs, moves = advance(costs, r)
        trail.append(moves)
    state, out = best_end(costs) if last is None else last, []
    for moves in reversed(trail):
        _, before, name, inserted = moves[state]
        out.append((state, name, inserted))
        state = before
    return out[::-1]


def _open(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


CLOSE = "<|im_end|>\n"


def fragments(texts: list[str], moves: list[tuple[int, str, tuple[int, ...]]], first: int, end: bool) -> list[str]:
    """Rendered piece of each turn; with `end` the last one closes the conversation."""
    out, state = [], first
    for i, (text, (role, name, inserted)) in enumerate(zip(texts, moves, strict=True)):
        if "merge" in name:
            piece = "\n\n" + text
        else:
            piece = (CLOSE if state != START else "") + "".join(_open(x) + CLOSE for x in inserted) + _open(role) + text
        if end and i == len(texts) - 1:
            piece += CLOSE + "".join(_open(x) + CLOSE for x in ENDING[role])
        out.append(piece)
        state = role
    return out


_TURNS = "array<struct<turn: bigint, role: string, text: string>>"
_SEGMENTS = f"conv_id long, part int, seq int, turns {_TURNS}"


def _segment_batches(most: int):
    """Sorted rows -> segments of at most `most` consecutive turns of one conversation, numbered in order within the partition."""
    kind = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, now, turns, out = TaskContext.get().partitionId(), 0, None, [], []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            conv, number, lists = zip(*rows, strict=True)
            cols = [pa.array(conv, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(number, pa.int32()), pa.array(lists, kind)]
            return pa.RecordBatch.from_arrays(cols, names=["conv_id", "part", "seq", "turns"])

        for batch in slices(batches, 4 << 20):
            for row in batch.to_pylist():
                if turns and (row["conv_id"] != now or len(turns) == most):
                    out.append((now, seq, turns))
                    seq, turns = seq + 1, []
                now = row["conv_id"]
                turns.append({k: row[k] for k in ("turn", "role", "text")})
            if len(out) > 256:
                yield batch_of(out)
                out = []
        if turns:
            out.append((now, seq, turns))
        if out:
            yield batch_of(out)

    return run


def _matrix_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns = batch.column("turns").to_pylist()
        costs = [segment_matrix([role_of(t["role"]) for t in ts]) for ts in turns]
        cols = [*(batch.column(c) for c in ("key", "part", "seq")), pa.array([len(ts) for ts in turns], pa.int64()), pa.array(costs, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["key", "part", "seq", "n", "costs"])


def borders(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """First and last state of each segment of one conversation, given the segments' matrices in order."""
    costs, trail = [0, FAR, FAR, FAR], []
    for m in matrices:
        ways = [min((min(costs[a] + m[4 * a + b], FAR), m[16 + 4 * a + b], a) for a in range(4)) for b in range(4)]
        costs = [w[0] for w in ways]
        trail.append([w[2] for w in ways])
    state, out = best_end(costs), []
    for back in reversed(trail):
        out.append((back[state], state))
        state = back[state]
    return out[::-1]


_BORDERS = "key string, part int, seq int, first int, last int, before long, end boolean"


def _border_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices sorted by conversation and place -> first and last state of each segment, and the turns before it. Holds
    32 numbers a segment of one conversation."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        states = borders([r["costs"] for r in rows])
        before = [0, *accumulate(r["n"] for r in rows)][:-1]
        cols = [pa.array([r[c] for r in rows], t) for c, t in (("key", pa.string()), ("part", pa.int32()), ("seq", pa.int32()))]
        cols += [pa.array(x, pa.int32()) for x in zip(*states, strict=True)]
        cols += [pa.array(before, pa.int64()), pa.array([i == len(rows) - 1 for i in range(len(rows))])]
        return pa.RecordBatch.from_arrays(cols, names=["key", "part", "seq", "first", "last", "before", "end"])

    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["key"] != rows[0]["key"]:
                yield solve(rows)
                rows = []
            rows.append(row)
    if rows:
        yield solve(rows)


_NAMES = ["conv_id", "place", "turn", "role", "new_role", "operation", "inserted", "inserted_after", "fragment"]
_REPAIRED = "conv_id long, place long, turn long, role string, new_role string, operation string, inserted string, inserted_after string, fragment string"


def _repair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    named = lambda states: ",".join(ROLES[x] for x in states)
    for batch in batches:
        rows: list[tuple] = []
        for s in batch.to_pylist():
            turns = s["turns"]
            first, end, before = (START, True, 0) if s["first"] is None else (s["first"], s["end"], s["before"])
            moves = repair([role_of(t["role"]) for t in turns], first, s["last"])
            pieces = fragments([t["text"] or "" for t in turns], moves, first, end)
            for i, (t, (role, name, inserted), piece) in enumerate(zip(turns, moves, pieces, strict=True)):
                after = named(ENDING[role]) if end and i == len(turns) - 1 else ""
                rows.append((s["conv_id"], before + i, t["turn"], t["role"], ROLES[role], name, named(inserted), after, piece))
        kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 6]
        cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays(cols, names=_NAMES)


def repair_conversations(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per turn of (conv_id, turn, role, text): its place in the conversation, its repaired role, what was done, and
    its rendered fragment; a conversation's fragments in order of place are its transcript."""
    scratch = Scratch(conversations.sparkSession, "chat")
    keys = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # a written table: range bounds are sampled, so a second run could cut elsewhere
    segments = scratch.table(dealt.mapInArrow(_segment_batches(segment), _SEGMENTS).withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))), "segments")
    several = segments.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    matrices = segments.join(several, "key").select("key", "part", "seq", "turns").mapInArrow(_matrix_batches, "key string, part int, seq int, n long, costs array<bigint>")
    solved = matrices.repartition("key").sortWithinPartitions("key", "part", "seq").mapInArrow(_border_batches, _BORDERS)
    joined = segments.join(solved, ["key", "part", "seq"], "left").select("conv_id", "turns", "first", "last", "before", "end")
    return scratch.finish(joined.mapInArrow(_repair_batches, _REPAIRED))


ORACLE_SQL = r"""
WITH RECURSIVE
t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place,
  count(*) OVER (PARTITION BY conv_id) AS n, CASE lower(trim(role)) WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 0 END AS given FROM conversations),
legal(before, state, ins) AS (VALUES (0, 1, ''), (0, 2, ''), (0, 3, 'user'), (1, 2, ''), (1, 3, 'user'), (2, 2, 'assistant'), (2, 3, ''), (3, 2, ''), (3, 3, 'user')),
price AS (SELECT g::INT AS given, s::INT AS state, CASE WHEN g = s THEN 0 WHEN g = 0 THEN 1 ELSE 3 END AS price FROM range(4) a(g), range(1, 4) b(s)),
ways AS (
  SELECT p.given, p.state, price + CASE WHEN ins = '' THEN 0 ELSE 2 END AS cost, before, CASE WHEN given = p.state THEN 'keep' ELSE 'relabel' END AS name, ins FROM price p JOIN legal l USING (state)
  UNION ALL SELECT given, state, 1 + price, state, CASE WHEN given = state THEN 'merge' ELSE 'relabel+merge' END, '' FROM price),
moves AS (SELECT *, row_number() OVER (PARTITION BY given, state ORDER BY cost, name <> 'keep' OR ins <> '', name <> 'merge', name <> 'keep', name, before) AS i FROM ways),
f AS (
  SELECT conv_id, -1::BIGINT AS place, 0 AS state, 0::BIGINT AS cost, 0::BIGINT AS i FROM (SELECT DISTINCT conv_id FROM t)
  UNION ALL SELECT conv_id, place, state, best // 1000, best % 1000 FROM (
    SELECT t.conv_id, t.place, m.state, min((f.cost + m.cost) * 1000 + m.i) AS best
    FROM f JOIN t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.place = f.place + 1 JOIN moves m ON m.given = t.given AND m.before = f.state GROUP BY 1, 2, 3)),
last AS (SELECT f.conv_id, f.place, f.state, f.i, row_number() OVER (PARTITION BY f.conv_id ORDER BY f.cost + CASE f.state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, f.state <> 3, f.state) AS r
  FROM f JOIN t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.place = f.place AND t.place = t.n - 1),
b AS (
  SELECT conv_id, place, state, i FROM last WHERE r = 1
  UNION ALL SELECT f.conv_id, f.place, f.state, f.i FROM b JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.place = b.place JOIN moves m ON m.given = t.given AND m.state = b.state AND m.i = b.i
    JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.place = b.place - 1 AND f.state = m.before AND f.place >= 0),
done AS (SELECT t.*, m.state, m.before, m.name, m.ins, ['', 'system', 'user', 'assistant'][m.state + 1] AS new_role,
    CASE WHEN t.place < t.n - 1 THEN '' WHEN m.state = 1 THEN 'user,assistant' WHEN m.state = 2 THEN 'assistant' ELSE '' END AS ending
  FROM b JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.place = b.place JOIN moves m ON m.given = t.given AND m.state = b.state AND m.i = b.i)
SELECT conv_id, place, turn, role, new_role, name AS operation, ins AS inserted, ending AS inserted_after,
  CASE WHEN contains(name, 'merge') THEN chr(10) || chr(10) || text
    ELSE CASE WHEN before > 0 THEN '<|im_end|>' || chr(10) ELSE '' END || CASE WHEN ins = '' THEN '' ELSE '<|im_start|>' || ins || chr(10) || '<|im_end|>' || chr(10) END
      || '<|im_start|>' || new_role || chr(10) || text END
  || CASE WHEN place < n - 1 THEN '' ELSE '<|im_end|>' || chr(10) || CASE ending WHEN '' THEN '' WHEN 'assistant' THEN '<|im_start|>assistant' || chr(10) || '<|im_end|>' || chr(10)
    ELSE '<|im_start|>user' || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<|im_end|>' || chr(10) END END AS fragment
FROM done
"""
