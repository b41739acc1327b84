"""Chat formatting by minimum-cost role repair.

A legal conversation may begin with a system turn and then alternates user and assistant. For each turn the repair may keep
the role, relabel it, merge the turn into the one before, or insert an empty turn ahead of it; dynamic programming over the
automaton of legal turns finds the cheapest way, and the repaired sequence is rendered.

A conversation may hold any share of all rows: turns are sorted by range, so it may lie in many partitions. Each partition
reduces its first and last conversation to a min-plus matrix between the automaton's states; the driver composes these
(two small rows a partition), and each partition then traces its own turns between the states so fixed.

The result has a row per turn, with its fragment of the rendering, and one per inserted turn; the fragments of a
conversation in order of ``seq`` are its rendering.

Cases: a null conversation id is a conversation of its own; turns with equal numbers go by role, then hash of the text, and a
null number goes last; a null or unknown role is adopted by any role at a small cost; null texts render empty; control
markers inside texts are broken up; repeated rows are turns of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

ROLES = ("", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT, OTHER = 0, 1, 2, 3, 0
ALIASES = {"system": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "gpt": ASSISTANT}
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
ONE = 1 << 32  # a value is cost * ONE + turns in the result, so ties go to the shorter sequence
NEVER = 1 << 62


@dataclass(frozen=True)
class Costs:
    """What each repair costs, and the states in which a conversation may end."""

    merge: int = 1
    relabel: int = 2
    adopt: int = 1
    insert: int = 3
    final: tuple[int, ...] = (USER, ASSISTANT)


def steps(costs: Costs) -> list[list[list[tuple[int, str, int]]]]:
    """[role][from][to]: value, action and role inserted ahead (0: none) of the cheapest way."""
    out = []
    for role in (OTHER, SYSTEM, USER, ASSISTANT):
        table = [[(NEVER, "", 0)] * 4 for _ in range(4)]
        for s in range(4):
            for q in (SYSTEM, USER, ASSISTANT):
                label = 0 if q == role else costs.adopt if role == OTHER else costs.relabel
                word = "keep" if q == role else "relabel"
                ways = []
                if s == q:
                    ways.append(((label + costs.merge) * ONE, "merge" if q == role else "relabel+merge", 0))
                if (s, q) in LEGAL:
                    ways.append((label * ONE + 1, word, 0))
                ways += [((label + costs.insert) * ONE + 2, word, p) for p in (USER, ASSISTANT) if (s, p) in LEGAL and (p, q) in LEGAL]
                if ways:
                    table[s][q] = min(ways)
        out.append(table)
    return out


def ending(s: int, costs: Costs) -> tuple[int, int]:
    """Value and role of the turn to insert (0: none) for a conversation to end in state ``s``."""
    if s in costs.final:
        return 0, 0
    ways = [p for p in costs.final if (s, p) in LEGAL]
    return (costs.insert * ONE + 1, ways[0]) if ways else (NEVER, 0)


def matrix(roles: tuple[int, ...], table) -> list[list[int]]:
    """Least value from each state to each over the turns."""
    m = np.array([[[c[0] for c in row] for row in t] for t in table], np.int64)
    out = m[roles[0]]
    for r in roles[1:]:
        out = np.minimum((out[:, :, None] + m[r][None, :, :]).min(1), NEVER)
    return out.tolist()


def trace(roles: tuple[int, ...], entry: int, end: int | None, costs: Costs) -> tuple[list[int], int, int]:
    """The cheapest states after each turn from ``entry``, ending in ``end`` (None: as is cheapest); value; last insertion."""
    table = steps_of(costs)
    value, back = [NEVER] * 4, []
    value[entry] = 0
    for r in roles:
        t, new, frm = table[r], [NEVER] * 4, [0] * 4
        for s in range(4):
            if value[s] < NEVER:
                for q in (SYSTEM, USER, ASSISTANT):
                    v = value[s] + t[s][q][0]
                    if v < new[q]:
                        new[q], frm[q] = v, s
        value = new
        back.append(frm)
    last = 0
    if end is None:
        total = [value[s] + ending(s, costs)[0] for s in range(4)]
        end = min(range(4), key=lambda s: (total[s], s))
        last = ending(end, costs)[1]
        best = total[end]
    else:
        best = value[end]
    states, s = [], end
    for frm in reversed(back):
        states.append(s)
        s = frm[s]
    return states[::-1], best, last


@lru_cache(maxsize=16)
def steps_of(costs: Costs):
    return steps(costs)


_short = lru_cache(maxsize=65_536)(trace)


def repair(roles: tuple[int, ...], entry: int, end: int | None, costs: Costs) -> tuple[list[int], int, int]:
    """``trace``, remembered for short runs, of which there are few different ones."""
    return (_short if len(roles) <= 64 else trace)(roles, entry, end, costs)


def code(role: str | None) -> int:
    return ALIASES.get((role or "").strip().lower(), OTHER)


def _runs(keys: list) -> Iterator[tuple[object, int, int]]:
    first = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[first]:
            yield keys[first], first, i
            first = i


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, bool, object, list[dict]]]:
    """A partition's conversations in order: whether first, whether last, id, columns of its turns."""
    held: list[tuple] = []
    key, first = None, True
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for k, a, b in _runs(columns[0]):
            if held and k != key:
                yield first, False, key, held
                first, held = False, []
            key = k
            held += list(zip(*(c[a:b] for c in columns)))
    if held:
        yield first, True, key, held


SCHEMA = "conv_id {}, turn {}, seq long, part int, role string, out_role string, action string, rendered string"


def format_turns(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """A row per turn of ``turns`` (conv_id, turn, role, text) and per inserted turn: conv_id, turn (of an insertion: that
    of the next turn), seq (order in the conversation), part (turn of the repaired sequence, from 0), role, out_role,
    action (keep, relabel, merge, relabel+merge, insert) and rendered."""
    kinds = [turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    ordered = checkpoint(
        turns.select("conv_id", "turn", "role", "text").orderBy(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.xxhash64("text"))
    )
    table = steps_of(costs)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, out = TaskContext.get().partitionId(), []
        for first, last, key, rows in _whole(batches):
            if first or last:
                m = matrix(tuple(code(r[1]) for r in rows), table)
                out.append((pid, first, last, key, [x for row in m for x in row], len(rows)))
        if out:
            cols = list(zip(*out))
            types = [pa.int32(), pa.bool_(), pa.bool_(), arrow_id, pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["pid", "first", "last", "key", "m", "n"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id, arrow_turn = (to_arrow_type(turns.schema[c].dataType) for c in ("conv_id", "turn"))
    said = ordered.select("conv_id", "role").mapInArrow(edges, f"pid int, first boolean, last boolean, key {kinds[0]}, m array<long>, n long").collect()
    plan = _compose(sorted(said, key=lambda r: (r["pid"], not r["first"])), costs)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        out: list[tuple] = []
        for first, last, key, rows in _whole(batches):
            entry, end, done, seq = plan.get((pid, first, last), (START, None, 0, 0)) if first or last else (START, None, 0, 0)
            final = end is None
            states, _, late = repair(tuple(code(r[2]) for r in rows), entry, end, costs)
            s, part = entry, done - 1
            for i, ((_, turn, role, text), q) in enumerate(zip(rows, states)):
                _, action, ahead = table[code(role)][s][q]
                shown = (text or "").replace("<|im_", "<| im_")
                if ahead:
                    part += 1
                    out.append((key, turn, 2 * (seq + i), part, None, ROLES[ahead], "insert", ("<|im_end|>\n" if part else "") + f"<|im_start|>{ROLES[ahead]}\n"))
                if action.endswith("merge"):
                    piece = "\n" + shown
                else:
                    part += 1
                    piece = ("<|im_end|>\n" if part else "") + f"<|im_start|>{ROLES[q]}\n{shown}"
                closes = final and i == len(rows) - 1
                out.append((key, turn, 2 * (seq + i) + 1, part, role, ROLES[q], action, piece + "<|im_end|>\n" * (closes and not late)))
                if closes and late:
                    out.append((key, turn, 2 * (seq + i) + 2, part + 1, None, ROLES[late], "insert", f"<|im_end|>\n<|im_start|>{ROLES[late]}\n<|im_end|>\n"))
                s = q
            if len(out) > 4096:
                yield _batch(out, arrow_id, arrow_turn)
                out = []
        if out:
            yield _batch(out, arrow_id, arrow_turn)

    return ordered.mapInArrow(render, SCHEMA.format(*kinds))


def _batch(out: list[tuple], arrow_id: pa.DataType, arrow_turn: pa.DataType) -> pa.RecordBatch:
    types = [arrow_id, arrow_turn, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = ["conv_id", "turn", "seq", "part", "role", "out_role", "action", "rendered"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def _compose(said: list, costs: Costs) -> dict[tuple[int, bool, bool], tuple[int, int | None, int, int]]:
    """For each conversation at a partition's edge: state at entry, at exit (None: it ends there), turns of the result and
    rows before it."""
    plan: dict = {}
    i = 0
    while i < len(said):
        j = i
        while j + 1 < len(said) and said[j]["last"] and said[j + 1]["first"] and said[j + 1]["key"] == said[i]["key"] and said[j + 1]["pid"] > said[j]["pid"]:
            j += 1
        if j > i:
            segments = [np.array(r["m"], np.int64).reshape(4, 4) for r in said[i : j + 1]]
            forward = [np.array([0, NEVER, NEVER, NEVER], np.int64)]
            for m in segments:
                forward.append(np.minimum((forward[-1][:, None] + m).min(0), NEVER))
            total = [int(forward[-1][s]) + ending(s, costs)[0] for s in range(4)]
            s = min(range(4), key=lambda x: (total[x], x))
            states = [s]
            for k in range(len(segments) - 1, -1, -1):
                s = int(np.argmin(forward[k] + segments[k][:, s]))
                states.append(s)
            states.reverse()
            rows = 0
            for k, r in enumerate(said[i : j + 1]):
                end = None if i + k == j else states[k + 1]
                plan[r["pid"], r["first"], r["last"]] = (states[k], end, int(forward[k][states[k]] % ONE), rows)
                rows += r["n"]
        i = j + 1
    return plan


def op3_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations repaired and rendered."""
    return format_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
