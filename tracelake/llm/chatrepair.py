"""Chat formatting by minimum-cost role repair.

Legal conversations are those of an automaton: an optional system message,
then user and assistant in turn, ending with the assistant.  Each turn is kept
in its role, relabelled, or merged into the message before, and empty messages
may be inserted; dynamic programming over the automaton's states finds the
cheapest repair, and the repaired messages are rendered.

Taking a turn is a matrix in the (min, +) algebra over the four states, so
parts of a conversation can be solved apart: turns are range-partitioned in
order, a conversation that spans partitions gives one matrix for each of them,
and the states at the borders follow from those few matrices.  No conversation
has to fit in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut

ROLES = ("system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "question": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "answer": "assistant", "developer": "system"}
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 2, 1, 1, 3
START, SYSTEM, USER, ASSISTANT = range(4)
OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"
_BAR, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_FAR = 10**9
#: Messages that may follow each state, as states.
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_KEPT, _RELABELLED, _MERGED = "keep", "relabel", "merge"


def _insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest insertions that make a message legal after a state."""
    out = {}
    for s in range(4):
        level: list[tuple[int, tuple[int, ...]]] = [(s, ())]
        for _ in range(3):
            following = []
            for at, path in level:
                for m in _NEXT[at]:
                    out.setdefault((s, m), path)
                    following.append((m, (*path, m)))
            level = following
    return out


_INSERT = _insertions()
#: What ends a conversation legally from each state.
_END = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def role_of(label: str | None) -> int | None:
    name = (label or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else None


def _moves(role: int | None) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """``(from, to, cost, action, insertions)`` in order of preference."""
    out = []
    for m in (USER, ASSISTANT, SYSTEM):
        change = 0 if m == role else RELABEL_UNKNOWN if role is None else RELABEL
        for s in range(4):
            if s == m and s != START:
                out.append((s, m, change + MERGE, _MERGED, ()))
            if (s, m) in _INSERT:
                added = _INSERT[s, m]
                out.append((s, m, change + INSERT * len(added), _RELABELLED if change else _KEPT, added))
    return sorted(out, key=lambda x: (x[2], len(x[4]), (_KEPT, _MERGED, _RELABELLED).index(x[3]), x[1], x[0]))


_BEST: dict[int | None, dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]] = {}
for _role in (None, SYSTEM, USER, ASSISTANT):
    _BEST[_role] = {}
    for _s, _m, _c, _a, _i in _moves(_role):
        _BEST[_role].setdefault((_s, _m), (_c, _a, _i))
_MATRIX = {r: np.array([[best.get((s, m), (_FAR,))[0] for m in range(4)] for s in range(4)], np.int64) for r, best in _BEST.items()}
_FINAL = np.array([INSERT * len(_END[s]) for s in range(4)], np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two (min, +) matrices."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _FAR)


def transfer(roles: list[int | None]) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0, _FAR)
    for r in roles:
        out = product(out, _MATRIX[r])
    return out


def repair(roles: list[int | None], entry: int = START, leave: int | None = None) -> list[tuple[int, str, tuple[int, ...]]]:
    """``(role, action, insertions before)`` for each turn: the cheapest legal
    path from ``entry`` to ``leave``, or to the best end.  Ties: the smaller
    state at each step, from the end."""
    cost = [_FAR] * 4
    cost[entry] = 0
    back: list[list[int]] = []
    for r in roles:
        best = _BEST[r]
        now, frm = [_FAR] * 4, [0] * 4
        for (s, m), (c, _, _) in best.items():
            if cost[s] + c < now[m] or cost[s] + c == now[m] < _FAR and s < frm[m]:
                now[m], frm[m] = cost[s] + c, s
        back.append(frm)
        cost = now
    at = leave if leave is not None else min(range(4), key=lambda s: (cost[s] + int(_FINAL[s]), s))
    out = []
    for r, frm in zip(reversed(roles), reversed(back)):
        s = frm[at]
        _, action, added = _BEST[r][s, at]
        out.append((at, action, added))
        at = s
    return out[::-1]


def borders(parts: list[np.ndarray]) -> list[tuple[int, int | None]]:
    """Entry and exit states for each part of one conversation."""
    states, costs = [], [np.array([0, _FAR, _FAR, _FAR])]
    for m in parts:
        costs.append((costs[-1][:, None] + m).min(axis=0))
    at = min(range(4), key=lambda s: (costs[-1][s] + _FINAL[s], s))
    for k in range(len(parts), 0, -1):
        states.append(at)
        at = min(range(4), key=lambda s: (costs[k - 1][s] + parts[k - 1][s, at], s))
    states = [START, *states[::-1]]
    return [(states[k], states[k + 1]) for k in range(len(parts))]


def escaped(text: str) -> str:
    """A text that holds no mark of the format, so that it can open or close no
    message: ``<|`` is written ``<\\|``, and what already looks so with one
    backslash more, which ``plain`` takes back."""
    return _BAR.sub(r"<\1\\|", text)


def plain(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _message(role: int, text: str) -> str:
    return OPEN.format(ROLES[role - 1]) + text + CLOSE


def _render(path: list[tuple[int, str, tuple[int, ...]]], texts: list[str | None], first: bool, goes_on: bool, leave: int) -> list[str]:
    """Each turn's share of the rendered conversation; joined in order they
    are the whole.  A message closes where the next one opens or at the end."""
    out = []
    for i, ((role, action, added), text) in enumerate(zip(path, texts)):
        text = escaped(text or "")
        piece = "\n" if action == _MERGED else ("" if first and i == 0 else CLOSE) + "".join(_message(a, "") for a in added) + OPEN.format(ROLES[role - 1])
        piece += text
        if i == len(path) - 1 and not goes_on:
            piece += CLOSE + "".join(_message(a, "") for a in _END[leave])
        out.append(piece)
    return out


def _runs(convs: list) -> Iterator[tuple[int, int]]:
    a = 0
    for i in range(1, len(convs) + 1):
        if i == len(convs) or convs[i] != convs[a]:
            yield a, i
            a = i


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row for each turn: ``conv_id, turn, position, role, action,
    n_inserted, rendered``.

    role is the repaired one, action keep, relabel or merge, n_inserted the
    empty messages put before the turn (after the last one: at its end, not
    counted), rendered the turn's share of the formatted conversation: shares
    joined in the order of position make it whole.  Turns are in order of
    turn, role and text, nulls first; repeated rows are turns of their own.  A
    null or unknown role may take any at a low cost; a null text is empty;
    marks of the format within a text are escaped (see plain); a null conv_id is a conversation.  An empty table gives no rows; other
    columns are ignored.
    """
    spark = turns.sparkSession
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(*(F.col(c).alias(n) for c, n in zip((conv_col, turn_col, role_col, text_col), order)))
    # the last key only divides equal rows
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(count, *order, "_row").sortWithinPartitions(*order, "_row").withColumn("pid", F.spark_partition_id()))
    held = dealt.repartition("pid").sortWithinPartitions("pid", *order, "_row")

    def by_pid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole conversations within a pid, each as one table, in order."""
        waiting: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = list(zip(batch.column("pid").to_pylist(), batch.column("conv_id").to_pylist()))
            for a, b in _runs(keys):
                if waiting and keys[a] != key:
                    yield pa.Table.from_batches(waiting)
                    waiting = []
                key = keys[a]
                waiting.append(batch.slice(a, b - a))
        if waiting:
            yield pa.Table.from_batches(waiting)

    conv_type = rows.schema["conv_id"].dataType.simpleString()
    turn_type = rows.schema["turn"].dataType.simpleString()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and last conversation of each pid, as matrices: only
        those can go on in another."""
        pid, first, last = None, None, None

        def out(*parts) -> Iterator[pa.RecordBatch]:
            for p in {id(x): x for x in parts if x is not None}.values():
                m = transfer([role_of(x) for x in p.column("role").to_pylist()])
                yield pa.RecordBatch.from_arrays([p.column("conv_id").combine_chunks()[:1], p.column("pid").combine_chunks()[:1], pa.array([m.reshape(-1).tolist()], pa.list_(pa.int64())), pa.array([p.num_rows], pa.int64())], ["conv_id", "pid", "matrix", "n"])

        for t in by_pid(batches):
            if t.column("pid")[0].as_py() != pid:
                yield from out(first, last)
                pid, first = t.column("pid")[0].as_py(), t
            last = t
        yield from out(first, last)

    # two rows at most for each partition
    edges = held.mapInArrow(ends, f"conv_id {conv_type}, pid int, matrix array<bigint>, n long").orderBy("pid").collect()
    by_conv: dict = {}
    for r in edges:
        by_conv.setdefault(r["conv_id"], []).append(r)
    given: dict = {}
    for conv, parts in by_conv.items():
        if len(parts) > 1:
            before = 0
            for k, (r, border) in enumerate(zip(parts, borders([np.array(r["matrix"]).reshape(4, 4) for r in parts]))):
                given[r["pid"], conv] = (*border, k == 0, k < len(parts) - 1, before)
                before += r["n"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_pid(batches):
            entry, leave, first, goes_on, before = given.get((t.column("pid")[0].as_py(), t.column("conv_id")[0].as_py()), (START, None, True, False, 0))
            path = repair([role_of(x) for x in t.column("role").to_pylist()], entry, leave)
            n = t.num_rows
            shares = _render(path, t.column("text").to_pylist(), first, goes_on, path[-1][0])
            yield pa.RecordBatch.from_arrays([t.column("conv_id").combine_chunks(), t.column("turn").combine_chunks(), pa.array(range(before, before + n), pa.int64()), pa.array([ROLES[r - 1] for r, _, _ in path]), pa.array([a for _, a, _ in path]), pa.array([len(x) for _, _, x in path], pa.int32()), pa.array(shares)], ["conv_id", "turn", "position", "role", "action", "n_inserted", "rendered"])

    return held.mapInArrow(solve, f"conv_id {conv_type}, turn {turn_type}, position long, role string, action string, n_inserted int, rendered string")
