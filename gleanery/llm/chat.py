"""Chat formatting with minimum-cost role repair.

Turns become a legal conversation by merging a turn into the one before, by another
role label or by an empty turn between. The cheapest repair is a shortest path through the
automaton of legal turns. Conversations are cut into slices; each slice sums up as a small
table of costs from every entry state to every exit state, so one conversation of any
length is repaired in parts, with the same result as in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleanery.operators.storage import settle

ROLES = ("system", "user", "assistant")
START = 3
#: Roles that may follow each state: after system, user, assistant, and at the start.
LEGAL = {0: (1,), 1: (2,), 2: (1,), START: (0, 1)}
MERGE, RELABEL, UNKNOWN, INSERT = 1, 3, 1, 2
FINAL = (1, 2)
_FAR = 10**9
Step = tuple[int, str, int | None]


def _steps(given: int | None) -> list[list[Step]]:
    """For each state before and role after a turn of the given role: cost, action and role of an empty turn before."""
    table = []
    for state in range(4):
        row = []
        for role in range(3):
            label = 0 if role == given else UNKNOWN if given is None else RELABEL
            options: list[Step] = []
            if role in LEGAL[state]:
                options.append((label, "keep", None))
            if role == state:
                options.append((label + MERGE, "merge", None))
            options += [(label + INSERT, "keep", x) for x in LEGAL[state] if role in LEGAL[x]]
            row.append(min(options, key=lambda o: o[0], default=(_FAR, "keep", None)))
        table.append(row)
    return table


STEPS = {given: _steps(given) for given in (None, 0, 1, 2)}


def role_number(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else None


def segment_costs(roles: list[int | None]) -> list[int]:
    """Least cost from each of the four states before the turns to each of the four after them, row by row."""
    rows = [[0 if i == j else _FAR for j in range(4)] for i in range(4)]
    for given in roles:
        table = STEPS[given]
        rows = [[min(row[p] + table[p][r][0] for p in range(4)) for r in range(3)] + [_FAR] for row in rows]
    return [min(x, _FAR) for row in rows for x in row]


def closing(state: int) -> tuple[int, int | None]:
    """Cost of ending in a state, and the empty turn that it takes."""
    return (0, None) if state in FINAL or state == START else (INSERT, 1)


def best_exit(costs: list[int]) -> int:
    return min(range(4), key=lambda s: (costs[s] + closing(s)[0], s))


def segment_path(roles: list[int | None], entry: int, leave: int | None) -> list[tuple[int, str, int | None]]:
    """(role, action, empty turn before) of each turn on the cheapest path; the cheapest end where ``leave`` is None."""
    costs, back = [0 if i == entry else _FAR for i in range(4)], []
    for given in roles:
        table = STEPS[given]
        best = [min(range(4), key=lambda p: (costs[p] + table[p][r][0], p)) for r in range(3)]
        costs = [costs[best[r]] + table[best[r]][r][0] for r in range(3)] + [_FAR]
        back.append(best)
    state, out = best_exit(costs) if leave is None else leave, []
    for given, best in zip(reversed(roles), reversed(back)):
        _, action, empty = STEPS[given][best[state]][state]
        out.append((state, action, empty))
        state = best[state]
    return out[::-1]


def _segments(batches, columns: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """Consecutive rows of one conversation and slice of sorted batches."""
    held: dict[str, list] | None = None
    key = None
    for batch in batches:
        data = {c: batch.column(c).to_pylist() for c in columns}
        keys = list(zip(data["slice"], data["conv_id"]))
        at = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[at]:
                continue
            part = {c: v[at:i] for c, v in data.items()}
            if held is not None and key == keys[at]:
                for c in columns:
                    held[c].extend(part[c])
            else:
                if held is not None:
                    yield held
                held, key = part, keys[at]
            at = i
    if held is not None:
        yield held


def _sum_up(batches):
    out: list[tuple] = []
    for seg in _segments(batches, ("slice", "conv_id", "role")):
        out.append((seg["slice"][0], seg["conv_id"][0], segment_costs([role_number(r) for r in seg["role"]])))
        if len(out) == 1000:
            yield _segment_rows(out)
            out = []
    yield _segment_rows(out)


def _segment_rows(rows: list[tuple]) -> pa.RecordBatch:
    slices, ids, costs = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(ids, pa.int64()), pa.array(costs, pa.list_(pa.int64()))],
                                      names=["slice", "conv_id", "costs"])


def _plan(table: pa.Table) -> pa.Table:
    """Entry and exit states of the slices of one conversation; its rows are one per slice."""
    rows = sorted(table.to_pylist(), key=lambda r: r["slice"])
    reach, back = [_FAR] * START + [0], []
    for row in rows:
        best = [min(range(4), key=lambda p: (reach[p] + row["costs"][4 * p + r], p)) for r in range(4)]
        reach = [min(_FAR, reach[best[r]] + row["costs"][4 * best[r] + r]) for r in range(4)]
        back.append(best)
    state, states = best_exit(reach), []
    for best in reversed(back):
        states.append((best[state], state))
        state = best[state]
    states.reverse()
    return pa.table({"slice": pa.array([r["slice"] for r in rows], pa.int32()), "conv_id": pa.array([r["conv_id"] for r in rows], pa.int64()),
                     "entry": pa.array([s[0] for s in states], pa.int32()), "leave": pa.array([s[1] for s in states], pa.int32()),
                     "first": pa.array([i == 0 for i in range(len(rows))]), "last": pa.array([i + 1 == len(rows) for i in range(len(rows))])})


OUT = "conv_id long, turn long, role string, new_role string, action string, empty_before string, empty_after string, rendered string"


def _render(opening: str, closing_mark: str):
    def head(role: int | None) -> str:
        return opening.format(role=ROLES[role])

    def run(batches):
        for seg in _segments(batches, ("slice", "conv_id", "turn", "role", "text", "entry", "leave", "first", "last")):
            entry = START if seg["entry"][0] is None else seg["entry"][0]
            first, last = seg["first"][0] is not False, seg["last"][0] is not False
            path = segment_path([role_number(r) for r in seg["role"]], entry, seg["leave"][0])
            rendered, actions, before, after = [], [], [], [None] * len(path)
            for i, ((role, action, empty), given, text) in enumerate(zip(path, seg["role"], seg["text"])):
                piece = "\n" if action == "merge" else "" if first and i == 0 else closing_mark
                piece += "" if empty is None else head(empty) + closing_mark
                rendered.append(piece + ("" if action == "merge" else head(role)) + (text or ""))
                label = "" if role_number(given) == role else "relabel"
                actions.append("+".join(x for x in (action if action == "merge" else "", label) if x) or "keep")
                before.append(None if empty is None else ROLES[empty])
            if last:
                empty = closing(path[-1][0])[1]
                rendered[-1] += closing_mark + ("" if empty is None else head(empty) + closing_mark)
                after[-1] = None if empty is None else ROLES[empty]
            yield pa.RecordBatch.from_arrays(
                [pa.array(seg["conv_id"], pa.int64()), pa.array(seg["turn"], pa.int64()), pa.array(seg["role"], pa.string()),
                 pa.array([ROLES[p[0]] for p in path]), pa.array(actions, pa.string()), pa.array(before, pa.string()),
                 pa.array(after, pa.string()), pa.array(rendered, pa.string())],
                names=["conv_id", "turn", "role", "new_role", "action", "empty_before", "empty_after", "rendered"])
    return run


def repair_roles(turns: DataFrame, slices: int | None = None, opening: str = "<|im_start|>{role}\n",
                 closing_mark: str = "<|im_end|>\n") -> DataFrame:
    """One row per turn: conv_id, turn, role, ``new_role``, ``action`` (keep, merge, relabel, merge+relabel), the role of an
    ``empty_before`` or ``empty_after`` turn, and ``rendered``: the turn's part of the conversation's text, which is all parts in order.

    A legal conversation is an optional system turn, then user and assistant turns in alternation from user on. Costs: merge 1,
    relabel 3 (1 where the role is null or unknown), empty turn 2; of equal repairs the choice is fixed. Turns are ordered by
    (turn, role, text), nulls first; rows without conv_id are one conversation; null texts count as empty.
    """
    n = slices or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    cut = settle(rows.repartitionByRange(n, *order[:3], F.xxhash64("text")).withColumn("slice", F.spark_partition_id()))
    in_order = ["slice", "conv_id", "turn", "role", F.xxhash64("text"), "text"]
    segments = settle(cut.select("slice", "conv_id", "turn", "role", "text").repartition(n, "slice").sortWithinPartitions(*in_order)
                      .mapInArrow(_sum_up, "slice int, conv_id long, costs array<long>"))
    long_ones = segments.groupBy("conv_id").agg(F.count("*").alias("parts")).filter("parts > 1").select(F.col("conv_id").alias("long_id"))
    plans = (segments.join(long_ones, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_semi").groupBy("conv_id")
             .applyInArrow(_plan, "slice int, conv_id long, entry int, leave int, first boolean, last boolean"))
    plans = settle(plans).withColumnsRenamed({"slice": "plan_slice", "conv_id": "plan_id"})
    planned = cut.join(plans, (F.col("slice") == F.col("plan_slice")) & F.col("conv_id").eqNullSafe(F.col("plan_id")), "left")
    return (planned.repartition(n, "slice").sortWithinPartitions(*in_order).mapInArrow(_render(opening, closing_mark), OUT))
