"""Chat formatting (operator 1): minimum-cost repair of the roles of a conversation, then rendering.

A legal conversation has an optional system message, then user and assistant messages in turn, and ends with the
assistant. Each turn takes one label and starts a message, or merges into the message before (cost 1), or starts a message
after an inserted empty one (cost 3). Another label than the turn's role costs 2, or 1 for an unknown or null role. At the
end empty messages are added (cost 3 each). Dynamic programming finds the cheapest repair; ties go to starting, then
merging, then inserting, and to the earlier label of system, user, assistant.

Turns are sorted by (conv_id, turn, hash of role and text) over all partitions and cut into segments, so a conversation of
any length is spread: each segment becomes a min-plus matrix between label states, the matrices of a conversation are
chained to get the state at every cut, and each segment is then repaired on its own. A conversation gives one row per
segment (almost always one); their texts in the order of ``segment`` are the rendered conversation.

Null turns come first, null texts are empty, rows with a null conv_id form one conversation. Repeated rows are turns of
their own. Marks of the chat format inside texts are broken up by a blank. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demand_engine.llm.text import keep_table

ROLES = ("system", "user", "assistant")
STATES = 4  # 0 nothing yet, then the label of the last message: 1 system, 2 user, 3 assistant
FOLLOWS = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
START, MERGE, INSERT = 0, 1, 2
MERGE_COST, INSERT_COST, RELABEL_COST, UNKNOWN_COST = 1, 3, 2, 1
FAR = 1 << 40
TURNS = 5000  # of a segment at most


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Cost and action by (role code, state before, label); role code 0 is unknown."""
    cost, action = np.full((STATES, STATES, STATES), FAR, np.int64), np.zeros((STATES, STATES, STATES), np.int8)
    for r in range(STATES):
        for q in range(STATES):
            for label in (1, 2, 3):
                change = 0 if r == label else RELABEL_COST if r else UNKNOWN_COST
                ways = [(0, START)] if (q, label) in FOLLOWS else []
                ways += [(MERGE_COST, MERGE)] if q == label else []
                ways += [(INSERT_COST, INSERT)] if any((q, x) in FOLLOWS and (x, label) in FOLLOWS for x in (1, 2, 3)) else []
                if ways:
                    c, a = min(ways)
                    cost[r, q, label], action[r, q, label] = c + change, a
    return cost, action


COST, ACTION = tables()
END_COST = (FAR, 2 * INSERT_COST, INSERT_COST, 0)


def between(q: int, label: int) -> int:
    """The label of the empty message inserted between the two."""
    return next(x for x in (1, 2, 3) if (q, x) in FOLLOWS and (x, label) in FOLLOWS)


def codes(roles: pa.Array) -> np.ndarray:
    found = pc.index_in(pc.utf8_lower(pc.utf8_trim_whitespace(roles)), value_set=pa.array(ROLES))
    return pc.fill_null(pc.add(found, 1), 0).to_numpy(zero_copy_only=False)


def matrices(code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Min-plus product of the turns of each range: cost from each state before to each state after."""
    counts = np.diff(offsets)
    order = np.argsort(-counts, kind="stable")
    out = np.full((len(counts), STATES, STATES), FAR, np.int64)
    out[:, np.arange(STATES), np.arange(STATES)] = 0
    starts, sorted_counts = offsets[:-1][order], -counts[order]
    for t in range(int(counts.max()) if len(counts) else 0):
        live = order[: np.searchsorted(sorted_counts, -t, side="left")]
        step = COST[code[starts[: len(live)] + t]]
        out[live] = np.minimum((out[live][:, :, :, None] + step[:, None]).min(2), FAR)
    return out


def segments(turns: DataFrame) -> DataFrame:
    """(segment, conv_id, roles, texts, costs): runs of a conversation's turns, in the order of ``segment``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["segment", "conv_id", "roles", "texts", "costs"]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv, place = batch.column(0), batch.column(3).to_numpy()
            key, null = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (null[1:] != null[:-1])])
            at = np.nonzero(new)[0]
            run = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
            at = np.nonzero(run % TURNS == 0)[0]
            offsets = np.append(at, n)
            costs = matrices(codes(batch.column(1)), offsets).reshape(len(at), -1)
            cuts = pa.array(offsets.astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(place[at]), conv.take(pa.array(at)), pa.ListArray.from_arrays(cuts, batch.column(1)), pa.ListArray.from_arrays(cuts, batch.column(2)),
                pa.ListArray.from_arrays(pa.array((np.arange(len(at) + 1) * STATES * STATES).astype(np.int32)), pa.array(costs.ravel()))], names)

    hashed = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", F.xxhash64("role", "text").alias("h"))
    ordered = hashed.repartitionByRange("conv_id", "turn", "h").sortWithinPartitions("conv_id", "turn", "h")
    rows = ordered.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("place"))
    return rows.mapInArrow(cut, "segment bigint, conv_id bigint, roles array<string>, texts array<string>, costs array<bigint>")


def chain(cut: DataFrame) -> DataFrame:
    """(segment, number, before, after, last): the states at the cuts of the cheapest repair of each conversation.

    Whether a conversation starts or ends with a segment is known from its neighbours; only matrices are gathered.
    """
    listed = cut.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "costs"))).alias("parts"))
    kind = "array<struct<segment: bigint, number: bigint, before: int, after: int, last: boolean>>"

    @F.arrow_udf(kind)
    def states(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for parts in batch.to_pylist():
                best, back = np.array([0] + [FAR] * (STATES - 1)), []
                for part in parts:
                    way = best[:, None] + np.array(part["costs"]).reshape(STATES, STATES)
                    back.append(way.argmin(0))
                    best = np.minimum(way.min(0), FAR)
                after, path = int((best + np.array(END_COST)).argmin()), []
                for k in range(len(parts) - 1, -1, -1):
                    before = int(back[k][after])
                    path.append({"segment": parts[k]["segment"], "number": k, "before": before, "after": after, "last": k == len(parts) - 1})
                    after = before
                out.append(path)
            yield pa.array(out, pa.list_(pa.struct([("segment", pa.int64()), ("number", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("last", pa.bool_())])))

    return listed.select(F.explode(states(F.col("parts"))).alias("x")).select("x.*")


def repair(code: list[int], before: int, after: int) -> tuple[list[tuple[int, int, int]], int]:
    """(state before, label, action) of each turn on the cheapest way between two states, and its cost."""
    best = [FAR] * STATES
    best[before] = 0
    back = []
    for r in code:
        step = COST[r].tolist()
        now, via = [FAR] * STATES, [0] * STATES
        for label in (1, 2, 3):
            for q in range(STATES):
                c = best[q] + step[q][label]
                if c < now[label]:
                    now[label], via[label] = c, q
        back.append(via)
        best = now
    cost, state, path = best[after], after, []
    for r, via in zip(reversed(code), reversed(back)):
        q = via[state]
        path.append((q, state, int(ACTION[r, q, state])))
        state = q
    return path[::-1], cost


def opened(label: int) -> str:
    return f"<|im_start|>{ROLES[label - 1]}\n"


CLOSED = "<|im_end|>\n"


def render(code: list[int], texts: list[str], before: int, after: int, last: bool) -> dict:
    """The text of a segment; a message left open at its end is closed by what follows it."""
    path, cost = repair(code, before, after)
    out, count = [], {"n_messages": 0, "n_merged": 0, "n_relabelled": 0, "n_inserted": 0}
    for r, text, (q, label, action) in zip(code, texts, path):
        text = text.replace("<|", "< |")
        count["n_relabelled"] += r != label
        if action == MERGE:
            count["n_merged"] += 1
            out.append("\n" + text)
            continue
        if q:
            out.append(CLOSED)
        if action == INSERT:
            out += [opened(between(q, label)), CLOSED]
            count["n_inserted"] += 1
        count["n_messages"] += 1 + (action == INSERT)
        out += [opened(label), text]
    if last:
        out.append(CLOSED)
        missing = {1: (2, 3), 2: (3,), 3: ()}[after]
        out += [opened(x) + CLOSED for x in missing]
        cost += END_COST[after]
        count["n_inserted"] += len(missing)
        count["n_messages"] += len(missing)
    return {"rendered": "".join(out), "cost": cost, **count}


def rendered(codes_of: Column, texts: Column, state: Column) -> Column:
    names = ["cost", "n_messages", "n_merged", "n_relabelled", "n_inserted"]

    @F.arrow_udf("struct<rendered: string, " + ", ".join(f"{n}: bigint" for n in names) + ">")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for roles, texts, state in batches:
            offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(roles).to_numpy(zero_copy_only=False))))
            code = codes(roles.flatten()).tolist()
            out = [render(code[a:b], t.as_py(), s["before"], s["after"], s["last"]) for a, b, t, s in zip(offsets[:-1], offsets[1:], texts, state.to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([o["rendered"] for o in out], pa.string()), *[pa.array([int(o[n]) for o in out], pa.int64()) for n in names]], ["rendered", *names])

    return run(codes_of, texts, state)


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, segment (0, 1, ...), n_turns, rendered, cost and the counts of what was done."""
    cut = keep_table(segments(conversations), "segments")
    states = chain(cut)
    joined = cut.join(states, "segment").select("conv_id", F.col("number").alias("segment"), F.size("roles").cast("long").alias("n_turns"),
                                                rendered(F.col("roles"), F.col("texts"), F.struct("before", "after", "last")).alias("done"))
    return joined.select("conv_id", "segment", "n_turns", "done.*")
