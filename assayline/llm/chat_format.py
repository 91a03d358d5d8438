"""Minimum-cost repair of chat roles, and rendering."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scratch import written

ROLES = ("start", "system", "user", "assistant")
_LEGAL = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}


@dataclass(frozen=True)
class ChatParams:
    """Costs of the repairs, how turns are rendered, and the longest conversation that one task repairs whole."""

    merge: int = 1
    insert: int = 2
    relabel: int = 3
    relabel_unknown: int = 1
    opening: str = "<|{role}|>\n"
    closing: str = "<|end|>\n"
    joint: str = "\n"
    whole_turns: int = 10_000
    group_rows: int = 4096


_FAR = 1 << 40


def _steps(p: ChatParams) -> tuple[np.ndarray, np.ndarray]:
    """``cost[r, s, q]`` and ``how[s, q]`` of emitting a turn of role r as role q after role s.

    ``how``: -1 merge, 0 plain, else the role of one empty turn put in between.
    """
    base, how = np.full((4, 4), _FAR), np.zeros((4, 4), np.int64)
    for s in range(4):
        for q in (1, 2, 3):
            ways = [(0, 0)] if (s, q) in _LEGAL else []
            if s == q:
                ways.append((p.merge, -1))
            ways += [(p.insert, x) for x in (2, 3) if (s, x) in _LEGAL and (x, q) in _LEGAL]
            if ways:
                base[s, q], how[s, q] = min(ways)
    relabel = np.zeros((4, 4), np.int64)
    for r in range(4):
        for q in (1, 2, 3):
            relabel[r, q] = 0 if r == q else p.relabel if r else p.relabel_unknown
    return np.minimum(base[None] + relabel[:, None, :], _FAR), how


def _ends(p: ChatParams) -> list[int]:
    """Cost of ending after each role: a conversation ends with the assistant."""
    return [0, 2 * p.insert, p.insert, 0]


def role_codes(roles: pd.Series) -> np.ndarray:
    """1 to 3 for the known roles, whatever their case; 0 for any other and for null."""
    return roles.str.lower().str.strip().map({r: i for i, r in enumerate(ROLES) if i}).fillna(0).astype(int).to_numpy()


def costs_to_go(codes: np.ndarray, lengths: np.ndarray, after: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """``[row, t, s]``: the least cost of all turns from t on, after state s; rows of ``codes`` are sequences, padded at their ends."""
    n, longest = codes.shape
    out = np.empty((n, longest + 1, 4), np.int64)
    out[:, longest] = after
    for t in range(longest - 1, -1, -1):
        steps = np.minimum((cost[codes[:, t]] + out[:, t + 1][:, None, :]).min(axis=2), _FAR)
        out[:, t] = np.where((t < lengths)[:, None], steps, out[:, t + 1])
    return out


def best_paths(codes: np.ndarray, lengths: np.ndarray, entry: np.ndarray, after: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The state after each turn on a cheapest path; of several the one whose first differing state is the least.

    ``after``: what it costs to go on, or end, from each state. All sequences advance together.
    """
    rest = costs_to_go(codes, lengths, after, cost)
    out = np.empty(codes.shape, np.int64)
    at = entry.copy()
    for t in range(codes.shape[1]):
        to = (cost[codes[:, t], at] + rest[:, t + 1]).argmin(axis=1)
        at = np.where(t < lengths, to, at)
        out[:, t] = at
    return out


def transfer(codes: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The least cost from each state before the turns to each state after them."""
    ends = np.where(np.eye(4, dtype=bool), 0, _FAR)
    return costs_to_go(np.tile(codes, (4, 1)), np.full(4, len(codes)), ends, cost)[:, 0].T


_PIECES = (
    "conv_id long, turn long, chunk int, seq int, role string, repaired_role string, action string, "
    "inserted string, cost long, piece string"
)


def _repair(rows: pd.DataFrame, path: np.ndarray, p: ChatParams, cost: np.ndarray, how: np.ndarray, entry: int, last: bool) -> pd.DataFrame:
    """The pieces of one conversation's ordered rows, or of a chunk of them, whose states are ``path``."""
    codes = rows["code"].tolist()
    path = path.tolist()
    texts = rows["text"].fillna("").tolist()
    actions, inserted, costs, pieces = [], [], [], []
    before, steps, ways = entry, cost.tolist(), how.tolist()

    def turn(role: int, text: str = "") -> str:
        return p.opening.format(role=ROLES[role]) + text

    for i, (r, q) in enumerate(zip(codes, path, strict=True)):
        way = ways[before][q]
        changed = "keep" if r == q else "relabel"
        actions.append(changed if way >= 0 else "merge" if r == q else "relabel+merge")
        inserted.append(ROLES[way] if way > 0 else "")
        costs.append(steps[r][before][q])
        if way < 0:
            piece = p.joint + texts[i]
        else:
            # A turn's closing is written when the next one opens, as it may still be merged into.
            piece = (p.closing if before else "") + (turn(way) + p.closing if way > 0 else "") + turn(q, texts[i])
        before = q
        if last and i == len(path) - 1:
            piece += p.closing
            for more in {1: (2, 3), 2: (3,)}.get(q, ()):
                piece += turn(more) + p.closing
                inserted[-1] = f"{inserted[-1]}+{ROLES[more]}".strip("+")
            costs[-1] += _ends(p)[q]
        pieces.append(piece)
    return pd.DataFrame(
        {
            "conv_id": rows["conv_id"].to_numpy(), "turn": rows["turn"].to_numpy(), "chunk": rows["chunk"].to_numpy(),
            "seq": np.arange(len(rows)), "role": rows["role"].to_numpy(), "repaired_role": [ROLES[q] for q in path],
            "action": actions, "inserted": inserted, "cost": costs, "piece": pieces,
        }
    )


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["turn", "role", "text"], na_position="first", kind="stable")
    return rows.assign(code=role_codes(rows["role"]))


def _whole(rows: pd.DataFrame, p: ChatParams, cost: np.ndarray, how: np.ndarray) -> pd.DataFrame:
    """The pieces of many conversations; those of like lengths are repaired together."""
    parts = [own for _, own in _ordered(rows.assign(chunk=0)).groupby("conv_id", dropna=False, sort=False)]
    ends = np.array(_ends(p))
    out = []
    by_length: dict[int, list[pd.DataFrame]] = {}
    for own in parts:
        by_length.setdefault(len(own).bit_length(), []).append(own)
    for like in by_length.values():
        lengths = np.array([len(own) for own in like])
        codes = np.zeros((len(like), lengths.max()), np.int64)
        for i, own in enumerate(like):
            codes[i, : len(own)] = own["code"]
        paths = best_paths(codes, lengths, np.zeros(len(like), np.int64), np.tile(ends, (len(like), 1)), cost)
        out += [_repair(own, paths[i, : len(own)], p, cost, how, 0, True) for i, own in enumerate(like)]
    return pd.concat(out)


def repair_chats(turns: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """The turns of ``turns(conv_id, turn, role, text)`` with repaired roles, rendered.

    Legal: perhaps a system turn, then user and assistant in turn, the assistant
    last. Dynamic programming over that automaton finds the cheapest way to keep,
    merge (into the turn before, of the same role) or relabel each turn and to
    insert empty turns. ``piece`` is the turn's share of the rendered text: pieces
    in the order of (chunk, seq) make up the conversation. ``cost`` is the turn's share of the least cost.

    Of equally cheap repairs the one is taken whose roles come first, in the order of
    ``ROLES``, where they first differ. Conversations of up to ``whole_turns`` turns are repaired whole, many to a
    task and all in step. Longer ones are dealt into chunks by range of their order: each chunk's
    costs between states are a 4 by 4 matrix, the matrices give what it costs to go on after each
    chunk, with that each chunk tells which state it ends in from each state before it, and
    from the states so found it is repaired by itself. The result is the same as if repaired whole.

    Turns are ordered by turn, then role and text; nulls come first. Unknown and
    null roles may become any role at ``relabel_unknown``. A null text is empty. A
    null conv_id is a conversation of its own. Repeated rows are turns like others. An empty
    table gives an empty result.
    """
    p = params
    cost, how = _steps(p)
    ends = _ends(p)
    slim = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text"
    )
    counts = slim.groupBy("conv_id").agg(F.count("*").alias("n"))
    long_ones = counts.where(F.col("n") > p.whole_turns).select(F.coalesce("conv_id", F.lit(0)).alias("_id"), F.col("conv_id").isNull().alias("_none"))
    total = slim.count()
    groups = max(1, -(-total // p.group_rows))

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        return _whole(rows, p, cost, how)

    if long_ones.isEmpty():
        few = slim.withColumn("_g", F.pmod(F.xxhash64("conv_id"), F.lit(groups)))
        return few.groupBy("_g").applyInPandas(lambda rows: whole(rows.drop(columns="_g")), _PIECES)

    marked = slim.withColumn("_id", F.coalesce("conv_id", F.lit(0))).withColumn("_none", F.col("conv_id").isNull())
    few = marked.join(long_ones, ["_id", "_none"], "left_anti").drop("_id", "_none").withColumn("_g", F.pmod(F.xxhash64("conv_id"), F.lit(groups)))
    short = few.groupBy("_g").applyInPandas(lambda rows: whole(rows.drop(columns="_g")), _PIECES)
    order = ["conv_id", "turn", "role", "text"]
    dealt = marked.join(long_ones, ["_id", "_none"], "left_semi").drop("_id", "_none").repartitionByRange(*order)
    chunks = written(dealt.withColumn("chunk", F.spark_partition_id()), "chunks")

    def matrix(rows: pd.DataFrame) -> pd.DataFrame:
        m = transfer(_ordered(rows)["code"].to_numpy(), cost)
        return pd.DataFrame({"conv_id": rows["conv_id"].iloc[:1], "chunk": rows["chunk"].iloc[:1], "m": [m.ravel().tolist()]})

    def beyond(rows: pd.DataFrame) -> pd.DataFrame:
        """What it costs to go on after each chunk of one conversation; a chunk is a row of 16 numbers."""
        rows = rows.sort_values("chunk")
        rest = [np.array(ends)]
        for m in reversed(rows["m"].tolist()):
            rest.append(np.minimum((np.array(m).reshape(4, 4) + rest[-1][None, :]).min(axis=1), _FAR))
        return pd.DataFrame({
            "conv_id": rows["conv_id"], "chunk": rows["chunk"], "rest": [r.tolist() for r in rest[-2::-1]],
            "last": [False] * (len(rows) - 1) + [True],
        })

    def ends_in(rows: pd.DataFrame) -> pd.DataFrame:
        """The state that the chunk ends in, from each state before it."""
        first, codes = rows.iloc[0], _ordered(rows)["code"].to_numpy()
        after = np.tile(np.array(first["rest"]), (4, 1))
        path = best_paths(np.tile(codes, (4, 1)), np.full(4, len(codes)), np.arange(4), after, cost)
        return pd.DataFrame({"conv_id": rows["conv_id"].iloc[:1], "chunk": rows["chunk"].iloc[:1], "to": [path[:, -1].tolist()]})

    def enters(rows: pd.DataFrame) -> pd.DataFrame:
        """The state before each chunk of one conversation; a chunk is a row of four numbers."""
        rows = rows.sort_values("chunk")
        entry, at = [], 0
        for to in rows["to"]:
            entry.append(at)
            at = int(to[at])
        return pd.DataFrame({"conv_id": rows["conv_id"], "chunk": rows["chunk"], "entry": entry})

    def chunk(rows: pd.DataFrame) -> pd.DataFrame:
        first, own = rows.iloc[0], _ordered(rows)
        entry = int(first["entry"])
        path = best_paths(own["code"].to_numpy()[None], np.array([len(own)]), np.array([entry]), np.array([first["rest"]]), cost)[0]
        return _repair(own, path, p, cost, how, entry, bool(first["last"]))

    def with_known(table: DataFrame, known: DataFrame) -> DataFrame:
        known = known.withColumnRenamed("conv_id", "_c").withColumnRenamed("chunk", "_k")
        return table.join(known, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k"))).drop("_c", "_k")

    by_chunk = ["conv_id", "chunk"]
    mats = chunks.groupBy(*by_chunk).applyInPandas(matrix, "conv_id long, chunk int, m array<long>")
    rest = written(mats.groupBy("conv_id").applyInPandas(beyond, "conv_id long, chunk int, rest array<long>, last boolean"), "rest")
    going = with_known(chunks, rest)
    to = going.groupBy(*by_chunk).applyInPandas(ends_in, "conv_id long, chunk int, to array<int>")
    entries = written(to.groupBy("conv_id").applyInPandas(enters, "conv_id long, chunk int, entry int"), "entries")
    return short.unionByName(with_known(going, entries).groupBy(*by_chunk).applyInPandas(chunk, _PIECES))
