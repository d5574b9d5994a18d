"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation from user to assistant.
Each given turn keeps its role or takes another (a relabel), and then follows on, is merged into the turn before it, or
has empty turns put before it; the cheapest way through the automaton of legal turns is found by dynamic programming.

The step of a turn is a (min, +) matrix over the automaton's states, and matrices compose in any grouping. So turns are
dealt in blocks of ``BLOCK`` turn numbers; each block gives its matrix, a conversation's blocks are chained in order
(a few numbers a block, however long their texts), and every block then traces its own best way between its two states.
A block with far more rows than numbers (repeated or missing turn numbers) is split further, by number and then by ranges
of the hash that orders equal numbers. Texts are shuffled once, in the last step; the others move roles and hashes only.

Cost ties: the lowest state of automaton order (system, user, assistant) wins, and earlier steps are chosen last.

In a text every ``<|`` is written ``<||``, which no control string holds, so that a text can't forge turns (and can be
read back).

Edge cases: null role is unknown and any role is a relabel; roles are compared in lower case without blanks around;
null text is empty; turns with equal numbers are ordered by a hash of role and text, equal rows stay in one block; a null
turn comes last; null conv_id is a conversation; a text may have any length; rows are never dropped; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.runtime import bytes_of, materialize, small_batches

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
RELABEL, MERGE, INSERT = 3, 1, 2
FAR = 1 << 40
BLOCK = 512
#: Rows of a block beyond which it is split.
CROWDED = 8 * BLOCK
#: Split blocks up to which they are broadcast.
BROADCAST_ROWS = 100_000
#: The block of turns without number, after all others.
UNNUMBERED = 1 << 62
#: Bytes of conversations (as stored) that one Python call takes.
GROUP_BYTES = 1 << 20

#: What comes before a turn of the second state after the first: inserted states, merged or not, cost.
STEPS: dict[tuple[int, int], tuple[tuple[int, ...], bool, int]] = {
    (START, SYSTEM): ((), False, 0),
    (START, USER): ((), False, 0),
    (START, ASSISTANT): ((USER,), False, INSERT),
    (SYSTEM, SYSTEM): ((), True, MERGE),
    (SYSTEM, USER): ((), False, 0),
    (SYSTEM, ASSISTANT): ((USER,), False, INSERT),
    (USER, USER): ((), True, MERGE),
    (USER, ASSISTANT): ((), False, 0),
    (ASSISTANT, USER): ((), False, 0),
    (ASSISTANT, ASSISTANT): ((), True, MERGE),
}
#: Cost of what must still be appended at the end: a system turn alone needs both others, a user turn an answer.
ENDS = np.array([0, 2 * INSERT, INSERT, 0], np.int64)


def state_of(role: object) -> int:
    r = role.strip().lower() if isinstance(role, str) else ""
    return ROLES.index(r) + 1 if r in ROLES else START


def matrix(role: object) -> np.ndarray:
    """Costs [from, to] of a turn with this role."""
    own, m = state_of(role), np.full((4, 4), FAR, np.int64)
    for (p, q), (_, _, cost) in STEPS.items():
        m[p, q] = cost + (0 if q == own else RELABEL)
    return m


_MATRICES = {r: matrix(r) for r in (*ROLES, None)}


def _of(role: object) -> np.ndarray:
    s = state_of(role)
    return _MATRICES[ROLES[s - 1] if s else None]


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


def trace(matrices: list[np.ndarray], first: int, last: int) -> list[int]:
    """States after each matrix on the cheapest way from ``first`` to ``last``."""
    costs = [np.where(np.arange(4) == first, 0, FAR).astype(np.int64)]
    for m in matrices:
        costs.append(np.minimum((costs[-1][:, None] + m).min(0), FAR))
    out = [last]
    for k in range(len(matrices) - 1, 0, -1):
        out.append(int(np.argmin(costs[k] + matrices[k][:, out[-1]])))
    return out[::-1]


def _units(pdf: pd.DataFrame, keys: tuple[str, ...], by: tuple[str, ...]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """The rows of each value of ``keys``, in order of ``by``, as lists by column."""
    pdf = pdf.sort_values([*keys, *by], kind="stable")
    new = np.zeros(len(pdf), bool)
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    cut = [0, *np.flatnonzero(new).tolist(), len(pdf)]
    columns = {c: pdf[c].tolist() for c in pdf.columns}
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        yield tuple(columns[k][i] for k in keys), {c: v[i:j] for c, v in columns.items()}


_BLOCK = ("conv", "block", "part")


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for key, unit in _units(pdf, _BLOCK, ("at", "h")):
        m = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
        for role in unit["role"]:
            m = chain(m, _of(role))
        rows.append((*key, m.ravel().tolist()))
    return pd.DataFrame(rows, columns=[*_BLOCK, "m"])


def _chained(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for _, unit in _units(pdf, ("conv",), ("block", "part")):
        ms = [np.array(m, np.int64).reshape(4, 4) for m in unit["m"]]
        cost = np.where(np.arange(4) == START, 0, FAR).astype(np.int64)
        for m in ms:
            cost = np.minimum((cost[:, None] + m).min(0), FAR)
        end = int(np.argmin(cost + ENDS))
        after = trace(ms, START, end)
        total, last = int(cost[end] + ENDS[end]), len(ms) - 1
        for i, block in enumerate(zip(*(unit[k] for k in _BLOCK), strict=True)):
            rows.append((*block, START if i == 0 else after[i - 1], after[i], i == last, total))
    return pd.DataFrame(rows, columns=[*_BLOCK, "enters", "leaves", "final", "cost"])


def opening(state: int) -> str:
    return f"<|{ROLES[state - 1]}|>\n"


CLOSING = "<|end|>\n"


def escaped(text: str) -> str:
    return text.replace("<|", "<||")


def _rendered(pdf: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
    """Each turn with its role and its share of the rendered text; the shares in order are the whole."""
    rows = []
    way = {w[:3]: w[3:] for w in ways[[*_BLOCK, "enters", "leaves", "final", "cost"]].itertuples(index=False, name=None)}
    for (conv, block, part), unit in _units(pdf, _BLOCK, ("at", "h")):
        state, last, final, cost = way[conv, block, part]
        states = trace([_of(r) for r in unit["role"]], int(state), int(last))
        for i, (at, role, text, to) in enumerate(zip(unit["at"], unit["role"], unit["text"], states, strict=True)):
            before, merged, _ = STEPS[state, to]
            out = "" if state == START else "\n" if merged else "\n" + CLOSING
            out += "".join(opening(b) + "\n" + CLOSING for b in before) + ("" if merged else opening(to)) + escaped(text or "")
            added = [ROLES[b - 1] for b in before]
            if final and i == len(states) - 1:
                more = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(to, ())
                out += "\n" + CLOSING + "".join(opening(b) + "\n" + CLOSING for b in more)
                added += [ROLES[b - 1] for b in more]
            rows.append((conv, None if block == UNNUMBERED else int(at), role, ROLES[to - 1], to != state_of(role), merged, ",".join(added), out, int(cost)))
            state = to
    return pd.DataFrame(rows, columns=["conv", "turn", "role", "new_role", "relabelled", "merged", "inserted", "rendered", "cost"]).astype({"turn": "Int64"})


def _parted(turns: DataFrame) -> DataFrame:
    """Adds the part of each row's block: 0, or of crowded blocks the turn's place and a range of hashes."""
    crowd = turns.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED)
    crowd = materialize(crowd.select("conv", "block", F.least(F.lit(40), F.ceil(F.log2(F.col("n") / CROWDED))).cast("int").alias("bits")))
    if crowd.count() <= BROADCAST_ROWS:
        crowd = F.broadcast(crowd)
    low = F.call_function("shiftrightunsigned", F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 64 - F.col("bits"))  # in order of h
    place = F.when(F.col("block") == UNNUMBERED, F.lit(0)).otherwise(F.pmod("at", F.lit(BLOCK)))
    part = F.call_function("shiftleft", place.cast("long"), F.col("bits")) + low
    return turns.join(crowd, ["conv", "block"], "left").withColumn("part", F.coalesce(part, F.lit(0))).drop("bits")


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, new_role, relabelled, merged, inserted, rendered, cost: one row for each turn."""
    small_batches(conversations.sparkSession)
    turn, role, text = F.col("turn").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    block = F.coalesce(F.floor(turn / BLOCK), F.lit(UNNUMBERED))
    c = conversations.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv"), block.alias("block"), F.coalesce(turn, F.lit(0)).alias("at"), role.alias("role"), F.xxhash64(role, text).alias("h"), text.alias("text"))
    # several blocks of turns go to a Python call, as many as fit easily
    groups = max(16, bytes_of(conversations) // GROUP_BYTES)
    dealt = F.pmod(F.xxhash64(*_BLOCK), F.lit(groups))
    c = _parted(c).withColumn("group", dealt)
    sums = c.select("group", *_BLOCK, "at", "role", "h").groupBy("group").applyInPandas(_summed, "conv string, block long, part long, m array<long>")
    ways = sums.withColumn("group", F.pmod(F.xxhash64("conv"), F.lit(groups))).groupBy("group").applyInPandas(_chained, "conv string, block long, part long, enters int, leaves int, final boolean, cost long")
    ways = ways.withColumn("group", dealt)
    out = c.groupBy("group").cogroup(ways.groupBy("group")).applyInPandas(_rendered, "conv string, turn long, role string, new_role string, relabelled boolean, merged boolean, inserted string, rendered string, cost long")
    return out.select(F.when(F.col("conv") != "", F.col("conv").cast("long")).alias("conv_id"), "turn", "role", "new_role", "relabelled", "merged", "inserted", "rendered", "cost")
