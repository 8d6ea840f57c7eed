"""Repair of the turn structure of conversations by a run-length dynamic program.

A turn is a symbol: the initial of its role and whether it is truncated, or that it has to go.
What a turn costs is a small min-plus matrix from states (nothing yet, after s, after u,
after a) to states. Equal symbols in a row are one run, and a run is passed through the
binary powers of its matrix, which are made once. The costs to the end, taken
backwards over the runs, then tell the choices one by one.

Matrices also make long conversations divisible: rows are sorted by conversation and turn over all
partitions and cut into pieces of bounded size. A conversation of one piece is repaired where
it stands. For the others the matrices of the pieces give the costs behind each piece, these the
state in which each piece ends for each state that it begins in, and these states its own choices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from traitloom.llm.common import arrow_rows, map_rows, ship
from traitloom.operators.skew import spread_join
from traitloom.scratch import cut

WHITE = " \t\n\x0b\x0c\r"
# Costs of the edits; a truncated turn that stays adds one.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

NEVER = 2**60
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
SPOKEN = (USER, USER, ASSISTANT, USER)  # the state after a turn of the role that is due
NAMES = {USER: "user", ASSISTANT: "assistant"}
GOES = ("", 2)  # the symbol of a turn that has to be deleted


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product of a matrix and a matrix or vector."""
    if b.ndim == 1:
        return np.minimum((a + b[None, :]).min(axis=1), NEVER)
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


@cache
def _inserts() -> np.ndarray:
    """What any number of inserted turns costs."""
    one = np.full((4, 4), NEVER)
    for state in range(4):
        one[state, state] = 0
        one[state, SPOKEN[state]] = min(one[state, SPOKEN[state]], INSERT)
    return _times(_times(one, one), one)


@cache
def power(symbol: tuple[str, int], k: int) -> np.ndarray:
    """The matrix of 2^k turns of a symbol (initial, fault), inserts before each turn included."""
    if k:
        return _times(power(symbol, k - 1), power(symbol, k - 1))
    initial, fault = symbol
    turn = np.full((4, 4), NEVER)
    for state in range(4):
        turn[state, state] = DELETE
        if symbol != GOES:
            turn[state, SPOKEN[state]] = min(turn[state, SPOKEN[state]], REROLE + fault * TRUNCATED)
            if (state, initial) in KEPT:
                turn[state, KEPT[state, initial]] = fault * TRUNCATED
    return _times(_inserts(), turn)


def before(after: np.ndarray, symbol: tuple[str, int], many: int) -> np.ndarray:
    """The costs to the end before ``many`` turns of a symbol, from those after them; also of a matrix."""
    k = 0
    while many >> k:
        if many >> k & 1:
            after = _times(power(symbol, k), after)
        k += 1
    return after


END = np.array([0, NEVER, NEVER, 0])  # a repaired conversation is empty or ends with the assistant


def at_end() -> np.ndarray:
    """The costs to the end when no turn is left."""
    return _times(_inserts(), END)


def runs_of(symbols: list[tuple[str, int]]) -> list[tuple[tuple[str, int], int]]:
    runs: list = []
    for symbol in symbols:
        if runs and runs[-1][0] == symbol:
            runs[-1] = (symbol, runs[-1][1] + 1)
        else:
            runs.append((symbol, 1))
    return runs


def matrix_of(runs: list) -> np.ndarray:
    matrix = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for symbol, many in reversed(runs):
        matrix = before(matrix, symbol, many)
    return matrix


def _unrolled(symbol: tuple[str, int], many: int, after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The costs before and after each turn of a run; long runs are halved, so that few vectors are held."""
    if many > 64:
        half = many // 2
        yield from _unrolled(symbol, many - half, before(after, symbol, half))
        yield from _unrolled(symbol, half, after)
        return
    costs = [after]
    for _ in range(many):
        costs.append(_times(power(symbol, 0), costs[-1]))
    for i in range(many, 0, -1):
        yield costs[i], costs[i - 1]


def choices(runs: list, after: np.ndarray, state: int, last: bool = True) -> Iterator[tuple[str, int]]:
    """(initial of the edit, state behind it), one by one: the cheapest, of these the ASCII-least.

    Each edit leads to one state, so that the least letter that keeps the costs is right. ``last``:
    what is still to be inserted at the end comes, too.
    """
    behind = [after]
    for symbol, many in reversed(runs):
        behind.append(before(behind[-1], symbol, many))
    for (symbol, many), then in zip(runs, reversed(behind[:-1])):
        initial, fault = symbol
        kept = [KEPT.get((state, initial)) for state in range(4)]
        for here, there in _unrolled(symbol, many, then):
            while True:
                cost = here[state]
                if DELETE + there[state] == cost:
                    yield "D", state
                    break
                if INSERT + here[SPOKEN[state]] == cost:
                    state = SPOKEN[state]
                    yield "I", state
                    continue
                if symbol != GOES and kept[state] is not None and fault * TRUNCATED + there[kept[state]] == cost:
                    state = kept[state]
                    yield "K", state
                else:
                    state = SPOKEN[state]
                    yield "R", state
                break
    while last and after[state]:
        state = SPOKEN[state]
        yield "I", state


def is_blank(text: str) -> bool:
    return not text.strip(WHITE)


def symbols_of(roles: list, texts: list, times: list, seen: set | None = None) -> tuple[list[tuple[str, int]], list[int], list[int]]:
    """The symbols of a piece's turns, the row of each, and how many are (blank, duplicate, truncated).

    ``seen``: rows whose role and text have been seen earlier; without it, earlier in these rows.
    """
    known, symbols, rows, faults = set(), [], [], [0, 0, 0]
    for i, (role, text, many) in enumerate(zip(roles, texts, times)):
        for copy in range(many):
            repeated = copy > 0 or (i in seen if seen is not None else (role, text) in known)
            if is_blank(text):
                fault = 0
            elif repeated:
                fault = 1
            else:
                fault = 2 if text.rstrip(WHITE)[-1] not in ".!?" else None
            if fault is not None:
                faults[fault] += 1
            symbols.append(GOES if fault in (0, 1) else (role[:1] if role[:1] in "sua" else "", int(fault == 2)))
            rows.append(i)
        if many and seen is None:
            known.add((role, text))
    return symbols, rows, faults


def illegal_pairs(roles: list, times: list) -> int:
    initials = [role[:1] for role, many in zip(roles, times) for _ in range(many)]
    return sum(not legal(a, b) for a, b in zip(initials, initials[1:]))


def edited(roles, texts, rows, runs, after, state, last=True) -> tuple[str, list[str]]:
    """The audit of a piece and its repaired turns."""
    audit, lines, at = [], [], 0
    for letter, state in choices(runs, after, state, last):
        audit.append(letter)
        if letter == "I":
            lines.append(f"{NAMES[state]}:")
            continue
        if letter != "D":
            role = roles[rows[at]] if letter == "K" else NAMES[state]
            lines.append(f"{role}:{texts[rows[at]]}")
        at += 1
    return "".join(audit), lines


def span_of(turns: list, times: list) -> tuple[int, int, int]:
    """The first, the last and the number of the different turns that are not null; 0, 0, 0 without any."""
    there = [turn for turn, many in zip(turns, times) if many and turn is not None]
    return (there[0], there[-1], len(set(there))) if there else (0, 0, 0)


def legal(a: str, b: str) -> bool:
    return (a, b) in {("s", "u"), ("u", "a"), ("a", "u")}


def in_pieces(rows: DataFrame, most_rows: int, most_chars: int) -> DataFrame:
    """Rows (conv_id, piece, whole, turns, roles, texts, times), pieces numbered in the order of the sorted rows.

    A piece holds rows of one conversation, up to ``most_rows`` of them or ``most_chars`` of
    text and one row more. It is ``whole`` if the conversation certainly has no other piece.
    """
    text = rows.schema["conv_id"].dataType
    lists = "turns array<bigint>, roles array<string>, texts array<string>, times array<int>"
    schema = StructType([StructField("conv_id", text), *StructType.fromDDL(f"piece bigint, whole boolean, {lists}")])

    class Open:
        """The piece that is being filled, and those that are done."""

        def __init__(self, first: int):
            self.at, self.started, self.conv, self.rows, self.chars, self.split = first, False, None, [], 0, True
            self.done: list[dict] = []

        def close(self, ends: bool) -> None:
            """``ends``: the next row is one of another conversation."""
            if self.rows:
                turns, roles, texts, times = map(list, zip(*self.rows))
                whole = ends and not self.split
                self.done.append(
                    {"conv_id": self.conv, "piece": self.at, "whole": whole, "turns": turns, "roles": roles, "texts": texts, "times": times}
                )
                self.at += 1
            self.rows, self.chars, self.split = [], 0, not ends

        def add(self, conv, row: tuple) -> None:
            if self.started and conv != self.conv:
                self.close(ends=True)
            elif len(self.rows) >= most_rows or self.chars >= most_chars:
                self.close(ends=False)
            self.started, self.conv = True, conv
            self.rows.append(row)
            self.chars += len(row[2])

    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition's first and last conversation may go on in its neighbours
        pieces = Open(TaskContext.get().partitionId() << 33)
        made = to_arrow_schema(schema)
        for batch in batches:
            for row in zip(*(batch[name].to_pylist() for name in ("conv_id", "turn", "role", "text", "times"))):
                pieces.add(row[0], row[1:])
            yield pa.RecordBatch.from_pylist(pieces.done, schema=made)
            pieces.done = []
        pieces.close(ends=False)
        yield pa.RecordBatch.from_pylist(pieces.done, schema=made)

    return rows.mapInArrow(run, schema)


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _whole_repaired(pieces: DataFrame) -> DataFrame:
    """The result of conversations that are one piece."""
    schema = StructType([pieces.schema["conv_id"], *StructType.fromDDL(RESULT)])

    def run(batch: pa.RecordBatch) -> dict:
        out = {name: [] for name in schema.names}
        for conv, turns, roles, texts, times in zip(*(batch[c].to_pylist() for c in ("conv_id", "turns", "roles", "texts", "times"))):
            symbols, rows, faults = symbols_of(roles, texts, times)
            runs, end = runs_of(symbols), at_end()
            audit, lines = edited(roles, texts, rows, runs, end, START)
            first, last, many = span_of(turns, times)
            cost = end
            for symbol, length in reversed(runs):
                cost = before(cost, symbol, length)
            row = (
                conv, last - first + 1 - many if many else 0, *faults, illegal_pairs(roles, times),
                int(cost[START]), audit, hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest(),
            )
            for name, value in zip(schema.names, row):
                out[name].append(value)
        return out

    return map_rows(pieces, run, schema)


def _seen_rows(pieces: DataFrame) -> DataFrame:
    """(piece, seen): the places in a piece of rows whose role and text the conversation has earlier."""
    rows = pieces.select(
        "conv_id", "piece", F.posexplode(F.arrays_zip("roles", "texts", "times")).alias("at", "row")
    ).where("row.times > 0")
    key = F.md5(F.concat(F.length("row.roles").cast("string"), F.lit(":"), "row.roles", "row.texts"))
    keyed = rows.select("piece", "at", F.to_json(F.struct("conv_id", key.alias("text"))).alias("key"))
    firsts = keyed.groupBy("key").agg(F.min(F.struct("piece", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = firsts.where("n > 1").select("key", "first")
    again = spread_join(keyed, repeated, "key", salt_by=["piece", "at"]).where("struct(piece, at) > first")
    return again.groupBy("piece").agg(F.collect_list("at").alias("seen"))


def _parts_repaired(pieces: DataFrame) -> DataFrame:
    """The result of conversations of several pieces."""
    seen = _seen_rows(pieces)
    marked, _ = cut(
        pieces.join(seen, "piece", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<int>"))), "marked"
    )
    conv = pieces.schema["conv_id"]

    def read(batch: pa.RecordBatch, *more: str) -> Iterator[tuple]:
        yield from zip(*(batch[c].to_pylist() for c in ("conv_id", "piece", "turns", "roles", "texts", "times", "seen", *more)))

    sums = "matrix array<bigint>, first bigint, last bigint, turns bigint, head string, tail string, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
    sum_schema = StructType([conv, *StructType.fromDDL(f"piece bigint, {sums}")])

    def summed(batch: pa.RecordBatch) -> dict:
        out = {name: [] for name in sum_schema.names}
        for key, piece, turns, roles, texts, times, seen in read(batch):
            symbols, _, faults = symbols_of(roles, texts, times, set(seen))
            there = [role[:1] for role, many in zip(roles, times) if many]
            row = (
                key, piece, matrix_of(runs_of(symbols)).ravel().tolist(), *span_of(turns, times),
                there[0] if there else None, there[-1] if there else None, *faults, illegal_pairs(roles, times),
            )
            for name, value in zip(sum_schema.names, row):
                out[name].append(value)
        return out

    sums_table, _ = cut(map_rows(marked, summed, sum_schema), "sums")
    totals = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
    names = [column.split()[0] for column in totals.split(", ")]

    def costs(group: pd.DataFrame) -> pd.DataFrame:
        """The costs behind each piece, and on the first piece what is summed over all."""
        group = group.sort_values("piece")
        behind = [at_end()]
        for matrix in reversed(group["matrix"].tolist()):
            behind.append(_times(np.array(matrix, dtype=np.int64).reshape(4, 4), behind[-1]))
        full = group[group["head"].notna()]
        turned = group[group["turns"] > 0]
        lowest, highest = turned["first"].tolist(), turned["last"].tolist()
        distinct = int(turned["turns"].sum()) - sum(a == b for a, b in zip(highest, lowest[1:]))
        pairs = list(zip(full["tail"].tolist(), full["head"].tolist()[1:]))
        own = [
            int(highest[-1] - lowest[0] + 1 - distinct) if lowest else 0,
            *(int(group[name].sum()) for name in names[1:4]),
            int(group["illegal"].sum()) + sum(not legal(a, b) for a, b in pairs),
            int(behind[-1][START]),
        ]
        frame = pd.DataFrame({"piece": group["piece"].to_numpy(), "behind": [x.tolist() for x in behind[-2::-1]]})
        frame["last"] = [False] * (len(frame) - 1) + [True]
        for name, value in zip(names, own):
            frame[name] = pd.array([value] + [None] * (len(frame) - 1), dtype="Int64")
        return frame

    costed = sums_table.groupBy("conv_id").applyInPandas(costs, f"piece bigint, behind array<bigint>, last boolean, {totals}")
    ready, _ = cut(marked.join(costed, "piece"), "costed")

    def leads(batch: pa.RecordBatch) -> dict:
        """The state at the end of a piece for each at its beginning; -1 where there is no way on."""
        out = {"conv_id": batch["conv_id"], "piece": batch["piece"], "ends": []}
        for _, _, _, roles, texts, times, seen, behind in read(batch, "behind"):
            runs = runs_of(symbols_of(roles, texts, times, set(seen))[0])
            after = np.array(behind, dtype=np.int64)
            ahead = after
            for symbol, many in reversed(runs):
                ahead = before(ahead, symbol, many)
            ends = []
            for state in range(4):
                if ahead[state] < NEVER:
                    for _, state in choices(runs, after, state, last=False):
                        pass
                    ends.append(state)
                else:
                    ends.append(-1)
            out["ends"].append(ends)
        return out

    def starts(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece")
        states = [START]
        for ends in group["ends"].tolist():
            states.append(int(ends[states[-1]]))
        return pd.DataFrame({"piece": group["piece"].to_numpy(), "start": states[:-1]})

    led = map_rows(ready, leads, StructType([conv, *StructType.fromDDL("piece bigint, ends array<int>")]))
    started = led.groupBy("conv_id").applyInPandas(starts, "piece bigint, start int")
    part_schema = StructType([conv, *StructType.fromDDL(f"piece bigint, audit string, lines string, n_lines bigint, {totals}")])

    def unrolled(batch: pa.RecordBatch) -> dict:
        out = {name: batch[name] for name in ("conv_id", "piece", *names)} | {"audit": [], "lines": [], "n_lines": []}
        for _, _, _, roles, texts, times, seen, behind, last, state in read(batch, "behind", "last", "start"):
            symbols, rows, _ = symbols_of(roles, texts, times, set(seen))
            audit, lines = edited(roles, texts, rows, runs_of(symbols), np.array(behind, dtype=np.int64), state, last)
            out["audit"].append(audit)
            out["lines"].append("\n".join(lines))
            out["n_lines"].append(len(lines))
        return out

    parts = map_rows(ready.join(started, "piece"), unrolled, part_schema)
    schema = StructType([conv, *StructType.fromDDL(RESULT)])

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Audits and digests of the conversations, piece after piece; a digest can only be taken in order."""
        made, own, audits, digest, any_line = to_arrow_schema(schema), None, [], None, False

        def row():
            return pa.RecordBatch.from_pylist(
                [dict(zip(schema.names, (*own, "".join(audits), digest.hexdigest())))], schema=made
            )

        for batch in batches:
            for record in batch.to_pylist():
                if record["cost"] is not None:  # a conversation's first piece
                    if own is not None:
                        yield row()
                    own, audits, digest, any_line = [record["conv_id"], *(record[n] for n in names)], [], hashlib.sha256(), False
                if record["n_lines"]:
                    digest.update(("\n" if any_line else "").encode() + record["lines"].encode("utf-8", "surrogatepass"))
                    any_line = True
                audits.append(record["audit"])
        if own is not None:
            yield row()

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return ordered.mapInArrow(assembled, schema)


def repair_conversations(turns: DataFrame, most_rows: int = 4096, most_chars: int = 2**20) -> DataFrame:
    """One row for each conv_id of ``turns`` (conv_id, turn, role, text, times): faults, cost, audit and digest.

    ``times`` says how often a row stands there; 0 only makes its conversation known. Rows are taken by turn,
    null first, those of equal turn by role, then text. Each row's first fault counts: blank, duplicate
    (role and text seen earlier), truncated. Blank rows and duplicates are deleted (3); others are kept, deleted
    or given the role that is due (2); empty turns are inserted (2), so that the initials of the roles
    read ``(s?(ua)+)?``. Of the cheapest ways the one with the ASCII-least audit is taken.

    A null role or text counts as one space; a null conv_id is a conversation of its own. A conversation
    without rows has zeros, an empty audit and the digest of an empty text. Other columns are not
    read. A conversation may hold any share of all rows: its pieces (at most ``most_rows`` rows or
    ``most_chars`` of text and a row more) are worked on apart. In one task go a few numbers for each piece
    and, for the digest, which has to be taken in order, the pieces' texts one after the other.
    """
    kept = turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.col("times").cast("int").alias("times"),
    )
    by = ["conv_id", "turn", "role"]
    ordered = kept.repartitionByRange(*by, F.substring("text", 1, 32)).sortWithinPartitions(*by, "text")
    with arrow_rows(turns.sparkSession, 1000):
        pieces, _ = cut(in_pieces(ordered, most_rows, most_chars), "pieces")
    whole = _whole_repaired(pieces.where("whole"))
    return whole.unionByName(_parts_repaired(pieces.where("not whole")))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults that crc32 of ``conv_id:turn`` chooses, and how often each row stands there.

    Of twenty rows one is dropped (times 0), one emptied, one loses its end marks, one stands twice and one
    is given the role user. Nulls count as one space.
    """

    def full(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    drawn = F.crc32(F.concat(full("conv_id"), F.lit(":"), full("turn")).cast("binary")) % 20
    text = F.when(drawn == 1, "").when(drawn == 2, F.translate(full("text"), ".!?", "")).otherwise(full("text"))
    return conversations.select(
        "conv_id", "turn", F.when(drawn == 4, "user").otherwise(full("role")).alias("role"),
        F.when(drawn == 0, "").otherwise(text).alias("text"), F.when(drawn == 0, 0).when(drawn == 3, 2).otherwise(1).alias("times"),
    )
