import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from llm_fixtures import TABLES

from traitloom.llm.queries import op13_conversation_repair
from traitloom.llm.turns import (
    GOES, NEVER, START, at_end, before, choices, damaged, matrix_of, power, repair_conversations, runs_of, _times,
)

WHITE = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?")
TURNS = "conv_id bigint, turn bigint, role string, text string"


def naive_damage(rows):
    """[(conv, turn, role, text)] with the faults put in, and all conversations."""
    out = []
    for conv, turn, role, text in rows:
        fold = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fold == 0:
            continue
        text = "" if fold == 1 else re.sub("[.!?]", "", text) if fold == 2 else text
        out += [(conv, turn, "user" if fold == 4 else role, text)] * (2 if fold == 3 else 1)
    return out


def naive_repair(rows):
    """What is expected of [(turn, role, text)], by all ways with the least (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        last = WHITE.findall(text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))

    def fits(initials):
        return any(GOOD.fullmatch(initials + rest) for rest in ("", "a", "ua"))

    best = {"": (0, "", ())}  # by the role initials so far, shortened to what decides

    def short(initials):
        return initials if len(initials) < 2 else "ua" if initials[-1] == "a" else "uau"

    def offer(table, initials, value):
        if fits(initials) and (short(initials) not in table or value[:2] < table[short(initials)][:2]):
            table[short(initials)] = value

    def inserted(table):
        for _ in range(4):
            for initials, (cost, audit, lines) in list(table.items()):
                for role in ("user", "assistant"):
                    offer(table, initials + role[0], (cost + 2, audit + "I", (*lines, f"{role}:")))
        return table

    for (_, role, text), fault in zip(rows, faults):
        then = {}
        for initials, (cost, audit, lines) in inserted(best).items():
            offer(then, initials, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                offer(then, initials + (role[:1] or "?"), (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    offer(then, initials + new[0], (cost + 2 + more, audit + "R", (*lines, f"{new}:{text}")))
        best = then
    cost, audit, lines = min((value for key, value in inserted(best).items() if GOOD.fullmatch(key)), key=lambda x: x[:2])
    turns = [turn for turn, _, _ in rows if turn is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
        sum(pair not in ("su", "ua", "au") for pair in pairs), cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def expected(rows):
    left = {conv: [] for conv, *_ in rows}
    for conv, *row in naive_damage(rows):
        left[conv].append(tuple(row))
    return {conv: naive_repair(turns) for conv, turns in left.items()}


def found(df):
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    result = {row.conv_id: tuple(row[c] for c in columns) for row in rows}
    assert len(result) == len(rows)
    return result


def random_rows(seed, conversations, longest):
    pick = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(pick.randint(1, longest)):
            role = pick.choice(["user", "user", "assistant", "assistant", "system", "tool", "", "usher"])
            text = pick.choice(["Yes.", "no", " \n", "", f"word {turn}!", f"cut {turn}", "é😀?"])
            rows.append((conv, pick.choice([turn, turn, turn, None, turn * 3]), role, text))
    return rows


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TABLES}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op13_conversation_repair(spark, TABLES)) == expected(rows)


@pytest.mark.parametrize("most_rows", [1, 3, 4096])
def test_random_in_pieces(spark, most_rows):
    rows = random_rows(most_rows, 60, 12) + [(None, 1, "user", "Hi."), (None, None, None, None), (77, 0, "user", None)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS piece", "2 AS seen").repartition(3)
    assert found(repair_conversations(damaged(df), most_rows)) == expected(rows)


def test_one_long_conversation(spark):
    """A conversation over all partitions, with long runs and many equal texts."""
    rows = [(1, t, "user", f"q {t}?") for t in range(700)] + [(1, t, "assistant", "Same.") for t in range(700, 900)]
    rows += [(1, t, ("user", "assistant")[t % 2], f"t {t}") for t in range(900, 1500)] + [(2, 0, "system", "S.")]
    df = spark.createDataFrame(rows, TURNS)
    want = expected(rows)
    assert found(repair_conversations(damaged(df), 50)) == want
    assert found(repair_conversations(damaged(df))) == want


def test_nothing_left_and_no_rows(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, gone, "user", "Hi.")], TURNS)
    assert found(repair_conversations(damaged(df))) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair_conversations(damaged(df.limit(0))).count() == 0


def test_powers_are_steps():
    pick = random.Random(3)
    symbols = [("s", 0), ("u", 0), ("a", 0), ("", 0), ("u", 1), ("a", 1), GOES]
    for symbol in symbols:
        for many in (0, 1, 2, 3, 7, 64, 200):
            stepped = at_end()
            for _ in range(many):
                stepped = _times(power(symbol, 0), stepped)
            assert (before(at_end(), symbol, many) == stepped).all()
    runs = runs_of([pick.choice(symbols) for _ in range(50)] + [("u", 1)] * 500)
    assert sum(many for _, many in runs) == 550
    cost = _times(matrix_of(runs), at_end())
    assert cost[START] < NEVER
    # the choices cost what was promised
    audit = "".join(letter for letter, _ in choices(runs, at_end(), START))
    paid = sum({"D": 3, "I": 2, "R": 2, "K": 0}[x] for x in audit)
    left = [fault for symbol, many in runs for fault in [symbol] * many]
    kept = [symbol for symbol, letter in zip(left, audit.replace("I", "")) if letter != "D"]
    assert paid + sum(fault == 1 for _, fault in kept) == cost[START]
    assert np.all(matrix_of([]) == np.where(np.eye(4, dtype=bool), 0, NEVER))
