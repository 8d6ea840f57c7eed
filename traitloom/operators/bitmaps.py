"""Sets of dense numbers as bitmaps: one row for each key and each 64 numbers of which it has any.

A word is a long, so that unions are ``bit_or`` in Spark's own hash aggregates, before the shuffle
and after it, and a shuffle carries one row for each key and word however many rows there were.
Words without a number have no row, which keeps sparse sets small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.operators.skew import Spread, spread_join
from traitloom.scratch import cut, cut_measured, free_shuffles

WIDTH = 64
_MANY = 2**20  # rows of a round, beyond which its shuffles are freed before the next


def word_of(place: str | Column) -> Column:
    place = F.col(place) if isinstance(place, str) else place
    return F.shiftright(place.cast("bigint"), 6)


def bit_of(place: str | Column) -> Column:
    """The word that holds only this number."""
    place = F.col(place) if isinstance(place, str) else place
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % WIDTH).cast("int"))


def has_bit(bits: Column, bit: Column) -> Column:
    return F.call_function("getbit", bits, bit.cast("int")) == 1


def bitmaps(rows: DataFrame, by: Sequence[str], place: str = "place") -> DataFrame:
    """``(*by, word, bits)`` of rows that name one number each."""
    return united(rows.select(*by, word_of(place).alias("word"), bit_of(place).alias("bits")), by)


def united(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row for each key and word: the union of the rows' bits."""
    return rows.groupBy(*by, "word").agg(F.bit_or("bits").alias("bits"))


def places(rows: DataFrame, name: str = "place") -> DataFrame:
    """A row for each number, in place of word and bits."""
    kept = [c for c in rows.columns if c not in ("word", "bits")]
    bit = F.explode(F.array(*map(F.lit, range(WIDTH)))).alias("_bit")
    each = rows.select(*kept, "word", "bits", bit).where(has_bit(F.col("bits"), F.col("_bit")))
    return each.select(*kept, (F.col("word") * WIDTH + F.col("_bit")).alias(name))


def names_by_word(numbered: DataFrame, name: str, place: str) -> DataFrame:
    """``(word, names)``: the at most 64 ``(bit, name)`` of each word."""
    entry = F.struct((F.col(place) % WIDTH).cast("int").alias("bit"), F.col(name).alias("name"))
    return numbered.groupBy(word_of(place).alias("word")).agg(F.sort_array(F.collect_list(entry)).alias("names"))


def named(rows: DataFrame, numbered: DataFrame, name: str, place: str, settled: bool = False) -> DataFrame:
    """The rows with a name for each number in place of word and bits.

    The names are looked up for a word, not for each of its numbers.
    """
    kept = [c for c in rows.columns if c not in ("word", "bits")]
    met = spread_join(rows, names_by_word(numbered, name, place), "word", salt_by=kept, settled=settled)
    each = met.select(*kept, "bits", F.explode("names").alias("_entry"))
    return each.where(has_bit(F.col("bits"), F.col("_entry.bit"))).select(*kept, F.col("_entry.name").alias(name))


def carried(steps: DataFrame, start: DataFrame, stride: int = 8) -> DataFrame:
    """``(at, word, bits)``: the numbers that any way of one step or more leads to ``at``.

    ``steps`` (at, next) is a table of distinct steps, ``start`` (at, word, bits) says where numbers begin.
    Each round goes ``stride`` steps and is a written table. In a step only the bits that
    the step before brought move on, while all that a place has had in this round stays there; so one join
    and one aggregate tell new bits from old, also in cycles. The round's bits are then set against
    those of earlier rounds in one aggregate. Only what the start leads to is touched. The hot places of the
    steps are looked for once, so that a round is one job; a place has at most a row for every 64 numbers.
    """
    here = steps.select(F.explode(F.array("at", "next")).alias("at")).distinct()
    moves, _ = cut(
        steps.select("at", "next", F.lit(False).alias("stays")).unionByName(
            here.select("at", F.col("at").alias("next"), F.lit(True).alias("stays"))
        ),
        "moves",
    )
    met_by = Spread.of(moves, "at", ["next", "stays"])
    none = F.lit(0).cast("bigint")

    def stepped(state: DataFrame) -> DataFrame:
        met = met_by.join(state)
        kept, came = F.when(F.col("stays"), F.col("bits")).otherwise(none), F.when(F.col("stays"), none).otherwise(F.col("front"))
        moved = met.where("stays OR front <> 0").select(F.col("next").alias("at"), "word", kept.alias("kept"), came.alias("came"))
        merged = moved.groupBy("at", "word").agg(F.bit_or("kept").alias("kept"), F.bit_or("came").alias("came"))
        return merged.select(
            "at", "word", F.col("kept").bitwiseOR(F.col("came")).alias("bits"),
            F.col("came").bitwiseAND(F.bitwise_not("kept")).alias("front"),
        ).where("bits <> 0")

    rounds: list[DataFrame] = []
    frontier = start
    while True:
        state = frontier.select("at", "word", none.alias("bits"), F.col("bits").alias("front"))
        for _ in range(stride):
            state = stepped(state)
        found = state.withColumn("old", none)
        for known in rounds:
            found = found.unionByName(known.select("at", "word", none.alias("bits"), none.alias("front"), F.col("bits").alias("old")))
        if rounds:
            found = found.groupBy("at", "word").agg(*[F.bit_or(c).alias(c) for c in ("bits", "front", "old")])
        new = F.bitwise_not("old")
        fresh, measured = cut_measured(
            found.select(
                "at", "word", F.col("bits").bitwiseAND(new).alias("bits"), F.col("front").bitwiseAND(new).alias("front")
            ).where("bits <> 0"),
            "carried",
            open=F.count_if(F.col("front") != 0),
        )
        if measured["rows"] or not rounds:
            rounds.append(fresh)
        if not measured["rows"] or not measured["open"]:
            break
        if measured["rows"] > _MANY:
            free_shuffles(steps.sparkSession)
        frontier = fresh.where("front <> 0").select("at", "word", F.col("front").alias("bits"))
    reached = rounds[0].select("at", "word", "bits")
    for more in rounds[1:]:
        reached = reached.unionByName(more.select("at", "word", "bits"))
    return cut(united(reached, ["at"]), "reached")[0] if len(rounds) > 1 else reached
