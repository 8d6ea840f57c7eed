"""Which texts contain any word of a word table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.functions.text import contains_any
from traitloom.operators.skew import spread_join

# Up to this many words are tested inside the scan; more are matched by a join. Both ways
# give the same result.
WORD_LIMIT = 200


def listed(words: DataFrame) -> DataFrame:
    """The different words of a one-column table; a null word is none."""
    word = F.col(words.columns[0])
    return words.select(word.alias("_word")).where(word.isNotNull()).distinct()


def short_list(words: DataFrame, limit: int = WORD_LIMIT) -> list[str] | None:
    """The words of a one-column table, or None if there are more than ``limit``."""
    rows = listed(words).limit(limit + 1).collect()
    return [row[0] for row in rows] if len(rows) <= limit else None


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text where it is compared or joined."""
    return F.unhex(F.md5(text))


def keys_with_word(texts: DataFrame, words: DataFrame) -> DataFrame:
    """Of ``(key, text)``, one row for each key, the keys whose text contains a word.

    A text contains a word of length n exactly if one of its substrings of length n
    equals it, so the test is an equality join. Its rows hold the key and the
    substring, never the text.
    """
    known = listed(words)
    lengths = known.select(F.length("_word").alias("n")).distinct()
    sizes = sorted(row["n"] for row in lengths.collect())  # at most the longest word
    if not sizes:
        return texts.select("key").limit(0)
    # finding a place in a text takes as long as the text before it: cut it into blocks first
    step = F.greatest(F.lit(64), F.ceil(F.sqrt(F.length("text"))).cast("int"))
    blocks = (
        texts.select("key", "text", step.alias("step"), F.explode(F.lit(sizes)).alias("n"))
        .where(F.length("text") >= F.col("n"))
        .select("key", "text", "step", "n", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("n") + 1, "step")).alias("at"))
        .select("key", "n", "step", F.substr("text", F.col("at"), F.col("step") + F.col("n") - 1).alias("block"))
    )
    last = F.least(F.col("step"), F.length("block") - F.col("n") + 1)
    pieces = blocks.select("key", "n", "block", F.explode(F.sequence(F.lit(1), last)).alias("at")).select(
        "key", F.substr("block", F.col("at"), F.col("n")).alias("_word")
    )
    return spread_join(pieces, known, "_word", "left_semi", ["key"]).select("key").distinct()


def flag_texts(
    df: DataFrame, text: str, words: DataFrame, flag: str, limit: int = WORD_LIMIT
) -> DataFrame:
    """Add the boolean ``flag``: the column ``text`` contains one of the words.

    A null text contains none.
    """
    few = short_list(words, limit)
    if few is not None:
        return df.withColumn(flag, F.coalesce(contains_any(F.col(text), few), F.lit(False)))
    keyed = df.withColumn("_key", text_key(F.col(text)))
    # any text of a key is the text of that key
    texts = keyed.groupBy(F.col("_key").alias("key")).agg(F.any_value(text).alias("text"))
    hits = keys_with_word(texts, words).select(F.col("key").alias("_key"), F.lit(True).alias("_hit"))
    return spread_join(keyed, hits, "_key", "left").select(
        *df.columns, F.coalesce("_hit", F.lit(False)).alias(flag)
    )
