"""OBO ontologies and term ids in free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.functions.text import all_matches, first_token, strip, tag_of, value_of
from traitloom.sources.lines import POSITION, read_lines

_TERM_HEADER = r"(?m)^[ \t]*\[Term\][ \t]*\r?$"
_OTHER_HEADER = r"(?m)^[ \t]*\[[A-Za-z]+\][ \t]*\r?$"


def read_stanzas(spark: SparkSession, path) -> DataFrame:
    """One row per ``[Term]`` stanza: ``id, name, is_a, alt_id, is_obsolete``.

    The record separator of the text source cuts the file at term headers, so a
    plain file is read in parallel. Other stanzas and the file header, which
    carries no id, are dropped.
    """
    blocks = read_lines(spark, path, separator="\n[Term]").select(
        F.explode(F.split("value", _TERM_HEADER)).alias("block"), *POSITION
    )
    lines = F.filter(
        F.transform(F.split(F.split("block", _OTHER_HEADER)[0], "\n"), strip),
        lambda line: line.contains(": "),
    )

    def values(tag: str):
        return F.transform(F.filter("lines", lambda line: tag_of(line) == tag), value_of)

    return (
        blocks.select(lines.alias("lines"), *POSITION)
        .select(
            F.get(values("id"), F.lit(0)).alias("id"),
            F.element_at(F.concat(F.array(F.lit(None).cast("string")), values("name")), -1).alias("name"),
            F.transform(values("is_a"), first_token).alias("is_a"),
            values("alt_id").alias("alt_id"),
            F.array_contains(values("is_obsolete"), "true").alias("is_obsolete"),
            *POSITION,
        )
        .where(F.col("id").isNotNull())
    )


def term_names(stanzas: DataFrame) -> DataFrame:
    """``(term, name)``, the last name in the file where an id is repeated."""
    return (
        stanzas.where(F.col("name") != "")
        .groupBy(F.col("id").alias("term"))
        .agg(F.max_by("name", F.struct(*POSITION)).alias("name"))
    )


def with_prefix(stanzas: DataFrame, prefix: str) -> DataFrame:
    return stanzas.where(F.col("id").startswith(prefix))


def ids_in_text(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Every distinct match of ``pattern`` in a text column, sorted."""
    return (
        df.select(F.explode(all_matches(F.col(column), pattern)).alias("id"))
        .distinct()
        .orderBy("id")
    )
