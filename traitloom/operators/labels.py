"""Roll-ups of observations to one row per gene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The four summary texts.
BOTH = "sometimes lethal, sometimes viable (context-dependent)"
ONLY_LETHAL = "always lethal in data"
ONLY_VIABLE = "always viable in data"
NEITHER = "no lethal/viable phenotypes found"


def evidence(observations: DataFrame, lethal: Sequence[str] = ("lethal",)) -> DataFrame:
    """``(gene, ever_lethal, ever_viable)``; the aggregate combines before the shuffle."""
    return observations.groupBy("gene").agg(
        F.bool_or(F.col("status").isin(*lethal)).alias("ever_lethal"),
        F.bool_or(F.col("status") == "viable").alias("ever_viable"),
    )


def label(
    observations: DataFrame, lethal: Sequence[str] = ("lethal",), mixed: str = "lethal_wins"
) -> DataFrame:
    """``(gene, status)``: lethal with any lethal evidence, else viable.

    ``mixed='drop'`` leaves out genes that have lethal and viable evidence.
    """
    if mixed not in ("lethal_wins", "drop"):
        raise ValueError(f"mixed must be 'lethal_wins' or 'drop', not {mixed!r}")
    rolled = evidence(observations, lethal)
    if mixed == "drop":
        rolled = rolled.where(~(F.col("ever_lethal") & F.col("ever_viable")))
    return rolled.select(
        "gene", F.when(F.col("ever_lethal"), "lethal").otherwise("viable").alias("status")
    )


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("status").agg(F.count(F.lit(1)).alias("genes"))


def summary_text(ever_lethal: Column, ever_viable: Column) -> Column:
    return (
        F.when(ever_lethal & ever_viable, BOTH)
        .when(ever_lethal, ONLY_LETHAL)
        .when(ever_viable, ONLY_VIABLE)
        .otherwise(NEITHER)
    )


def gene_summary(observations: DataFrame) -> DataFrame:
    """``(gene, ever_lethal, ever_viable, summary)`` with boolean flags."""
    return evidence(observations).withColumn(
        "summary", summary_text(F.col("ever_lethal"), F.col("ever_viable"))
    )
