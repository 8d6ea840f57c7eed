"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.scratch import cut

_UNITS = {"b": 1, "k": 2**10, "m": 2**20, "g": 2**30}


def _threshold(spark) -> int:
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").lower().rstrip("b")
    if text and text[-1] in _UNITS:
        return int(text[:-1]) * _UNITS[text[-1]]
    return int(text)


def spark_will_broadcast(df: DataFrame) -> bool:
    """True if Spark's own size estimate puts ``df`` under its broadcast threshold."""
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return estimate <= _threshold(df.sparkSession)


def hot_keys(df: DataFrame, on: Sequence[str], salts: str) -> tuple[DataFrame, int]:
    """Keys that fill at least one average shuffle partition, with their salt counts.

    With ``p`` shuffle partitions a key is listed if it holds 1/p of the rows or
    more, so there are at most ``p`` of them whatever the size of ``df``.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = df.select(F.count(F.lit(1)).alias("_total")).scalar()
    return cut(
        counts.where(F.col("_n") * parts >= total).select(
            *on, F.ceil(F.col("_n") * parts / total).cast("int").alias(salts)
        ),
        "hot-keys",
    )


def _dealt(columns: Sequence[str], salts: str) -> Column:
    """The salt of a row: a hash of its columns, 0 where the key is not hot."""
    return F.when(F.col(salts).isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(*columns), F.col(salts)).cast("int")
    )


def _repeated(salts: str) -> Column:
    """One row for each salt of the key."""
    return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1))


def spread_join(
    many: DataFrame,
    few: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    salt_by: Sequence[str] | None = None,
    few_salt_by: Sequence[str] | None = None,
    settled: bool = False,
) -> DataFrame:
    """Join ``many`` (left) with ``few``, salting the keys that are hot.

    Where Spark's estimate lets it broadcast a side there is no shuffle and so
    nothing to salt. Otherwise each key that is hot in ``many`` is split over as
    many salts as it fills partitions, and the rows of ``few`` are repeated for
    those keys only. The salt is a hash of ``salt_by`` (all other columns by
    default), never a random number, so that a retried task sends each row to
    the same place; ``many`` must have been reduced to rows that differ in these
    columns. ``few`` may have several rows for a key in an inner join: with
    ``few_salt_by`` its own hot keys are split the same way.

    Unless ``many`` is ``settled``, a written table or little more, it is
    written first, so that counting its keys does not run its plan twice.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if few_salt_by is not None and how != "inner":
        raise ValueError("the right side can be salted in an inner join only")
    if spark_will_broadcast(few) or (how == "inner" and spark_will_broadcast(many)):
        return many.join(few, keys, how)
    if not settled:
        many, _ = cut(many, "many")
    hot, found = hot_keys(many, keys, "_salts")
    if few_salt_by is None:
        hot = hot.withColumn("_few_salts", F.lit(None).cast("int"))
    else:
        few, _ = cut(few, "few")  # its keys are counted, too
        few_hot, few_found = hot_keys(few, keys, "_few_salts")
        hot, found = hot.join(few_hot, keys, "full"), found + few_found
    if found == 0:
        return many.join(few, keys, how)
    # at most twice spark.sql.shuffle.partitions rows
    hot = F.broadcast(hot)
    salted_many = (
        many.join(hot, keys, "left")
        .withColumn("_salt", _dealt(salt_by or [c for c in many.columns if c not in keys], "_salts"))
        .withColumn("_few_salt", _repeated("_few_salts"))
        .drop("_salts", "_few_salts")
    )
    salted_few = (
        few.join(hot, keys, "left")
        .withColumn("_few_salt", _dealt(few_salt_by or keys, "_few_salts"))
        .withColumn("_salt", _repeated("_salts"))
        .drop("_salts", "_few_salts")
    )
    return salted_many.join(salted_few, [*keys, "_salt", "_few_salt"], how).drop("_salt", "_few_salt")


@dataclass(frozen=True)
class Spread:
    """A written table whose hot keys were found and salted once, for inner joins with many tables in turn."""

    many: DataFrame
    on: str
    hot: DataFrame | None  # key, _salts: at most spark.sql.shuffle.partitions rows

    @staticmethod
    def of(many: DataFrame, on: str, salt_by: Sequence[str]) -> Spread:
        """``salt_by`` tells the rows of a key apart, as in ``spread_join``."""
        if spark_will_broadcast(many):
            return Spread(many, on, None)
        hot, found = hot_keys(many, [on], "_salts")
        if found == 0:
            return Spread(many, on, None)
        salted = many.join(F.broadcast(hot), on, "left").withColumn("_salt", _dealt(salt_by, "_salts"))
        return Spread(salted.drop("_salts"), on, hot)

    def join(self, few: DataFrame) -> DataFrame:
        if self.hot is None:
            return self.many.join(few, self.on)
        repeated = few.join(F.broadcast(self.hot), self.on, "left").withColumn("_salt", _repeated("_salts"))
        return self.many.join(repeated.drop("_salts"), [self.on, "_salt"]).drop("_salt")
