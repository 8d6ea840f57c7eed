"""Readers of the tab-separated inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.functions.text import after, before, strip
from traitloom.operators.classify import allele_status
from traitloom.sources.lines import POSITION, cell, read_lines, read_rows, wide_enough
from traitloom.species import Species


def read_phenotypes(
    spark: SparkSession, path, species: Species, on_short: str = "fail"
) -> DataFrame:
    """Phenotype rows as ``cells``, with the species' test on the column count."""
    return (
        read_rows(spark, path)
        .where(wide_enough(species.min_columns, species.read_columns, on_short))
        .select("cells")
    )


def read_annotations(
    spark: SparkSession,
    path,
    species: Species,
    exclude_not: bool = False,
    on_short: str = "fail",
) -> DataFrame:
    """``(gene, term)`` and ``POSITION`` of the rows from the species' database.

    Negated rows (a ``NOT`` qualifier) count like any other unless excluded.
    """
    need = max(species.annotation_gene, 4) + 1
    gene = cell(species.annotation_gene)
    if species.first_synonym:
        gene = before(gene, "|")
    mine = cell(0) == species.source_db
    rows = read_rows(spark, path).where(
        F.when(mine, wide_enough(0, need, on_short)).otherwise(False)
    )
    if exclude_not:
        rows = rows.where(~F.array_contains(F.split(cell(3), r"\|"), "NOT"))
    return rows.select(gene.alias("gene"), cell(4).alias("term"), *POSITION)


def read_term_list(spark: SparkSession, path) -> DataFrame:
    """Distinct ids of a term list with an ``ID`` header; empty ids are dropped."""
    return (
        read_rows(spark, path)
        .select(cell(0).alias("term"))
        .where((F.col("term") != "ID") & (F.col("term") != ""))
        .distinct()
    )


def _read_headed(spark: SparkSession, path, columns: int) -> DataFrame:
    schema = ", ".join(f"c{i} string" for i in range(columns))
    return spark.read.csv(path, schema=schema, sep="\t", quote='"', escape='"', header=True)


def read_driver_lines(spark: SparkSession, path) -> DataFrame:
    """Distinct driver-line names; the header and empty names are dropped."""
    rows = _read_headed(spark, path, 3)
    return rows.where(F.col("c2").isNotNull()).select(F.col("c2").alias("name")).distinct()


def read_assignments(spark: SparkSession, path) -> DataFrame:
    """Genes confirmed as *melanogaster* and not withdrawn; the first line is a header."""
    rows = _read_headed(spark, path, 5)
    return (
        rows.where((F.coalesce("c3", F.lit("")) != "Withdrawn") & (F.col("c4") == "melanogaster"))
        .select(F.coalesce("c0", F.lit("")).alias("gene"))
        .distinct()
    )


def read_allele_observations(spark: SparkSession, path) -> DataFrame:
    """Allele phenotype records with the derived gene, context and status.

    Lines are stripped before the columns are counted, so a row whose last
    columns are empty may fall short of four and is dropped.
    """
    parts = F.col("parts")
    return (
        read_lines(spark, path)
        .where((strip(F.col("value")) != "") & ~F.col("value").startswith("#"))
        .select(F.split(strip(F.col("value")), "\t", -1).alias("parts"), *POSITION)
        .where(F.size("parts") >= 4)
        .select(
            before(parts[0], "[").alias("gene"),
            parts[0].alias("allele"),
            parts[1].alias("fb_id"),
            parts[2].alias("phenotype"),
            after(parts[2], "with").alias("context"),
            allele_status(parts[2]).alias("simple_pheno"),
            parts[3].alias("reference"),
            *POSITION,
        )
    )
