"""Labelled genes joined to their ontology terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.operators.ordering import dense_index
from traitloom.operators.skew import spread_join


def annotate(labels: DataFrame, annotations: DataFrame) -> DataFrame:
    """``(gene, status, term, copies)``: inner join, one row per gene and term.

    Repeated annotations are counted before the shuffle and kept as ``copies``,
    so a gene with very many equal rows stays small.
    """
    counted = annotations.groupBy("gene", "term").agg(F.count(F.lit(1)).alias("copies"))
    return spread_join(counted, labels, "gene", salt_by=["term"]).select(
        "gene", "status", "term", "copies"
    )


def genes_of(annotated: DataFrame) -> DataFrame:
    """``(gene, status)`` of the labelled genes that have at least one annotation.

    Grouped by the gene alone, so that a later join on it needs no new shuffle.
    """
    lethal = annotated.groupBy("gene").agg(F.bool_or(F.col("status") == "lethal").alias("lethal"))
    return lethal.select("gene", F.when(F.col("lethal"), "lethal").otherwise("viable").alias("status"))


def restrict_genes(annotated: DataFrame, genes: DataFrame) -> DataFrame:
    """Left semi join with a gene list."""
    return spread_join(annotated, genes.select("gene").distinct(), "gene", "left_semi", ["term"])


def term_positions(annotations: DataFrame, order: list[str]) -> DataFrame:
    """Add ``nth``, the place of each annotation in its gene's list, from 0.

    ``order`` must tell all rows of a gene apart, as the place in a file does.
    All rows are numbered in one global order over range partitions, so the
    list of a large gene is spread over many tasks; the gene's first number is
    then subtracted.
    """
    numbered, _ = dense_index(annotations, ["gene", *order], "_at")
    first = numbered.groupBy("gene").agg(F.min("_at").alias("_first"))
    return spread_join(numbered, first, "gene", salt_by=["_at"], settled=True).select(
        *annotations.columns, (F.col("_at") - F.col("_first")).alias("nth")
    )


def without_first(annotations: DataFrame, order: list[str]) -> DataFrame:
    """Drop one annotation per gene: the first in ``order``."""
    key = ["gene", *order, "term"]
    counted = annotations.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    first = (
        annotations.groupBy("gene")
        .agg(F.min(F.struct(*order, "term")).alias("first"))
        .select("gene", "first.*", F.lit(1).alias("_gone"))
    )
    # the join key is the whole row, so no gene is hot in it
    return (
        counted.join(first, key, "left")
        .withColumn("copies", F.col("copies") - F.coalesce("_gone", F.lit(0)))
        .where(F.col("copies") > 0)
        .drop("_gone")
    )


def unknown_terms(terms: DataFrame, nodes: DataFrame, obsolete: DataFrame) -> DataFrame:
    """Distinct terms that are neither in the ontology nor in the obsolete list."""
    return (
        terms.select("term")
        .distinct()
        .join(nodes, "term", "left_anti")
        .join(obsolete, "term", "left_anti")
    )


def obsolete_terms(terms: DataFrame, nodes: DataFrame, obsolete: DataFrame) -> DataFrame:
    """Distinct terms that are obsolete and not in the ontology."""
    return (
        terms.select("term")
        .distinct()
        .join(nodes, "term", "left_anti")
        .join(obsolete, "term", "left_semi")
    )


def missing_terms(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Distinct terms without a place in the vocabulary."""
    return terms.select("term").distinct().join(vocab, "term", "left_anti")
