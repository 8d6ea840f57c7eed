"""The five jobs, from input files to output folders."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.operators.annotate import (
    annotate,
    genes_of,
    missing_terms,
    obsolete_terms,
    restrict_genes,
    unknown_terms,
    without_first,
)
from traitloom.operators.classify import observe
from traitloom.operators.diff import compare, status_counts
from traitloom.operators.labels import gene_summary, label, label_counts
from traitloom.operators.matrix import Matrix, encode, encode_pairs, labelled_pairs, term_pairs
from traitloom.operators.ontology import (
    adjacency,
    ancestors,
    attribute_lines,
    counts_below,
    edges_of,
    named_terms,
    nodes_of,
    obsolete_of,
    reached_from,
    with_descendants,
)
from traitloom.operators.skew import spread_join
from traitloom.scratch import cut, cut_outside, job_tables
from traitloom.sinks import files
from traitloom.sources.arff import read_arff
from traitloom.sources.lines import POSITION, read_lines
from traitloom.sources.obo import ids_in_text, read_stanzas, term_names, with_prefix
from traitloom.sources.tables import (
    read_allele_observations,
    read_annotations,
    read_assignments,
    read_driver_lines,
    read_phenotypes,
    read_term_list,
)
from traitloom.species import species_named

TERM_MARK = "GO"  # only ids that contain it enter a vocabulary


def _freed(job):
    """Run a job so that its scratch tables are deleted, and its result does not read them.

    The counts that jobs return have a row for each status or root; they are written
    outside the job's folder.
    """

    @wraps(job)
    def run(spark: SparkSession, *args, **options):
        with job_tables(spark):
            result = job(spark, *args, **options)
            return None if result is None else cut_outside(result, job.__name__)

    return run


class UnknownTerms(ValueError):
    """Annotated terms that the ontology does not have."""


@_freed
def build_matrix(
    spark: SparkSession,
    species: str,
    phenotypes: str,
    annotations: str,
    ontology: str,
    output: str,
    *,
    lethal_terms: str | None = None,
    driver_lines: str | None = None,
    filter_with: bool = False,
    assignments: str | None = None,
    propagate: bool = False,
    prune: bool = True,
    mixed: str = "lethal_wins",
    pair_file: bool = False,
    exclude_not: bool = False,
    keep_obsolete: bool = False,
    skip_first: bool = False,
    on_unknown: str = "fail",
    on_short: str = "fail",
    mode: str = "errorifexists",
) -> DataFrame:
    """Write the labelled gene x term matrix of a species; return gene counts.

    Below ``output``: ``matrix.arff``, ``nodes.txt``, ``adjacency.json``, and
    ``pairs.tab`` where asked. The result has ``(stage, status, genes)`` before
    and after the join with the annotations, and the number of obsolete terms
    that were annotated.
    """
    kind = species_named(species)
    if on_unknown not in ("fail", "drop"):
        raise ValueError(f"on_unknown must be 'fail' or 'drop', not {on_unknown!r}")
    if kind.name == "fly" and assignments is None:
        raise ValueError("fly needs a file of gene assignments")
    if filter_with and driver_lines is None:
        raise ValueError("filter_with needs a file of driver lines")

    observations = observe(
        read_phenotypes(spark, phenotypes, kind, on_short),
        kind.name,
        terms=read_term_list(spark, lethal_terms) if lethal_terms else None,
        drivers=read_driver_lines(spark, driver_lines) if filter_with else None,
    )
    labels, _ = cut(label(observations, kind.lethal, mixed), "labels")
    listed = read_annotations(spark, annotations, kind, exclude_not, on_short)
    confirmed = read_assignments(spark, assignments) if kind.name == "fly" else None

    def joined(rows: DataFrame) -> DataFrame:
        found = annotate(labels, rows)
        if confirmed is not None:
            found = restrict_genes(found, confirmed)
        return cut(found, "annotated")[0]

    annotated = joined(listed)
    traced = annotated
    if skip_first and (propagate or pair_file):
        traced = joined(without_first(listed, list(POSITION)))

    stanzas, _ = cut(read_stanzas(spark, ontology), "stanzas")
    edges, _ = cut(edges_of(stanzas), "edges")
    nodes, _ = cut(nodes_of(edges), "nodes")
    obsolete = obsolete_of(stanzas)
    marked = annotated.where(F.col("term").contains(TERM_MARK))
    if on_unknown == "fail":
        unknown = [row["term"] for row in unknown_terms(marked, nodes, obsolete).take(5)]
        if unknown:
            raise UnknownTerms(f"annotated terms not in the ontology: {', '.join(unknown)}")

    terms = nodes.where(F.col("term").contains(TERM_MARK))
    closure = ancestors(edges, marked) if propagate or pair_file else None
    pairs = None
    if propagate and pair_file:
        # both outputs come from the same pairs
        pairs, _ = cut(term_pairs(traced, closure, TERM_MARK, settled=True), "pairs")
        matrix = encode_pairs(annotated, terms, pairs, prune)
    elif propagate:
        matrix = encode(traced, terms, closure, prune, TERM_MARK, settled=True)
        matrix = Matrix(genes_of(annotated), matrix.cells, matrix.vocab)
    else:
        matrix = encode(annotated, terms, None, prune, settled=True)
    files.write_arff(matrix, f"{output}/matrix.arff", mode)
    files.write_nodes(terms, f"{output}/nodes.txt", mode)
    files.write_adjacency(adjacency(edges), f"{output}/adjacency.json", mode)
    if pair_file:
        if pairs is None:
            pairs = term_pairs(traced, closure, TERM_MARK, obsolete if keep_obsolete else None, settled=True)
        elif keep_obsolete:
            marked_traced = traced.where(F.col("term").contains(TERM_MARK)).select("gene", "status", "term")
            kept = spread_join(marked_traced, obsolete, "term", "left_semi", ["gene"], settled=True)
            pairs = pairs.unionByName(kept).distinct()
        files.write_pairs(labelled_pairs(pairs), f"{output}/pairs.tab", mode)

    skipped = obsolete_terms(marked, nodes, obsolete).agg(F.count(F.lit(1)).alias("genes"))
    placeless = missing_terms(traced if propagate else annotated, matrix.vocab).agg(F.count(F.lit(1)).alias("genes"))
    return (
        label_counts(labels)
        .select(F.lit("labelled").alias("stage"), "status", "genes")
        .unionByName(
            label_counts(genes_of(annotated)).select(F.lit("annotated").alias("stage"), "status", "genes")
        )
        .unionByName(
            skipped.select(F.lit("obsolete terms skipped").alias("stage"), F.lit("").alias("status"), "genes")
        )
        .unionByName(
            placeless.select(F.lit("terms without a place").alias("stage"), F.lit("").alias("status"), "genes")
        )
    )


@_freed
def diff_matrices(
    spark: SparkSession, a: str, b: str, output: str, mode: str = "errorifexists"
) -> DataFrame:
    """Write the gene-by-gene report of two ARFF files; return rows per status."""
    compared = compare(read_arff(spark, a), read_arff(spark, b))
    files.write_report(compared, output, mode)
    return status_counts(compared)


@_freed
def summarise_alleles(
    spark: SparkSession, source: str, raw: str, summary: str, mode: str = "errorifexists"
) -> None:
    """Write the raw allele observations and the summary per gene."""
    records = read_allele_observations(spark, source)
    files.write_raw(records, raw, mode)
    observations = records.select("gene", F.col("simple_pheno").alias("status"))
    files.write_summary(gene_summary(observations), summary, mode)


@_freed
def expand_terms(
    spark: SparkSession,
    roots: str,
    ontology: str,
    output: str,
    prefix: str = "WBPhenotype:",
    digits: int = 7,
    mode: str = "errorifexists",
) -> DataFrame:
    """Write root terms and all their descendants with names; return counts.

    The result has ``(root, descendants)``; under ``*`` the number of distinct terms with the
    roots, under ``terms parsed`` and ``edges parsed`` what the ontology holds.
    """
    ids = ids_in_text(read_lines(spark, roots), "value", rf"{prefix}\d{{{digits}}}")
    root_terms, _ = cut(ids.select(F.col("id").alias("term")), "roots")
    stanzas, _ = cut(with_prefix(read_stanzas(spark, ontology), prefix), "stanzas")
    # this list keeps obsolete terms and ignores alternate ids
    edges, parsed = cut(edges_of(stanzas, alternate_ids=False, live_only=False), "edges")
    found = reached_from(edges, root_terms, upward=False)
    terms, total = cut(with_descendants(found.terms, root_terms), "terms")
    files.write_terms(named_terms(terms, term_names(stanzas)), output, mode)
    totals = [("*", total), ("terms parsed", stanzas.count()), ("edges parsed", parsed)]
    return counts_below(found, root_terms).unionByName(
        spark.createDataFrame(totals, "root string, descendants bigint")
    )


@_freed
def ontology_attributes(
    spark: SparkSession, ontology: str, output: str, mode: str = "errorifexists"
) -> None:
    """Write adjacency, node list and attribute lines of a whole ontology.

    Unlike the matrix job this keeps obsolete terms and ignores alternate ids.
    """
    stanzas = read_stanzas(spark, ontology)
    edges, _ = cut(edges_of(stanzas, alternate_ids=False, live_only=False), "edges")
    terms = nodes_of(edges).where(F.col("term").contains(TERM_MARK))
    files.write_adjacency(adjacency(edges), f"{output}/adjacency.json", mode)
    files.write_nodes(terms, f"{output}/nodes.txt", mode)
    files.write_attributes(attribute_lines(terms), f"{output}/attributes.txt", mode)
