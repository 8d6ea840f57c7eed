"""Queries over the given tables, one for each operator of the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.functions.text import after, before
from traitloom.operators import annotate as an
from traitloom.operators import classify as cl
from traitloom.operators import diff as di
from traitloom.operators import labels as lb
from traitloom.operators import matrix as mx
from traitloom.operators import ontology as on
from traitloom.operators.matching import flag_texts
from traitloom.queries import standins as st
from traitloom.scratch import cut, free_shuffles
from traitloom.sinks import files
from traitloom.sources.arff import read_arff
from traitloom.sources.lines import read_lines
from traitloom.sources.obo import ids_in_text, read_stanzas, term_names, with_prefix
from traitloom.sources.tables import (
    read_allele_observations,
    read_annotations,
    read_assignments,
    read_driver_lines,
    read_phenotypes,
    read_term_list,
)
from traitloom.species import SPECIES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- text functions and classifiers -------------------------------------------


@query
def str_before(spark, folder):
    parts = st.table(spark, folder, "part")
    return parts.select(
        "p_partkey",
        before(F.expr("concat(p_name, '[', p_brand, ']')"), "[").alias("gene"),
        before(F.expr("concat(p_type, '|', p_name)"), "|").alias("synonym"),
    )


@query
def str_after(spark, folder):
    return st.table(spark, folder, "part").select("p_partkey", after(F.col("p_name"), "r").alias("context"))


@query
def classify_ci(spark, folder):
    documents = st.table(spark, folder, "documents")
    return documents.select("doc_id", cl.allele_status(F.col("text"), viable=("viable", "ing")).alias("status"))


@query
def classify_tag(spark, folder):
    status = cl.tag_status(F.col("p_name"), ("ring", "red ring", "hot ring"), ("bolt", "hot bolt", "rod"))
    return st.table(spark, folder, "part").select("p_partkey", status.alias("status"))


@query
def classify_anycol(spark, folder):
    cells = F.array("p_name", "p_brand", "p_type")
    status = cl.cells_status(cells, drop="PROMO", lethal="red", viable="Brand#1")
    return st.table(spark, folder, "part").select("p_partkey", status.alias("status")).where("status IS NOT NULL")


# Words of another table: some stand in part names, most in none, some are null.
_SUPPLIED = (
    "CASE s_suppkey % 6 WHEN 0 THEN 'ring' WHEN 1 THEN 'small' WHEN 2 THEN 'gear' WHEN 3 THEN 'd b'"
    " WHEN 4 THEN concat('line ', s_suppkey) END"
)


def _listed_words(spark, folder):
    return st.table(spark, folder, "supplier").select(F.expr(_SUPPLIED).alias("term"))


def _named_parts(spark, folder):
    """Part names, null for some parts."""
    return st.table(spark, folder, "part").select("p_partkey", F.expr("CASE WHEN p_size <> 9 THEN p_name END").alias("p_name"))


def _classified(flagged):
    return flagged.select("p_partkey", F.when(F.col("listed"), "lethal").otherwise("viable").alias("status"), "listed")


@query
def classify_terms(spark, folder):
    return _classified(flag_texts(_named_parts(spark, folder), "p_name", _listed_words(spark, folder), "listed"))


@query
def classify_terms_join(spark, folder):
    """The same through the equality join that long word lists take."""
    words = _listed_words(spark, folder)
    return _classified(flag_texts(_named_parts(spark, folder), "p_name", words, "listed", limit=0))


@query
def classify_turns(spark, folder):
    """Whole texts against the order keys, a word list that is always long."""
    orders = st.table(spark, folder, "orders").select(F.expr("lpad(o_orderkey % 10000, 4, '0')").alias("term"))
    flagged = flag_texts(st.table(spark, folder, "conversations"), "text", orders, "listed")
    return flagged.select("conv_id", "turn", "role", "listed")


@query
def extract_ids(spark, folder):
    return ids_in_text(st.table(spark, folder, "pages"), "html", "/[a-z]{4,12}")


# --- labels ----------------------------------------------------------------------


@query
def label(spark, folder):
    return st.labels(spark, folder)


@query
def label_strict(spark, folder):
    return st.labels(spark, folder, mixed="drop")


@query
def label_counts(spark, folder):
    """Genes per label before and after the join with the annotations."""
    labels = st.labels(spark, folder)
    annotated = an.annotate(labels, st.annotations(spark, folder))
    return (
        lb.label_counts(labels)
        .withColumn("stage", F.lit("labelled"))
        .unionByName(lb.label_counts(an.genes_of(annotated)).withColumn("stage", F.lit("annotated")))
    )


@query
def gene_summary(spark, folder):
    return files.summary_columns(lb.gene_summary(st.observations(spark, folder)))


# --- annotations -------------------------------------------------------------------


@query
def annotate(spark, folder):
    return an.annotate(st.labels(spark, folder), st.annotations(spark, folder))


@query
def annotate_list(spark, folder):
    """Every annotation with its place in the gene's list, repeats included."""
    order = [*st.ANNOTATION_ORDER, "term", "row"]
    listed = an.term_positions(st.annotations(spark, folder), order)
    return listed.select("gene", "nth", "term")


@query
def skip_first(spark, folder):
    rest = an.without_first(st.annotations(spark, folder), st.ANNOTATION_ORDER)
    return rest.groupBy("gene", "term").agg(F.sum("copies").alias("copies"))


@query
def semi_assign(spark, folder):
    annotated = an.annotate(st.labels(spark, folder), st.annotations(spark, folder))
    return an.restrict_genes(annotated, st.assignments(spark, folder))


# --- ontology ----------------------------------------------------------------------


def _edges(spark, folder, **options):
    return on.edges_of(st.stanzas(spark, folder), **options)


@query
def edges(spark, folder):
    return _edges(spark, folder, alternate_ids=False)


@query
def edges_alt(spark, folder):
    return _edges(spark, folder)


@query
def vocab(spark, folder):
    nodes = on.nodes_of(_edges(spark, folder))
    return on.vocabulary(nodes, F.col("term").contains("GO"))[0]


@query
def vocab_union(spark, folder):
    """Terms of either of two vocabularies: used by genes, or below a root."""
    used = st.annotations(spark, folder).select("term")
    graph, _ = cut(_edges(spark, folder), "edges")
    return on.union_vocabulary(used, on.below(graph, st.roots(spark, folder)))


@query
def attribute_lines(spark, folder):
    return on.attribute_lines(on.nodes_of(_edges(spark, folder, alternate_ids=False, live_only=False)))


@query
def adjacency(spark, folder):
    return on.adjacency(_edges(spark, folder))


@query
def ancestors(spark, folder):
    return on.ancestors(_edges(spark, folder))


@query
def descendants(spark, folder):
    return on.descendants(_edges(spark, folder), st.roots(spark, folder))


@query
def descendant_counts(spark, folder):
    """Descendants per root, and the number of distinct terms under the root ``*``."""
    roots = st.roots(spark, folder)
    found = on.reached_from(_edges(spark, folder), roots, upward=False)
    total = on.with_descendants(found.terms, roots).agg(F.count(F.lit(1)).alias("descendants"))
    return on.counts_below(found, roots).unionByName(total.withColumn("root", F.lit("*")))


def _checked(spark, folder):
    graph, _ = cut(_edges(spark, folder), "edges")
    return st.annotations(spark, folder), on.nodes_of(graph), on.obsolete_of(st.stanzas(spark, folder))


@query
def unknown_terms(spark, folder):
    return an.unknown_terms(*_checked(spark, folder))


@query
def obsolete_terms(spark, folder):
    return an.obsolete_terms(*_checked(spark, folder))


@query
def missing_terms(spark, folder):
    terms, nodes, _ = _checked(spark, folder)
    return an.missing_terms(terms, nodes.where(F.col("term").contains("GO")))


# --- matrices ------------------------------------------------------------------------


def _encoded(spark, folder, propagate, prune):
    graph, _ = cut(_edges(spark, folder), "edges")
    annotated, _ = cut(an.annotate(st.labels(spark, folder), st.annotations(spark, folder)), "annotated")
    closure = on.ancestors(graph, annotated) if propagate else None
    terms = on.nodes_of(graph).where(F.col("term").contains("GO"))
    return mx.encode(annotated, terms, closure, prune, "GO" if propagate else None, settled=True)


def _encoding_sums(matrix):
    """Per gene: set cells and the sum of their indices; partial sums, no lists."""
    sums = mx.indexed_cells(matrix).groupBy("gene").agg(
        F.count(F.lit(1)).alias("n"), F.sum("idx").alias("idx_sum")
    )
    return matrix.genes.join(sums, "gene", "left").select(
        "gene",
        "status",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("idx_sum", F.lit(0)).alias("idx_sum"),
    )


@query
def encode_direct(spark, folder):
    """Direct terms over the pruned vocabulary: the default matrix."""
    return _encoding_sums(_encoded(spark, folder, propagate=False, prune=True))


@query
def encode_propagated(spark, folder):
    """Terms with all ancestors over the full vocabulary."""
    return _encoding_sums(_encoded(spark, folder, propagate=True, prune=False))


@query
def encode_pruned_closure(spark, folder):
    """Terms with all ancestors over the used terms: each gene's places, not sums."""
    matrix = _encoded(spark, folder, propagate=True, prune=True)
    return mx.sparse_rows(matrix).select("gene", "status", F.array_join("ix", ",").alias("ix"))


@query
def prune_vocab(spark, folder):
    return _encoded(spark, folder, propagate=False, prune=True).vocab


def _traced(spark, folder, inherit):
    """Genes with direct and inherited terms, and the number of annotated rows that they come from."""
    graph, _ = cut(_edges(spark, folder), "edges")
    annotated, rows = cut(an.annotate(st.labels(spark, folder), st.annotations(spark, folder)), "annotated")
    obsolete = on.obsolete_of(st.stanzas(spark, folder))
    closure = on.ancestors(graph, annotated)
    free_shuffles(spark)
    return inherit(annotated, closure, "GO", obsolete, settled=True), rows


def _pairs(spark, folder):
    return _traced(spark, folder, mx.term_pairs)[0]


@query
def gene_term_pairs(spark, folder):
    """Genes per term over direct and inherited terms, obsolete direct ones kept."""
    return _pairs(spark, folder).groupBy("term").agg(F.count(F.lit(1)).alias("genes"))


@query
def gene_term_label(spark, folder):
    return mx.labelled_pairs(_pairs(spark, folder))


def _brand_matrix(spark, folder):
    annotated = an.annotate(st.brand_labels(spark, folder), st.brand_pairs(spark, folder))
    annotated, _ = cut(annotated, "annotated")
    return mx.encode(annotated, annotated.select("term"), settled=True)


@query
def pivot_small(spark, folder):
    annotated, _ = cut(
        an.annotate(st.brand_labels(spark, folder), st.brand_pairs(spark, folder)), "annotated"
    )
    brands = annotated.select("term").distinct().orderBy("term").collect()  # 25 in all
    return mx.wide_table(annotated, [row["term"] for row in brands])


@query
def wide_blocks(spark, folder):
    """Customers of a nation x parts they bought: a wide row of all parts, in blocks."""
    lines = st.table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    orders = st.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = st.table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    pairs = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("c_nationkey").alias("gene"), F.lit("viable").alias("status"), F.expr(st.term("l_partkey")).alias("term"))
        .distinct()
    )
    terms, _ = on.vocabulary(pairs.select("term").distinct())
    blocks = mx.wide_blocks(pairs, terms)
    return blocks.select("gene", "block", F.array_join("flags", ",").alias("flags"))


@query
def arff_lines(spark, folder):
    return files.arff_lines(_brand_matrix(spark, folder)).select("section", "at", "line")


@query
def matrix_diff(spark, folder):
    a, b = st.side_matrix(spark, folder, "F"), st.side_matrix(spark, folder, "O")
    return di.report(di.compare(a, b))


@query
def matrix_diff_vocab(spark, folder):
    """The same where each matrix lacks a term of the other."""
    a = st.side_matrix(spark, folder, "F", without_type="PROMO")
    b = st.side_matrix(spark, folder, "O", without_type="SMALL")
    return di.ordered_report(di.compare(a, b))


@query
def diff_counts(spark, folder):
    a, b = st.side_matrix(spark, folder, "F"), st.side_matrix(spark, folder, "O")
    return di.status_counts(di.compare(a, b))


# --- files: written from the tables by Spark, then read by the sources ----------------


def _counted(observed):
    return observed.groupBy("gene", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def scan_yeast(spark, folder):
    path = st.tsv_file(
        st.table(spark, folder, "orders"),
        "yeast",
        "concat('Y', o_custkey)",
        "'ORF'",
        "o_orderkey",
        "CASE WHEN o_orderstatus = 'P' THEN 'inviable' ELSE 'null' END",
        "''",
        "concat('\"a\\tcell \"\"', o_orderkey, '\"\"\"')",
        "''",
        "''",
        "''",
        "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'inviable' WHEN '5' THEN 'viable'"
        " WHEN '2' THEN 'viable: slow' ELSE 'growth' END",
    )
    rows = read_phenotypes(spark, path, SPECIES["yeast"])
    return _counted(cl.observe(rows, "yeast"))


_FLY_TEXT = (
    "CASE p_type WHEN 'ECONOMY' THEN 'lethal' WHEN 'SMALL' THEN 'viable'"
    " WHEN 'PROMO' THEN 'partially lethal' WHEN 'STANDARD' THEN 'inviable' ELSE 'wing defect' END"
)


@query
def scan_fly(spark, folder):
    """Labels of the genes a file of assignments confirms."""
    parts = st.table(spark, folder, "part")
    gene = "concat(p_name, ' ', p_brand)"
    rows = parts.select(
        F.expr(
            f"CASE WHEN p_size = 9 THEN concat_ws('\\t', {gene}, 'x', 'lethal')"
            f" ELSE concat_ws('\\t', concat({gene}, '[', p_partkey, ']'), p_partkey, {_FLY_TEXT}, 'ref') END"
        ).alias("line")
    )
    assigned = st.tsv_file(
        parts,
        "assignments",
        gene,
        "''",
        "''",
        "CASE WHEN p_size <= 20 THEN 'Withdrawn' ELSE 'Current' END",
        "CASE WHEN p_type = 'MEDIUM' THEN 'simulans' ELSE 'melanogaster' END",
    )
    observed = cl.observe(read_phenotypes(spark, st.text_file(rows, "fly"), SPECIES["fly"]), "fly")
    genes = read_assignments(spark, _with_header(spark, assigned, "gene\tx\tx\tstate\tspecies"))
    return an.restrict_genes(lb.label(observed).withColumn("term", F.lit("")), genes).select("gene", "status")


def _with_header(spark, path, header):
    """Rewrite a text folder so that each part begins with a header line."""
    target = st.scratch_path(spark, "headed")
    lines = spark.read.text(path).select(F.col("value").alias(header))
    # the csv writer puts its header on every part; the cells hold no quotes
    lines.write.csv(target, header=True, quote="", sep="\u0001", compression="gzip")
    return target


def _partner_rows(spark, folder):
    word1, word2 = "substring_index(p_name, ' ', 1)", "substring_index(p_name, ' ', -1)"
    path = st.tsv_file(
        st.table(spark, folder, "part"),
        "fly-with",
        "concat(p_brand, '-', p_size, '[', p_partkey, ']')",
        "p_partkey",
        f"CASE p_type WHEN 'ECONOMY' THEN concat('lethal, with ', {word1})"
        f" WHEN 'SMALL' THEN concat('viable, with ', {word1}) WHEN 'PROMO' THEN 'lethal'"
        " WHEN 'STANDARD' THEN 'lethal' WHEN 'LARGE' THEN 'partially lethal' ELSE 'wing' END",
        f"CASE WHEN p_type = 'STANDARD' THEN concat('with ', {word2}) ELSE 'ref' END",
    )
    return read_phenotypes(spark, path, SPECIES["fly"])


def _drivers(spark, folder):
    path = st.tsv_file(st.table(spark, folder, "supplier"), "drivers", "s_suppkey", "''", _SUPPLIED)
    return read_driver_lines(spark, _with_header(spark, path, "id\tx\tname"))


@query
def scan_fly_with(spark, folder):
    return _counted(cl.observe(_partner_rows(spark, folder), "fly", drivers=_drivers(spark, folder)))


@query
def scan_fly_with_join(spark, folder):
    """The same through the equality join that long driver lists take."""
    observed = cl.observe_fly_with(_partner_rows(spark, folder), _drivers(spark, folder), limit=0)
    return _counted(observed)


@query
def scan_fish(spark, folder):
    path = st.tsv_file(
        st.table(spark, folder, "orders"),
        "fish",
        "o_orderkey",
        "CASE o_orderstatus WHEN 'P' THEN concat('F', o_custkey, '[x]') ELSE concat('F', o_custkey) END",
        *["''"] * 8,
        "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'abnormal,lethal' WHEN '2' THEN 'semi-lethal'"
        " WHEN '3' THEN 'dead' WHEN '4' THEN 'semi-viable' ELSE 'alive' END",
    )
    return _counted(cl.observe(read_phenotypes(spark, path, SPECIES["fish"]), "fish"))


def _term_list(spark, folder, prefix):
    path = st.tsv_file(
        st.table(spark, folder, "nation"), "terms", f"concat('{prefix}', lpad(n_nationkey, 7, '0'))", "n_name"
    )
    return read_term_list(spark, _with_header(spark, path, "ID\tName"))


@query
def scan_worm(spark, folder):
    path = st.tsv_file(
        st.table(spark, folder, "events"),
        "worm",
        "event_id",
        "''",
        "concat('W', user_id)",
        "CASE WHEN event_type = 'error' THEN 'NOT' ELSE '' END",
        "concat('WBPhenotype:', lpad(event_id % 40, 7, '0'))",
    )
    rows = read_phenotypes(spark, path, SPECIES["worm"])
    return _counted(cl.observe(rows, "worm", terms=_term_list(spark, folder, "WBPhenotype:")))


@query
def scan_mouse(spark, folder):
    path = st.tsv_file(
        st.table(spark, folder, "lineitem"),
        "mouse",
        "l_orderkey",
        "''",
        "''",
        "concat('MP:', lpad(cast(l_quantity AS int), 7, '0'))",
        "''",
        "CASE WHEN l_linenumber = 7 THEN concat('MGI:', l_suppkey, ',MGI:1') ELSE concat('MGI:', l_suppkey) END",
    )
    rows = read_phenotypes(spark, path, SPECIES["mouse"])
    return _counted(cl.observe(rows, "mouse", terms=_term_list(spark, folder, "MP:")))


def _gaf(spark, folder):
    lines = st.table(spark, folder, "lineitem")
    orders = st.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    cells = ", ".join(
        [
            "CASE l_returnflag WHEN 'A' THEN 'SGD' WHEN 'R' THEN 'FB' ELSE 'ZFIN' END",
            "cast(l_orderkey AS string)",
            "'symbol'",
            "CASE l_linestatus WHEN 'O' THEN 'NOT|part_of' ELSE 'part_of' END",
            st.term("l_partkey"),
            *["''"] * 5,
            "concat('Y', o_custkey, '|alias')",
        ]
    )
    return st.text_file(
        joined.select(
            F.expr(
                f"CASE WHEN l_linenumber = 1 THEN concat('!gaf-comment ', l_orderkey)"
                f" ELSE concat_ws('\\t', {cells}) END"
            ).alias("line")
        ),
        "gaf",
    )


def _gene_terms(annotations):
    return annotations.groupBy("gene", "term").agg(F.count(F.lit(1)).alias("copies"))


@query
def scan_gaf(spark, folder):
    return _gene_terms(read_annotations(spark, _gaf(spark, folder), SPECIES["yeast"]))


@query
def scan_gaf_positive(spark, folder):
    """Negated annotations left out."""
    return _gene_terms(read_annotations(spark, _gaf(spark, folder), SPECIES["yeast"], exclude_not=True))


def _obo(stanzas, label, named="true"):
    """Write stanzas as an OBO file, with a relation stanza beside each root."""
    text = (
        "concat('[Term]\\nid: ', id, "
        f"CASE WHEN {named} THEN concat('\\nname: ', name) ELSE '' END, "
        "array_join(transform(is_a, x -> concat('\\nis_a: ', x, ' ! parent')), ''), "
        "array_join(transform(alt_id, x -> concat('\\nalt_id: ', x)), ''), "
        "CASE WHEN is_obsolete THEN '\\nis_obsolete: true' ELSE '' END, '\\n', "
        "CASE WHEN is_obsolete THEN '\\n[Typedef]\\nid: rel_of\\nis_a: GO:rel\\n' ELSE '' END)"
    )
    return st.text_file(stanzas.select(F.expr(text).alias("line")), label, compression="none")


@query
def scan_obo_edges(spark, folder):
    path = _obo(st.stanzas(spark, folder), "obo")
    return on.edges_of(read_stanzas(spark, path))


_WIDE_ID = "concat('WBPhenotype:', lpad({k}, 12, '0'))"


@query
def scan_lethal_terms(spark, folder):
    """Roots found in a text, all their descendants from an OBO file, and the names."""
    parts = st.table(spark, folder, "part")
    key, up2, up3 = (_WIDE_ID.format(k=k) for k in ("p_partkey", "p_partkey div 2", "p_partkey div 3"))
    stanzas = parts.select(
        F.expr(key).alias("id"),
        F.col("p_name").alias("name"),
        F.expr(f"CASE WHEN p_partkey > 0 THEN array({up2}, {up3}) ELSE array() END").alias("is_a"),
        F.expr("cast(array() AS array<string>)").alias("alt_id"),
        F.expr("p_size = 50").alias("is_obsolete"),
        "p_type",
    )
    obo = _obo(stanzas, "wb-obo", named="p_type <> 'PROMO'")
    absent = _WIDE_ID.format(k="p_partkey + 900000000000")
    roots = st.text_file(
        parts.where("p_size = 7").select(F.expr(f"concat({key}, ' root, see also ', {absent})").alias("line")),
        "roots",
    )
    root_terms = ids_in_text(read_lines(spark, roots), "value", r"WBPhenotype:\d{12}").select(
        F.col("id").alias("term")
    )
    read, _ = cut(with_prefix(read_stanzas(spark, obo), "WBPhenotype:"), "stanzas")
    found = on.reached_from(on.edges_of(read, alternate_ids=False, live_only=False), root_terms, upward=False)
    return on.named_terms(on.with_descendants(found.terms, root_terms), term_names(read))


@query
def scan_arff(spark, folder):
    """A matrix written as ARFF and read back: its cells and labels."""
    path = st.scratch_path(spark, "arff")
    files.write_arff(_brand_matrix(spark, folder), path)
    matrix = read_arff(spark, path)
    return mx.term_cells(matrix).join(matrix.genes, "gene").select("gene", "status", "term", "value")


def _rough_lines(spark, folder, without, changed, rows):
    """The lines of ``_rough_arff`` in order; the parts are sorted as they are and only then written out as lines."""
    header = spark.createDataFrame(
        [(0, 0, "@RELATION x"), (0, 1, "@attribute gene string"), (2, 0, "@ATTRIBUTE class {viable,lethal}"), (2, 1, "@Data")]
        + [(1, i, f"@ATTRIBUTE 'Brand#{i}' {{0,1}}") for i in range(1, 26) if i != without],
        "section int, at bigint, head string",
    )
    brand = f"CASE WHEN {changed} THEN cast(substr(p_brand, 7) AS int) % 25 + 1 ELSE cast(substr(p_brand, 7) AS int) END"
    data = st.table(spark, folder, "part").where(rows).select(
        F.lit(3).alias("section"), F.col("p_partkey").alias("at"), "p_name", "p_size", F.expr(brand).alias("brand")
    )
    items = files.ordered(header.unionByName(data, allowMissingColumns=True), ["section", "at"])
    width = "CASE p_size % 5 WHEN 0 THEN 10 WHEN 1 THEN 26 ELSE 24 END"
    place = f"brand - CASE WHEN brand > {without} THEN 1 ELSE 0 END"
    values = f"transform(sequence(1, {width}), i -> CASE WHEN i = place AND i <= 24 THEN ' 1 ' ELSE '0' END)"
    return items.withColumn("place", F.expr(f"CASE WHEN brand <> {without} THEN {place} END")).select(
        F.expr(
            "CASE WHEN section < 3 THEN head ELSE CASE p_size WHEN 7 THEN concat('% ', p_name) WHEN 8 THEN '  ' ELSE"
            f" concat(' ', p_name, '/', p_size, ',', array_join({values}, ','), ', ',"
            " CASE WHEN at % 3 = 0 THEN 'lethal' ELSE 'viable' END) END END"
        ).alias("line")
    )


def _rough_arff(spark, folder, label, without, changed="1 = 0", rows="true"):
    """Parts x brands as an ARFF file by hand: padded values, comments, blank lines, short and long rows."""
    path = st.scratch_path(spark, label)
    _rough_lines(spark, folder, without, changed, rows).write.text(path)
    return read_arff(spark, path)


@query
def scan_arff_rough(spark, folder):
    """Quoted names, padded values, comments, repeated genes, short and long rows."""
    matrix = _rough_arff(spark, folder, "rough", 3)
    return mx.term_cells(matrix).join(matrix.genes, "gene").select("gene", "status", "term", "value")


@query
def arff_diff(spark, folder):
    """Two ARFF files with other attributes, short rows, repeated and missing genes."""
    a = _rough_arff(spark, folder, "left", 3)
    b = _rough_arff(spark, folder, "right", 5, changed="p_partkey % 4 = 0", rows="p_size <> 9")
    return di.report(di.compare(a, b))


def _written(spark, write, *args, **options):
    """Write with a sink; the lines of the folder it made."""
    path = st.scratch_path(spark, "written")
    write(*args, path, **options)
    return spark.read.text(path).select(F.col("value").alias("line"))


_WAVE = 2**23  # annotated rows whose shuffles may stand on disk together


@query
def file_pairs(spark, folder):
    """The lines are several times as large as the tables, so they are written compressed and in waves."""
    lists, rows = _traced(spark, folder, mx.term_lists)
    free_shuffles(spark)
    options = {"compression": "gzip", "waves": rows // _WAVE + 1}
    return _written(spark, files.write_pairs, mx.labelled_pairs(lists), **options)


@query
def file_adjacency(spark, folder):
    path = st.scratch_path(spark, "adjacency")
    files.write_adjacency(on.adjacency(_edges(spark, folder)), path)
    return spark.read.schema("id string, side string, other string").json(path)


@query
def file_nodes(spark, folder):
    terms = on.nodes_of(_edges(spark, folder)).where(F.col("term").contains("GO"))
    return _written(spark, files.write_nodes, terms)


@query
def file_attributes(spark, folder):
    lines = on.attribute_lines(on.nodes_of(_edges(spark, folder, alternate_ids=False, live_only=False)))
    return _written(spark, files.write_attributes, lines)


@query
def file_terms(spark, folder):
    names = st.table(spark, folder, "part").select(F.expr(st.term("p_partkey")).alias("term"), F.col("p_name").alias("name"))
    roots = st.roots(spark, folder)
    return _written(spark, files.write_terms, on.named_terms(roots, names.where("name NOT LIKE 'r%'")))


@query
def file_report(spark, folder):
    a = st.side_matrix(spark, folder, "F", without_type="PROMO")
    b = st.side_matrix(spark, folder, "O", without_type="SMALL")
    return _written(spark, files.write_report, di.compare(a, b))


@query
def file_summary(spark, folder):
    return _written(spark, files.write_summary, lb.gene_summary(st.observations(spark, folder)))


@query
def file_raw(spark, folder):
    return _written(spark, files.write_raw, _allele_records(spark, folder))


def _allele_records(spark, folder):
    lines = st.table(spark, folder, "orders").select(
        F.expr(
            "CASE WHEN o_orderkey % 11 = 0 THEN concat('# note ', o_orderkey)"
            " WHEN o_orderkey % 13 = 0 THEN '   '"
            " WHEN o_orderkey % 17 = 0 THEN concat('g', o_custkey, '\\tFB\\t\\t')"
            " ELSE concat_ws('\\t', concat('g', o_custkey, '[', o_orderkey, ']'), concat('FB', o_orderkey),"
            " CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN concat('Lethal, with x', o_custkey, ' ')"
            " WHEN '2' THEN 'Dies early' WHEN '3' THEN 'dietary defect'"
            " WHEN '4' THEN 'wing' ELSE 'viable, with y' END, 'ref') END"
        ).alias("line")
    )
    return read_allele_observations(spark, st.text_file(lines, "fly-raw", compression="none"))


@query
def scan_fly_raw(spark, folder):
    return files.raw_columns(_allele_records(spark, folder))
