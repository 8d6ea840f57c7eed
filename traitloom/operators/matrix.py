"""Sparse gene x term matrices."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.functions.text import dash_quotes
from traitloom.operators.annotate import genes_of
from traitloom.operators.ontology import vocabulary
from traitloom.operators.ordering import dense_index
from traitloom.operators.skew import spread_join
from traitloom.scratch import cut, cut_measured

# The text around the attributes and the rows of an ARFF file.
ARFF_RELATION = "@RELATION gene_lethality\n"
ARFF_GENE = "@ATTRIBUTE gene string"
ARFF_CLASS = "@ATTRIBUTE class {viable,lethal}\n"
ARFF_DATA = "@DATA"


@dataclass(frozen=True)
class Matrix:
    """A matrix in long form: a cell that is not listed holds ``'0'``."""

    genes: DataFrame  # gene, status
    cells: DataFrame  # gene, idx, value
    vocab: DataFrame  # term, idx


def _marked(annotated: DataFrame, mark: str | None) -> DataFrame:
    return annotated if mark is None else annotated.where(F.col("term").contains(mark))


_SHARED = 2**16  # the ancestors of the most terms, whose numbers go along with the tasks
_TOGETHER = 2**20  # ancestors of a key's terms, repeats included, that may stand in one row


def _most_shared(closure: DataFrame) -> DataFrame:
    """``(ancestor, place)``: the ancestors that the most terms have, numbered from 0; at most ``_SHARED``."""
    counted = closure.where(F.col("ancestor").isNotNull()).groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"))
    ranked, _ = dense_index(counted.withColumn("n", -F.col("n")), ["n", "ancestor"], "place")
    shared = ranked.where(F.col("place") < _SHARED)
    return cut(shared.select("ancestor", F.col("place").cast("int").alias("place")), "shared")[0]


def _inherited(direct: DataFrame, by: Sequence[str], items: DataFrame, settled: bool) -> DataFrame:
    """``(*by, *columns)``: for each key, lists of the distinct items (term, *columns) of its direct terms.

    An item has a value in one of its columns and null in the others. The items of a term are listed
    once; a key's lists are shuffled as they are and united in its row, so that there is no row for each
    key, term and item. Keys with more than ``_TOGETHER`` items go through a join of rows instead and
    have a row with one list of one for each item.
    """
    columns = [c for c in items.columns if c != "term"]
    lists, measured = cut_measured(
        items.repartition("term").groupBy("term").agg(*[F.collect_list(c).alias(c) for c in columns]),
        "lists",
        longest=F.max(sum(F.size(c) for c in columns)),
    )
    if not settled:
        direct, _ = cut(direct, "direct")
    terms = direct.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    large, found = cut(terms.where(F.col("n") * F.lit(measured["longest"] or 0) > _TOGETHER).select(*by), "large")
    small = spread_join(direct, large, by, "left_anti", ["term"], settled=True) if found else direct
    met = spread_join(small, lists, "term", salt_by=by, settled=not found).select(*by, *columns)
    # shuffled first: an aggregate before it would sort the lists and unite hardly any
    united = met.repartition(*by).groupBy(*by).agg(
        *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in columns]
    )
    kinds = {c: items.schema[c].dataType for c in columns}

    def entries(own: str) -> Column:
        others = {c: F.lit(None).cast(kind) for c, kind in kinds.items()}
        return F.transform(own, lambda x: F.struct(*[value.alias(c) for c, value in {**others, own: x}.items()]))

    if found:
        apart = spread_join(direct, large, by, "left_semi", ["term"], settled=True)
        each = F.inline(F.concat(*[entries(c) for c in columns]))
        met = spread_join(apart, lists.select("term", each), "term", salt_by=by, few_salt_by=columns)
        single = [F.array_compact(F.array(c)).alias(c) for c in columns]
        united = united.unionByName(met.select(*by, *columns).distinct().select(*by, *single))
    return united


def term_lists(
    annotated: DataFrame,
    closure: DataFrame,
    mark: str | None = None,
    obsolete: DataFrame | None = None,
    settled: bool = False,
) -> DataFrame:
    """``(gene, status, terms)``: the distinct ancestors of a gene's direct terms.

    A gene with very many has them in several rows. ``closure`` holds
    ``(term, ancestor)`` with each term as its own ancestor; terms outside it
    do not propagate. Obsolete direct terms are kept where given. ``mark``
    limits the direct terms to ids that contain it. ``settled`` says that
    ``annotated`` is a written table.
    """
    direct = _marked(annotated, mark).select("gene", "status", "term")
    if obsolete is not None:
        kept = obsolete.where(F.col("term").isNotNull())
        closure = closure.unionByName(kept.select("term", F.col("term").alias("ancestor")))
    shared = F.broadcast(_most_shared(closure))
    name = F.when(F.col("place").isNull(), F.col("ancestor")).alias("name")
    items = closure.join(shared, "ancestor", "left").select("term", "place", name)
    lists = _inherited(direct, ["gene", "status"], items, settled)
    # an array of all names, once for a task: a join by place would need a row for each pair
    ranked = F.sort_array(F.collect_list(F.struct("place", "ancestor")))
    known = shared.agg(F.transform(ranked, lambda x: x["ancestor"]).alias("known")).scalar()
    terms = F.concat(F.transform("place", lambda x: F.get("known", x)), "name")
    return lists.withColumn("known", known).select("gene", "status", terms.alias("terms"))


def term_pairs(
    annotated: DataFrame,
    closure: DataFrame,
    mark: str | None = None,
    obsolete: DataFrame | None = None,
    settled: bool = False,
) -> DataFrame:
    """Distinct ``(gene, status, term)``: a row for each of the ``term_lists``."""
    lists = term_lists(annotated, closure, mark, obsolete, settled)
    return lists.select("gene", "status", F.explode("terms").alias("term"))


def labelled_pairs(pairs: DataFrame) -> DataFrame:
    """``(gene, term, label)``, or ``terms`` of lists: 1 for lethal, 0 for viable genes.

    The status travels with each pair, so there is no second join.
    """
    named = "terms" if "terms" in pairs.columns else "term"
    return pairs.where(F.col("status").isin("lethal", "inviable", "viable")).select(
        "gene", named, F.when(F.col("status") == "viable", 0).otherwise(1).alias("label")
    )


def used_terms(terms: DataFrame, direct: DataFrame, closure: DataFrame | None) -> DataFrame:
    """The vocabulary terms that at least one gene has, directly or by propagation.

    Whatever lies above a used term is used, so the genes are not needed.
    """
    used = direct.select("term").distinct()
    if closure is not None:
        used = (
            closure.join(used, "term", "left_semi")
            .select(F.col("ancestor").alias("term"))
            .distinct()
        )
    # a term of the vocabulary may stand in many rows, all of which a broadcast would carry
    return used.join(terms.select("term").distinct(), "term", "left_semi")


def encode(
    annotated: DataFrame,
    terms: DataFrame,
    closure: DataFrame | None = None,
    prune: bool = True,
    mark: str | None = None,
    settled: bool = False,
) -> Matrix:
    """Multi-hot encoding over ``terms`` (pruned to the used ones by default).

    Without ``closure`` only direct terms are set. Every annotated gene has a
    row, also one with no term in the vocabulary. The places are looked up for
    the closure, whose lists by term are then united by gene.
    ``settled`` says that ``annotated`` is a written table.
    """
    direct = _marked(annotated, mark).select("gene", "term")
    kept = used_terms(terms, direct, closure) if prune else terms.select("term").distinct()
    vocab, _ = vocabulary(kept)
    if closure is not None:
        places = vocab.select(F.col("term").alias("ancestor"), "idx")
        # most of the closure names few ancestors, whose places are looked up without a shuffle
        shared = F.broadcast(cut(_most_shared(closure).join(places, "ancestor", "left"), "shared")[0])
        met = closure.join(shared, "ancestor", "left")
        rare = met.where(F.col("place").isNull()).select("term", "ancestor")
        placed = met.where(F.col("idx").isNotNull()).select("term", "idx").unionByName(
            spread_join(rare, places, "ancestor", salt_by=["term"]).select("term", "idx")
        )
        cells = _inherited(direct, ["gene"], placed, settled).select("gene", F.explode("idx").alias("idx"))
    else:
        cells = spread_join(direct, vocab, "term", salt_by=["gene"], settled=settled).select("gene", "idx").distinct()
    cells = cells.withColumn("value", F.lit("1"))
    return Matrix(genes=genes_of(annotated), cells=cells, vocab=vocab)


def encode_pairs(annotated: DataFrame, terms: DataFrame, pairs: DataFrame, prune: bool = True) -> Matrix:
    """The same from a written table of distinct gene-term pairs, where that was made already."""
    kept = terms.select("term").distinct()
    if prune:
        kept = pairs.select("term").distinct().join(kept, "term", "left_semi")
    vocab, _ = vocabulary(kept)
    cells = spread_join(pairs.select("gene", "term"), vocab, "term", salt_by=["gene"], settled=True)
    return Matrix(genes_of(annotated), cells.select("gene", "idx", F.lit("1").alias("value")), vocab)


def term_cells(matrix: Matrix) -> DataFrame:
    """``(gene, term, value)``: the cells with their terms."""
    return spread_join(matrix.cells, matrix.vocab, "idx", salt_by=["gene"]).select(
        "gene", "term", "value"
    )


def indexed_cells(matrix: Matrix) -> DataFrame:
    """``(gene, idx)`` of the cells that hold ``'1'``."""
    return matrix.cells.where(F.col("value") == "1").select("gene", "idx")


def dense_text(ix: Column, width: Column) -> Column:
    """``'0,1,0,...'`` with a one at each index of the sorted array ``ix``.

    Every index writes the zeros since the one before it, so the work grows
    with the set cells plus the length of the text.
    """
    zeros = F.transform(
        ix,
        lambda value, i: F.concat(
            F.repeat(
                F.lit("0,"),
                (value - F.when(i == 0, F.lit(-1)).otherwise(F.get(ix, i - 1)) - 1).cast("int"),
            ),
            F.lit("1,"),
        ),
    )
    last = F.coalesce(F.get(ix, F.size(ix) - 1), F.lit(-1))
    rest = F.repeat(F.lit("0,"), (width - 1 - last).cast("int"))
    return F.concat(F.array_join(zeros, ""), rest)


def sparse_rows(matrix: Matrix) -> DataFrame:
    """``(gene, status, ix)``: the sorted vocabulary places of each gene's terms.

    The places collected for a gene are distinct, so a list is never longer
    than the ARFF line it becomes.
    """
    lists = indexed_cells(matrix).groupBy("gene").agg(F.sort_array(F.collect_list("idx")).alias("ix"))
    none = F.array().cast("array<bigint>")
    return matrix.genes.join(lists, "gene", "left").select(
        "gene", "status", F.coalesce("ix", none).alias("ix")
    )


def arff_line(width: Column) -> Column:
    """The data line of a sparse row for a vocabulary of ``width`` terms."""
    # an empty vocabulary still leaves an empty vector between two commas
    vector = F.when(width == 0, ",").otherwise(dense_text(F.col("ix"), width))
    return F.concat(dash_quotes(F.col("gene")), F.lit(","), vector, "status")


def arff_header(vocab: DataFrame) -> DataFrame:
    """``(section, at, line)`` of everything above the data rows."""
    spark = vocab.sparkSession
    fixed = spark.createDataFrame(
        [(0, 0, ARFF_RELATION), (0, 1, ARFF_GENE), (2, 0, ARFF_CLASS), (2, 1, ARFF_DATA)],
        "section int, at bigint, line string",
    )
    return fixed.unionByName(
        vocab.select(
            F.lit(1).alias("section"),
            F.col("idx").cast("bigint").alias("at"),
            F.concat(F.lit("@ATTRIBUTE "), F.col("term").cast("string"), F.lit(" {0,1}")).alias("line"),
        )
    )


def wide_table(pairs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """One 0/1 column for each of the given terms, in their order."""
    wide = pairs.groupBy("gene", "status").pivot("term", list(terms)).agg(F.max(F.lit(1)))
    return wide.na.fill(0, subset=[str(term) for term in terms])


def wide_blocks(pairs: DataFrame, vocab: DataFrame, width: int = 1000) -> DataFrame:
    """``(gene, status, block, flags)``: the wide rows in blocks of ``width`` places, all terms kept.

    ``flags`` holds 0 or 1 for each place of the block, also in the last one, which may be
    shorter; the blocks of a gene one after the other are its wide row. Every gene has a
    row in every block.
    """
    size = vocab.select(F.count(F.lit(1)).alias("n")).scalar()
    genes = pairs.select("gene", "status").distinct()
    set_places = spread_join(pairs, vocab, "term", salt_by=["gene"]).groupBy(
        "gene", (F.col("idx") / width).cast("int").alias("block")
    ).agg(F.collect_set(F.col("idx") % width).alias("places"))
    blocks = genes.withColumn("n", size).select(
        "gene", "status", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / width).cast("int"))).alias("block")
    )
    last = F.least(F.lit(width), F.col("n") - F.col("block") * width) - 1
    none = F.array().cast("array<bigint>")
    places = F.coalesce("places", none)
    return blocks.where(F.col("n") > 0).join(set_places, ["gene", "block"], "left").select(
        "gene", "status", "block",
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), last), lambda i: F.array_contains(places, i).cast("int")
        ).alias("flags"),
    )
