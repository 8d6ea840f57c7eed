"""Gene-by-gene comparison of two matrices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.operators.bitmaps import bit_of, named, word_of
from traitloom.operators.matrix import Matrix
from traitloom.operators.ordering import dense_index
from traitloom.operators.skew import spread_join
from traitloom.scratch import cut

# The statuses in the order of the report.
STATUSES = ("MISSING_IN_B", "LABEL_MISMATCH", "GO_TERM_MISMATCH", "EXACT_MATCH")

# Terms that stand together in a report text and in the table of one-sided terms.
BLOCK = 500


@dataclass(frozen=True)
class Comparison:
    """Two matrices side by side.

    A term that only one vocabulary has differs for every shared gene but those whose own
    cell is ``'NA'``, so that such terms are listed once and only the exceptions by gene.
    """

    genes: DataFrame  # gene, label_a, label_b, shared, statuses
    cells: DataFrame  # gene, idx, term, differs: of terms that both have, and exceptions
    one_sided: DataFrame  # idx, term


def _sides(a: Matrix, b: Matrix) -> DataFrame:
    """``(term, sides, idx)``: 1 for the first vocabulary, 2 for the second, 3 for both."""
    both = a.vocab.select("term", F.lit(1).alias("side")).unionByName(b.vocab.select("term", F.lit(2).alias("side")))
    terms = both.groupBy(F.col("term").cast("string").alias("term")).agg(F.bit_or("side").alias("sides"))
    return dense_index(terms, ["term"], "idx")[0]


def _placed(matrix: Matrix, sides: DataFrame) -> DataFrame:
    """``(gene, place, value)``: the listed cells by the common numbers of the terms."""
    numbers = matrix.vocab.select("idx", F.col("term").cast("string").alias("term")).join(
        sides.select("term", F.col("idx").alias("place")), "term"
    )
    return spread_join(matrix.cells, numbers.select("idx", "place"), "idx", salt_by=["gene"]).select("gene", "place", "value")


def compared_words(a: Matrix, b: Matrix, sides: DataFrame) -> DataFrame:
    """``(gene, word, changed, excepted)``: bitmaps of the terms that differ though both vocabularies
    have them, and of those that do not differ though only one has them.

    Each side has one bitmap for ``'1'``, one for ``'NA'`` and one for any other value; what is not
    listed is ``'0'`` where the vocabulary has the term and ``'NA'`` where it has not. Cells are
    united by gene and word before the shuffle, then one side is XORed with the other. Only
    cells that hold another value on both sides are compared one by one.
    """
    placed = {"a": _placed(a, sides), "b": _placed(b, sides)}
    kinds = {"one": F.col("value") == "1", "na": F.col("value") == "NA", "odd": ~F.col("value").isin("1", "NA")}
    none = F.lit(0).cast("bigint")
    names = [f"{kind}_{side}" for side in placed for kind in kinds] + ["same"]

    def words(rows: DataFrame, **bits) -> DataFrame:
        return rows.select("gene", word_of("place").alias("word"), *[bits.get(name, none).alias(name) for name in names])

    each = [
        words(rows, **{f"{kind}_{side}": F.when(test, bit_of("place")).otherwise(none) for kind, test in kinds.items()})
        for side, rows in placed.items()
    ]
    odd_a, odd_b = (
        rows.where(kinds["odd"]).select("gene", "place", F.col("value").alias(f"v{side}")) for side, rows in placed.items()
    )
    each.append(words(odd_a.join(odd_b, ["gene", "place"]).where("va = vb"), same=bit_of("place")))
    united = each[0].unionByName(each[1]).unionByName(each[2]).groupBy("gene", "word").agg(
        *[F.bit_or(name).alias(name) for name in names]
    )
    has = [F.bit_or(F.when(F.col("sides").bitwiseAND(side) > 0, bit_of("idx")).otherwise(none)).alias(name) for side, name in ((1, "in_a"), (2, "in_b"))]
    masks = sides.groupBy(word_of("idx").alias("word")).agg(*has)
    known = spread_join(united, masks, "word", salt_by=["gene"])
    differs = F.expr(
        "((one_a ^ one_b) | ((na_a | ~in_a) ^ (na_b | ~in_b)) | odd_a | odd_b) & ~same"
    )
    alone = F.expr("in_a ^ in_b")
    return known.select(
        "gene", "word", differs.bitwiseAND(F.bitwise_not(alone)).alias("changed"), alone.bitwiseAND(F.bitwise_not(differs)).alias("excepted")
    ).where("changed <> 0 OR excepted <> 0")


def compared_cells(words: DataFrame, sides: DataFrame) -> DataFrame:
    """``(gene, idx, term, differs)`` of the bits in ``compared_words``."""
    both = F.array(
        F.struct(F.lit(True).alias("differs"), F.col("changed").alias("bits")),
        F.struct(F.lit(False).alias("differs"), F.col("excepted").alias("bits")),
    )
    rows = words.select("gene", "word", F.inline(both)).where("bits <> 0")
    entries = sides.select(F.struct("idx", "term").alias("entry"), "idx")
    return named(rows, entries, "entry", "idx", settled=True).select("gene", "entry.idx", "entry.term", "differs")


def compare(a: Matrix, b: Matrix) -> Comparison:
    """Compare the genes of ``a`` with those of ``b``; genes only in ``b`` are ignored."""
    sides = _sides(a, b)
    one_sided = sides.where("sides <> 3").select("idx", "term")
    words, _ = cut(compared_words(a, b, sides), "compared-words")
    cells = compared_cells(words, sides)
    counts = words.groupBy("gene").agg(
        *[F.sum(F.bit_count(name)).alias(name) for name in ("changed", "excepted")]
    )
    genes = (
        a.genes.select("gene", F.col("status").alias("label_a"))
        .join(b.genes.select("gene", F.col("status").alias("label_b"), F.lit(True).alias("in_b")), "gene", "left")
        .join(counts, "gene", "left")
        .withColumn("alone", one_sided.select(F.count(F.lit(1)).alias("n")).scalar())
    )
    differing = F.coalesce("changed", F.lit(0)) + F.col("alone") - F.coalesce("excepted", F.lit(0))
    mismatches = F.array_compact(
        F.array(
            F.when(F.col("label_a") != F.col("label_b"), STATUSES[1]),
            F.when(differing > 0, STATUSES[2]),
        )
    )
    shared = F.col("in_b").isNotNull()
    statuses = (
        F.when(~shared, F.array(F.lit(STATUSES[0])))
        .when(F.size(mismatches) > 0, mismatches)
        .otherwise(F.array(F.lit(STATUSES[3])))
    )
    return Comparison(
        genes.select("gene", "label_a", "label_b", shared.alias("shared"), statuses.alias("statuses")), cells, one_sided
    )


def differing_terms(comparison: Comparison) -> DataFrame:
    """``(gene, terms)``: the sorted differing terms of shared genes, joined by ``;``.

    They are put together in blocks of the sorted terms, so that no list of all terms is needed
    in one place before the text itself.
    """
    block = F.floor(F.col("idx") / BLOCK).alias("block")
    shared = comparison.genes.where("shared").select("gene")
    own = (
        spread_join(comparison.cells.select("gene", block, "idx", "term", "differs"), shared, "gene", "left_semi", ["idx"])
        .groupBy("gene", "block").agg(
            F.collect_list(F.when(F.col("differs"), F.struct("idx", "term"))).alias("more"),
            F.collect_set(F.when(~F.col("differs"), F.col("idx"))).alias("less"),
        )
    )
    alone, _ = cut(
        comparison.one_sided.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("idx", "term"))).alias("terms")),
        "one-sided",
    )
    # one number for every BLOCK terms of the vocabularies
    blocks = [row["block"] for row in alone.select("block").collect()]
    asked = shared.select("gene", F.explode(F.lit(blocks).cast("array<bigint>")).alias("block"))
    listed = spread_join(asked, alone, "block", salt_by=["gene"])
    none = F.array().cast("array<struct<idx:bigint,term:string>>")
    terms = F.filter(
        F.coalesce("terms", none), lambda x: ~F.array_contains(F.coalesce("less", F.array().cast("array<bigint>")), x["idx"])
    )
    pieces = listed.join(own, ["gene", "block"], "full").select(
        "gene", "block", F.sort_array(F.concat(terms, F.coalesce("more", none))).alias("terms")
    ).where(F.size("terms") > 0)
    text = F.array_join(F.transform("terms", lambda x: x["term"]), ";")
    return pieces.select("gene", F.struct("block", text.alias("text")).alias("piece")).groupBy("gene").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda x: x["text"]), ";").alias("terms")
    )


def report(comparison: Comparison) -> DataFrame:
    """The report rows with their group and its rank, not sorted.

    A gene with two statuses appears in both groups with the joined text.
    """
    rows = comparison.genes.join(differing_terms(comparison), "gene", "left")
    return rows.select(
        F.col("gene").alias("Gene"),
        F.col("label_a").alias("Label A"),
        F.coalesce("label_b", F.lit("")).alias("Label B"),
        F.coalesce("terms", F.lit("")).alias("GO Terms Differ"),
        F.array_join("statuses", ";").alias("Status"),
        F.explode("statuses").alias("group"),
    ).withColumn("rank", F.array_position(F.lit(list(STATUSES)), F.col("group")))


def ordered_report(comparison: Comparison) -> DataFrame:
    """The report by status group and then gene."""
    rows, _ = cut(report(comparison), "report")  # sorting looks at its rows twice
    return rows.orderBy("rank", "Gene").drop("rank", "group")


def status_counts(comparison: Comparison) -> DataFrame:
    """Rows per status group, zeros included."""
    spark = comparison.genes.sparkSession
    names = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = (
        comparison.genes.select(F.explode("statuses").alias("status"))
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return names.join(counts, "status", "left").select(
        "status", F.coalesce("rows", F.lit(0)).alias("rows")
    )
