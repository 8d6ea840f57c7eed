"""Row classifiers: phenotype rows to ``(gene, status)`` observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.functions.text import (
    any_cell_contains,
    any_cell_equals,
    before,
    contains_any,
)
from traitloom.operators.matching import WORD_LIMIT, flag_texts, short_list, text_key
from traitloom.operators.skew import spread_join
from traitloom.sources.lines import cell


def allele_status(
    phenotype: Column,
    lethal: Sequence[str] = ("lethal", "die"),
    viable: Sequence[str] = ("viable",),
) -> Column:
    """Case-insensitive substring rule; lethal words are tested first."""
    text = F.lower(phenotype)
    return (
        F.when(contains_any(text, lethal), "lethal")
        .when(contains_any(text, viable), "viable")
        .otherwise("other")
    )


def tag_status(
    tag: Column,
    lethal: tuple[str, str, str] = ("lethal", "semi-lethal", "dead"),
    viable: tuple[str, str, str] = ("viable", "semi-viable", "alive"),
) -> Column:
    """Each rule is (word, longer word that cancels it, word that always counts)."""

    def holds(rule: tuple[str, str, str]) -> Column:
        word, unless, always = rule
        return (tag.contains(word) & ~tag.contains(unless)) | tag.contains(always)

    return F.when(holds(lethal), "lethal").when(holds(viable), "viable").otherwise("other")


def cells_status(
    cells: Column, drop: str = "partially", lethal: str = "lethal", viable: str = "viable"
) -> Column:
    """Status by words in any cell; null where ``drop`` occurs."""
    return (
        F.when(any_cell_contains(cells, drop), F.lit(None).cast("string"))
        .when(any_cell_contains(cells, lethal), "lethal")
        .when(any_cell_contains(cells, viable), "viable")
        .otherwise("other")
    )


def observe_yeast(rows: DataFrame) -> DataFrame:
    """The status is the phenotype text itself."""
    kept = rows.where(any_cell_equals(F.col("cells"), "inviable") | cell(9).contains("viable"))
    return kept.select(cell(0).alias("gene"), cell(9).alias("status"))


def observe_fly(rows: DataFrame) -> DataFrame:
    return rows.select(
        before(cell(0), "[").alias("gene"), cells_status(F.col("cells")).alias("status")
    ).where(F.col("status").isNotNull())


def observe_fly_with(
    rows: DataFrame, drivers: DataFrame, limit: int = WORD_LIMIT
) -> DataFrame:
    """Fly rules that also look at ``with`` partners which are no driver lines.

    A cell naming a driver line is left out of the ``with`` tests.
    """
    few = short_list(drivers, limit)
    partner = F.filter("cells", lambda x: x.contains("with"))
    if few is not None:
        marked = rows.withColumn("_undriven", F.filter(partner, lambda x: ~contains_any(x, few)))
    else:
        # the distinct cells that mention a partner, then back to the rows by key
        keyed = rows.withColumn("_row", text_key(F.to_json(F.struct("cells"))))
        partners = (
            keyed.where(F.size(partner) > 0)
            .groupBy("_row").agg(F.any_value("cells").alias("cells"))
            .select("_row", F.explode(partner).alias("_cell"))
        )
        left = flag_texts(partners, "_cell", drivers, "_driven", limit).where(~F.col("_driven"))
        per_row = left.groupBy("_row").agg(F.collect_set("_cell").alias("_undriven"))
        marked = spread_join(keyed, per_row, "_row", "left").withColumn(
            "_undriven", F.coalesce("_undriven", F.array().cast("array<string>"))
        )
    cells = F.col("cells")
    lethal = any_cell_contains(cells, "lethal")
    viable = any_cell_contains(cells, "viable")
    dropped = any_cell_contains(cells, "partially") | any_cell_contains(
        F.col("_undriven"), "lethal"
    )
    status = (
        F.when(lethal & (F.size("_undriven") == 0), "lethal")
        .when(viable, "viable")
        .otherwise("other")
    )
    return marked.where(~dropped).select(
        before(cell(0), "[").alias("gene"), status.alias("status")
    )


def observe_fish(rows: DataFrame) -> DataFrame:
    status = tag_status(cell(10))
    gene = F.when(status == "other", before(cell(1), "[")).otherwise(cell(1))
    return rows.select(gene.alias("gene"), status.alias("status"))


def observe_worm(rows: DataFrame, terms: DataFrame, limit: int = WORD_LIMIT) -> DataFrame:
    """Lethal if the term cell holds a listed id and the qualifier no ``NOT``."""
    parts = rows.select(
        cell(2).alias("gene"), cell(4).alias("_term"), cell(3).contains("NOT").alias("_not")
    )
    flagged = flag_texts(parts, "_term", terms, "_listed", limit)
    status = F.when(F.col("_listed") & ~F.col("_not"), "lethal").otherwise("viable")
    return flagged.select("gene", status.alias("status"))


def observe_mouse(rows: DataFrame, terms: DataFrame, limit: int = WORD_LIMIT) -> DataFrame:
    """Lethal if the term cell holds a listed id; rows of several markers are skipped."""
    parts = rows.select(cell(5).alias("gene"), cell(3).alias("_term")).where(
        ~F.col("gene").contains(",")
    )
    flagged = flag_texts(parts, "_term", terms, "_listed", limit)
    return flagged.select(
        "gene", F.when(F.col("_listed"), "lethal").otherwise("viable").alias("status")
    )


def observe(
    rows: DataFrame,
    species: str,
    terms: DataFrame | None = None,
    drivers: DataFrame | None = None,
) -> DataFrame:
    """Classify phenotype rows by the rules of a species.

    ``terms`` is needed for worm and mouse; giving ``drivers`` for fly turns the
    partner rules on.
    """
    if species in ("worm", "mouse"):
        if terms is None:
            raise ValueError(f"{species} needs a table of lethal terms")
        return (observe_worm if species == "worm" else observe_mouse)(rows, terms)
    if species == "fly" and drivers is not None:
        return observe_fly_with(rows, drivers)
    rules = {"yeast": observe_yeast, "fly": observe_fly, "fish": observe_fish}
    return rules[species](rows)
