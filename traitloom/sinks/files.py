"""Writers. Each makes a folder of part files, in order where the format has one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.functions.text import python_bool
from traitloom.operators.diff import Comparison, report
from traitloom.operators.matrix import Matrix, arff_header, arff_line, sparse_rows
from traitloom.scratch import cut, free_shuffles
from traitloom.sources.lines import POSITION

_MODE = "errorifexists"


def ordered(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows so that the parts, in name order, are sorted."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def ordered_lines(df: DataFrame, order: list[str]) -> DataFrame:
    return ordered(df, order).select("line")


_ARFF_ORDER = ["section", "at", "gene"]


def _arff_items(matrix: Matrix) -> DataFrame:
    """Header lines, and data rows that are still sparse, with their order keys."""
    header = arff_header(matrix.vocab).select(
        "section",
        "at",
        F.lit("").alias("gene"),
        F.lit("").alias("status"),
        F.array().cast("array<bigint>").alias("ix"),
        "line",
    )
    rows = sparse_rows(matrix).select(
        F.lit(3).alias("section"),
        F.lit(0).cast("bigint").alias("at"),
        F.col("gene").cast("string").alias("gene"),
        "status",
        "ix",
        F.lit(None).cast("string").alias("line"),
    )
    return header.unionByName(rows)


def _with_lines(items: DataFrame, matrix: Matrix) -> DataFrame:
    width = matrix.vocab.select(F.count(F.lit(1)).alias("width")).scalar()
    lines = items.withColumn("width", width)
    return lines.select(*_ARFF_ORDER, F.coalesce("line", arff_line(F.col("width"))).alias("line"))


def arff_lines(matrix: Matrix) -> DataFrame:
    """All lines of an ARFF file with their order keys ``(section, at, gene)``."""
    return _with_lines(_arff_items(matrix), matrix)


def write_arff(matrix: Matrix, path: str, mode: str = _MODE) -> None:
    """The rows are sorted while sparse and written out dense."""
    _with_lines(ordered(_arff_items(matrix), _ARFF_ORDER), matrix).select("line").write.mode(
        mode
    ).text(path)


def pair_lines(labelled: DataFrame) -> DataFrame:
    """A row for each line; for ``(gene, terms, label)`` one row for all lines of a list."""
    if "terms" not in labelled.columns:
        return labelled.select(F.concat_ws("\t", "gene", "term", F.col("label").cast("string")).alias("line"))
    # what stands between two terms: the end of one line and the gene of the next
    gene = F.coalesce(F.concat("gene", F.lit("\t")), F.lit(""))
    label = F.concat(F.lit("\t"), F.col("label").cast("string"))
    terms = F.call_function("array_join", F.col("terms"), F.concat(label, F.lit("\n"), gene))
    return labelled.where(F.size("terms") > 0).select(F.concat(gene, terms, label).alias("line"))


def write_pairs(
    labelled: DataFrame, path: str, mode: str = _MODE, compression: str = "none", waves: int = 1
) -> None:
    """``gene<TAB>term<TAB>1|0`` lines without a header.

    With more ``waves`` the plan runs once for each share of the genes, and only the shuffles of one share
    stand on disk at a time. The folder is marked as a success after the last.
    """
    if waves > 1 and mode == "ignore":
        raise ValueError("later waves would be added to a folder that the first one ignores")
    for wave in range(waves):
        share = labelled
        if waves > 1:
            share = labelled.where(F.pmod(F.xxhash64("gene"), F.lit(waves)) == wave)
        pair_lines(share).write.mode(mode if wave == 0 else "append").option("compression", compression).option(
            "mapreduce.fileoutputcommitter.marksuccessfuljobs", str(wave == waves - 1).lower()
        ).text(path)
        if waves > 1:
            free_shuffles(labelled.sparkSession)


def write_adjacency(adjacency: DataFrame, path: str, mode: str = _MODE) -> None:
    """One JSON object ``{"id", "side", "other"}`` for each neighbour of a term, by id."""
    ordered(adjacency, ["id", "side", "other"]).write.mode(mode).json(path)


def write_nodes(terms: DataFrame, path: str, mode: str = _MODE) -> None:
    ordered_lines(terms.select(F.col("term").alias("line")), ["line"]).write.mode(mode).text(path)


def write_attributes(lines: DataFrame, path: str, mode: str = _MODE) -> None:
    ordered_lines(lines, ["line"]).write.mode(mode).text(path)


def csv_cell(cell: Column) -> Column:
    """A cell as it is; quoted if it holds a comma, a quote or a line break, and empty if null."""
    text = F.coalesce(cell.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike(r'[",\r\n]'), quoted).otherwise(text)


def csv_lines(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """``(section, *order, line)``: one header line in section 0, then a line for each row."""
    keys = df.select(*order).schema
    header = df.sparkSession.createDataFrame([(",".join(columns),)], "line string").select(
        F.lit(0).alias("section"), *[F.lit(None).cast(key.dataType).alias(key.name) for key in keys], "line"
    )
    line = F.concat_ws(",", *[csv_cell(F.col(f"`{name}`")) for name in columns])
    return header.unionByName(df.select(F.lit(1).alias("section"), *order, line.alias("line")))


def _write_csv(df: DataFrame, columns: list[str], order: list[str], path: str, mode: str) -> None:
    """Parts in name order are the file; a line break inside a cell stays one."""
    ordered_lines(csv_lines(df, columns, order), ["section", *order]).write.mode(mode).text(path)


REPORT_COLUMNS = ["Gene", "Label A", "Label B", "GO Terms Differ", "Status"]
RAW_COLUMNS = ["gene", "allele", "context", "phenotype", "simple_pheno"]
SUMMARY_COLUMNS = ["gene", "ever_lethal", "ever_viable", "summary"]


def write_report(comparison: Comparison, path: str, mode: str = _MODE) -> None:
    rows, _ = cut(report(comparison), "report")  # sorting looks at its rows twice
    _write_csv(rows, REPORT_COLUMNS, ["rank", "Gene"], path, mode)


def raw_columns(records: DataFrame) -> DataFrame:
    return records.select(*RAW_COLUMNS)


def write_raw(records: DataFrame, path: str, mode: str = _MODE) -> None:
    """In the order of the records, as far as they say where they stood."""
    order = [name for name in POSITION if name in records.columns]
    _write_csv(records, RAW_COLUMNS, order or ["gene", "allele"], path, mode)


def summary_columns(summary: DataFrame) -> DataFrame:
    """The summary with its flags as ``True`` and ``False`` texts."""
    return summary.select(
        "gene",
        python_bool(F.col("ever_lethal")).alias("ever_lethal"),
        python_bool(F.col("ever_viable")).alias("ever_viable"),
        "summary",
    )


def write_summary(summary: DataFrame, path: str, mode: str = _MODE) -> None:
    _write_csv(summary_columns(summary), SUMMARY_COLUMNS, ["gene"], path, mode)


def write_terms(named: DataFrame, path: str, mode: str = _MODE) -> None:
    """``ID<TAB>Name`` lines below one header line."""
    spark = named.sparkSession
    header = spark.createDataFrame([(0, "", "ID\tName")], "section int, id string, line string")
    rows = named.select(
        F.lit(1).alias("section"), F.col("ID").alias("id"), F.concat_ws("\t", "ID", "Name").alias("line")
    )
    ordered_lines(header.unionByName(rows), ["section", "id"]).write.mode(mode).text(path)
