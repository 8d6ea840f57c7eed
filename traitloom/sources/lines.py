"""Text lines with their place in the file, and ragged tab-separated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns that order the lines of a text source: file, split, row within the scan.
POSITION = ("_file", "_block", "_seq")

_QUOTED_CELLS = r'\t("(?:[^"]++|"")*+"[^\t]*+|[^\t]*+)'
_QUOTED_CELL = r'(?s)^"((?:[^"]++|"")*+)"(.*)$'


def read_lines(spark: SparkSession, path, separator: str | None = None) -> DataFrame:
    """``value`` plus the columns of ``POSITION``.

    A split is read front to back, so within one file and split the generated
    id grows with the line number. Part files are in the order of their numbers,
    whatever their digits, and files of other names in the order of these.
    """
    reader = spark.read
    if separator is not None:
        reader = reader.option("lineSep", separator)
    path_of = F.col("_metadata.file_path")
    number = F.lpad(F.regexp_extract(path_of, r"/part-(\d+)[^/]*$", 1), 12, "0")
    return reader.text(path).select(
        "value",
        F.concat(number, path_of).alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )


def _unquote(cell: Column) -> Column:
    inner = F.replace(F.regexp_extract(cell, _QUOTED_CELL, 1), F.lit('""'), F.lit('"'))
    return F.when(
        cell.rlike(_QUOTED_CELL), F.concat(inner, F.regexp_extract(cell, _QUOTED_CELL, 2))
    ).otherwise(cell)


def cells_of(line: Column) -> Column:
    """Split a line on tabs; cells in double quotes may hold tabs and doubled quotes."""
    quoted = F.transform(
        F.regexp_extract_all(F.concat(F.lit("\t"), line), F.lit(_QUOTED_CELLS), F.lit(1)),
        _unquote,
    )
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, "\t", -1))


def read_rows(spark: SparkSession, path) -> DataFrame:
    """``cells array<string>`` of each line that is not blank, plus ``POSITION``."""
    lines = read_lines(spark, path)
    if str(path).endswith(".gz"):
        # one task reads such a file; what follows shall not be one task, too
        lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (
        lines.where(F.col("value") != "")
        .select(cells_of(F.col("value")).alias("cells"), *POSITION)
    )


def cell(index: int) -> Column:
    """A cell of ``cells``; ``''`` where the row is too short."""
    return F.coalesce(F.get("cells", F.lit(index)), F.lit(""))


def wide_enough(skip_below: int, need: int, on_short: str = "fail") -> Column:
    """Row test: skip rows under ``skip_below`` columns, then insist on ``need``."""
    if on_short not in ("fail", "skip"):
        raise ValueError(f"on_short must be 'fail' or 'skip', not {on_short!r}")
    width = F.size("cells")
    short = F.lit(False)
    if on_short == "fail":
        message = F.concat(
            F.lit(f"a row needs {need} columns: "), F.array_join("cells", "\t")
        )
        short = F.raise_error(message).cast("boolean")
    return F.when(width < skip_below, False).when(width >= need, True).otherwise(short)
