"""ARFF reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.functions.text import strip, strip_quotes, stripped_parts
from traitloom.operators.matrix import Matrix
from traitloom.operators.ordering import dense_index
from traitloom.operators.skew import spread_join
from traitloom.scratch import cut
from traitloom.sources.lines import POSITION, read_lines


def read_arff_lines(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """``(attributes, data)``: attribute names with their place, data lines with theirs.

    Blank lines and ``%`` comments are skipped. A folder of part files is read
    in the order of the file names.
    """
    lines = (
        read_lines(spark, path)
        .withColumn("value", strip(F.col("value")))
        .where((F.col("value") != "") & ~F.col("value").startswith("%"))
        .select("value", F.struct(*POSITION).alias("place"))
    )
    lower = F.lower("value")
    is_attribute = lower.startswith("@attribute")
    attributes = lines.where(is_attribute).select(
        strip_quotes(F.get(F.split("value", r"\s+"), F.lit(1))).alias("term"), "place"
    )
    marker = lines.where(lower == "@data").select(F.min("place").alias("place")).scalar()
    data = lines.where(~is_attribute & (lower != "@data") & (F.col("place") > marker))
    return attributes, data


def read_arff(spark: SparkSession, path) -> Matrix:
    """An ARFF file as a sparse matrix.

    The first attribute is the gene and the last the class; the last row of a
    repeated gene wins. Only values other than ``'0'`` become cells. Rows with
    fewer values than attributes hold ``'NA'`` in the missing places.
    """
    attributes, data = read_arff_lines(spark, path)
    indexed, count = dense_index(attributes, ["place"], "at")
    # a name listed twice keeps its last place, as a dictionary would
    vocab, named = cut(
        indexed.where((F.col("at") > 0) & (F.col("at") < count - 1))
        .groupBy("term")
        .agg((F.max("at") - 1).alias("idx")),
        "vocabulary",
    )
    terms = max(count - 2, 0)
    values = F.slice("parts", 2, F.greatest(F.size("parts") - 2, F.lit(0)))
    missing = F.greatest(F.lit(terms) - F.size(values), F.lit(0))
    padded = F.concat(values, F.array_repeat(F.lit("NA"), missing))
    # filtered as an array, so that neither a shuffle nor a row sees the zeros
    entries = F.filter(
        F.transform(
            padded, lambda value, i: F.struct(i.cast("bigint").alias("idx"), value.alias("value"))
        ),
        lambda entry: (entry["value"] != "0") & (entry["idx"] < terms),
    )
    last = (
        data.select(stripped_parts(F.col("value"), ",").alias("parts"), "place")
        .select(
            F.col("parts")[0].alias("gene"),
            F.struct(F.element_at("parts", -1).alias("status"), entries.alias("entries")).alias("row"),
            "place",
        )
        .groupBy("gene")
        .agg(F.max_by("row", "place").alias("row"))
    )
    rows, _ = cut(last.select("gene", "row.status", "row.entries"), "arff")
    genes = rows.select("gene", "status")
    cells = rows.select("gene", F.inline("entries"))
    if named < terms:
        cells = spread_join(cells, vocab, "idx", "left_semi", ["gene"], settled=True)
    return Matrix(genes=genes, cells=cells, vocab=vocab)
