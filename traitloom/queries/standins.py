"""The given tables read as phenotypes, annotations and an ontology.

Every builder reads a whole table. Ids are texts, as in the real files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.operators.labels import label
from traitloom.operators.matrix import Matrix
from traitloom.operators.ontology import vocabulary
from traitloom.scratch import scratch_path

# Key arithmetic of the stand-in ontology: part k lies below k/2 and k/3.
TERM = "concat(CASE WHEN {k} % 10 = 7 THEN 'XX:' ELSE 'GO:' END, {k})"


def term(key: str) -> str:
    return TERM.format(k=key)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def phenotypes(spark: SparkSession, folder: str) -> DataFrame:
    """``(gene, phenotype)``: customers and the priorities of their orders."""
    return table(spark, folder, "orders").select(
        F.expr("concat('G', o_custkey)").alias("gene"), F.col("o_orderpriority").alias("phenotype")
    )


def observations(spark: SparkSession, folder: str) -> DataFrame:
    phenotype = F.col("phenotype")
    status = (
        F.when(phenotype.contains("URGENT"), "lethal")
        .when(phenotype.contains("LOW"), "viable")
        .otherwise("other")
    )
    return phenotypes(spark, folder).select("gene", status.alias("status"))


def labels(spark: SparkSession, folder: str, mixed: str = "lethal_wins") -> DataFrame:
    return label(observations(spark, folder), mixed=mixed)


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """``(gene, term)``, the keys that order them and a row id, of the source ``A``."""
    lines = table(spark, folder, "lineitem").where("l_returnflag = 'A'")
    lines = lines.withColumn("row", F.monotonically_increasing_id())
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.expr("concat('G', o_custkey)").alias("gene"),
        F.expr(
            f"CASE WHEN l_linenumber = 7 THEN concat('GO:U', l_suppkey) ELSE {term('l_partkey')} END"
        ).alias("term"),
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "row",
    )


ANNOTATION_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey"]


def stanzas(spark: SparkSession, folder: str) -> DataFrame:
    """One ontology term per part: two parents, an alternate id, an obsolete flag."""
    up2, up3 = term("p_partkey div 2"), term("p_partkey div 3")
    no_ids = "cast(array() AS array<string>)"
    return table(spark, folder, "part").select(
        F.expr(term("p_partkey")).alias("id"),
        F.col("p_name").alias("name"),
        F.expr(f"CASE WHEN p_partkey > 0 THEN array_distinct(array({up2}, {up3})) ELSE {no_ids} END").alias("is_a"),
        F.expr(f"CASE WHEN p_size = 1 THEN array(concat('GO:A', p_partkey)) ELSE {no_ids} END").alias("alt_id"),
        F.expr("p_size = 50").alias("is_obsolete"),
    )


def roots(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").where("p_size = 7").select(F.expr(term("p_partkey")).alias("term"))


def assignments(spark: SparkSession, folder: str) -> DataFrame:
    """Customers outside one segment and one nation."""
    return (
        table(spark, folder, "customer")
        .where("c_mktsegment <> 'BUILDING' AND c_nationkey <> 3")
        .select(F.expr("concat('G', c_custkey)").alias("gene"))
    )


def brand_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``(gene, term)`` with a part's brand as the term: a vocabulary of fixed size."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    # their files may be far smaller than their rows, which a broadcast would carry
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey").hint("merge")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand").hint("merge")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.expr("concat('G\\'', o_custkey)").alias("gene"), F.col("p_brand").alias("term"))
    )


def brand_labels(spark: SparkSession, folder: str) -> DataFrame:
    return labels(spark, folder).withColumn("gene", F.expr("concat('G\\'', substr(gene, 2))"))


def side_matrix(
    spark: SparkSession, folder: str, line_status: str, without_type: str | None = None
) -> Matrix:
    """Orders x part types from the lines of one status; lethal if a line was returned."""
    lines = table(spark, folder, "lineitem").where(F.col("l_linestatus") == line_status)
    parts = table(spark, folder, "part").select("p_partkey", "p_type")
    genes = lines.groupBy(F.col("l_orderkey").cast("string").alias("gene")).agg(
        F.when(F.bool_or(F.col("l_returnflag") == "R"), "lethal").otherwise("viable").alias("status")
    )
    pairs = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("gene"), F.col("p_type").alias("term")
    )
    if without_type is not None:
        pairs = pairs.where(F.col("term") != without_type)
    terms, _ = vocabulary(pairs.select("term").distinct())
    cells = pairs.distinct().join(terms, "term").select("gene", "idx", F.lit("1").alias("value"))
    return Matrix(genes=genes, cells=cells, vocab=terms)


def text_file(lines: DataFrame, label: str, compression: str = "gzip") -> str:
    """Write the column ``line`` as text files to the shared folder; return the path."""
    path = scratch_path(lines.sparkSession, label)
    lines.select("line").write.option("compression", compression).text(path)
    return path


def tsv_file(df: DataFrame, label: str, *columns: str) -> str:
    """Write SQL expressions as one tab-separated line per row."""
    joined = ", ".join(f"coalesce(cast({c} AS string), '')" for c in columns)
    return text_file(df.select(F.expr(f"concat_ws('\\t', {joined})").alias("line")), label)
