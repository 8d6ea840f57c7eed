import pytest
from conftest import tuples
from pyspark.sql import functions as F

from traitloom.operators import skew
from traitloom.operators.annotate import annotate, restrict_genes, term_positions, without_first
from traitloom.operators.bitmaps import carried
from traitloom.operators.ordering import dense_index
from traitloom.operators.skew import hot_keys, spread_join
from traitloom.scratch import cut, cut_measured, scratch_path, shared_folder


@pytest.fixture
def skewed(spark):
    """A third of the rows have the key 0."""
    return spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id AS v")


def test_hot_keys_are_few(spark, skewed):
    found, count = hot_keys(skewed, ["k"], "salts")
    assert count == 1 and tuples(found) == [(0, 2)]  # 1000 of 3000 rows fill 4/3 of 4 partitions


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, skewed, no_broadcast, how):
    few = spark.range(0, 1500).selectExpr("id AS k", "id * 2 AS w")
    assert tuples(spread_join(skewed, few, "k", how)) == tuples(skewed.join(few, "k", how))


def test_both_sides_hot(spark, skewed, no_broadcast):
    few = spark.range(60).selectExpr("CASE WHEN id % 2 = 0 THEN 0 ELSE id END AS k", "id AS w")
    joined = spread_join(skewed, few, "k", salt_by=["v"], few_salt_by=["w"])
    assert "_few_salt" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert tuples(joined) == tuples(skewed.join(few, "k"))
    with pytest.raises(ValueError):
        spread_join(skewed, few, "k", "left", few_salt_by=["w"])


def test_hot_key_is_spread_over_tasks(spark, skewed, no_broadcast):
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        few = spark.range(0, 3000).selectExpr("id AS k", "id AS w")
        joined = spread_join(skewed, few, "k", salt_by=["v"])
        sizes = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert sizes < 500
        assert joined.count() == 3000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_dense_index(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 AS x")
    indexed, rows = dense_index(df, ["x"], "i")
    assert rows == 1000 and indexed.where("x <> i").count() == 0
    empty, rows = dense_index(df.where("x < 0"), ["x"], "i")
    assert rows == 0 and empty.count() == 0


def test_cut_tables_live_in_the_shared_folder(spark):
    table, rows = cut(spark.range(10), "t")
    assert rows == 10 and shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert all(shared_folder(spark) in file for file in table.inputFiles())
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    empty, measured = cut_measured(spark.range(10).where("id < 0"), "t", top=F.max("id"))
    assert measured == {"rows": 0, "top": None} and empty.count() == 0
    nothing, rows = cut(spark.createDataFrame([], "a int"), "t")
    assert rows == 0 and nothing.count() == 0


def test_annotate_counts_copies(spark, no_broadcast):
    labels = spark.createDataFrame([("a", "lethal"), ("b", "viable"), ("z", "viable")], "gene string, status string")
    rows = [("a", "t1")] * 5 + [("a", "t2"), ("b", "t1"), ("c", "t1")]
    annotated = annotate(labels, spark.createDataFrame(rows, "gene string, term string"))
    assert tuples(annotated) == [("a", "lethal", "t1", 5), ("a", "lethal", "t2", 1), ("b", "viable", "t1", 1)]
    genes = spark.createDataFrame([("a",), ("a",)], "gene string")
    assert tuples(restrict_genes(annotated, genes), "gene", "term") == [("a", "t1"), ("a", "t2")]


def test_positions_and_first(spark, no_broadcast):
    rows = [("a", "t3", 5), ("a", "t1", 1), ("a", "t1", 9), ("b", "t1", 2)]
    listed = spark.createDataFrame(rows, "gene string, term string, at int")
    assert tuples(term_positions(listed, ["at"]), "gene", "nth", "term") == [
        ("a", 0, "t1"), ("a", 1, "t3"), ("a", 2, "t1"), ("b", 0, "t1")]
    assert tuples(without_first(listed, ["at"]), "gene", "term", "copies") == [("a", "t1", 1), ("a", "t3", 1)]
    twice = listed.union(listed)
    assert tuples(without_first(twice, ["at"]), "gene", "at", "copies") == [
        ("a", 1, 1), ("a", 5, 2), ("a", 9, 2), ("b", 2, 1)]


def test_steps_look_for_hot_keys_once(spark, no_broadcast, monkeypatch):
    """A place that 300 steps leave, and a chain behind one of them."""
    steps = [(0, i) for i in range(1, 301)] + [(i, i + 1) for i in range(300, 312)]
    looked = []
    monkeypatch.setattr(skew, "hot_keys", lambda *args: looked.append(args) or hot_keys(*args))
    start = spark.createDataFrame([(0, 0, 1), (300, 0, 2)], "at long, word long, bits long")
    found = carried(cut(spark.createDataFrame(steps, "at long, next long"), "steps")[0], start)
    assert tuples(found) == [(i, 0, 1) for i in range(1, 301)] + [(i, 0, 3) for i in range(301, 313)]
    assert len(looked) == 1
