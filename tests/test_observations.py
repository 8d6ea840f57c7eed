"""Sources and classifiers on the rows listed in FIXTURES.md."""

import pytest
from conftest import tuples
from pyspark.errors import PySparkException

from traitloom.operators import classify as cl
from traitloom.operators import labels as lb
from traitloom.sources.tables import (
    read_allele_observations,
    read_annotations,
    read_assignments,
    read_driver_lines,
    read_phenotypes,
    read_term_list,
)
from traitloom.species import SPECIES, species_named


def yeast(gene, phenotype, other="x"):
    return (gene, other, *["x"] * 7, phenotype)


def test_yeast(spark, write):
    path = write(
        "yeast.tsv.gz",
        [yeast("YA", "inviable"), yeast("YB", "viable"), yeast("YC", "viable"), yeast("YC", "inviable"),
         yeast("YD", "growth slow"), yeast("YE", "growth", "inviable"), ""],
    )
    observed = cl.observe(read_phenotypes(spark, path, SPECIES["yeast"]), "yeast")
    lethal = SPECIES["yeast"].lethal
    assert tuples(lb.label(observed, lethal)) == [
        ("YA", "lethal"), ("YB", "viable"), ("YC", "lethal"), ("YE", "viable")]
    assert tuples(lb.label(observed, lethal, "drop")) == [("YA", "lethal"), ("YB", "viable"), ("YE", "viable")]


def test_short_rows_fail_or_are_skipped(spark, write):
    path = write("yeast.tsv.gz", [yeast("YA", "inviable"), ("YB", "viable")])
    with pytest.raises(PySparkException, match="needs 10 columns"):
        read_phenotypes(spark, path, SPECIES["yeast"]).collect()
    assert read_phenotypes(spark, path, SPECIES["yeast"], "skip").count() == 1
    with pytest.raises(ValueError):
        read_phenotypes(spark, path, SPECIES["yeast"], "maybe")


def test_fly(spark, write):
    path = write(
        "fly.tsv.gz",
        [("a[1]", "x", "lethal", "r"), ("b[1]", "x", "viable", "r"), ("c[1]", "x", "partially lethal", "r"),
         ("d[1]", "x", "wing defect", "r"), ("e", "x", "lethal"), ("f[1]", "x", "inviable", "r")],
    )
    observed = cl.observe(read_phenotypes(spark, path, SPECIES["fly"]), "fly")
    assert tuples(observed) == [("a", "lethal"), ("b", "viable"), ("d", "other"), ("f", "viable")]
    assert ("d", "viable") in tuples(lb.label(observed))


@pytest.mark.parametrize("limit", [200, 0])
def test_fly_with_partners(spark, write, limit):
    path = write(
        "fly.tsv.gz",
        [("a[1]", "x", "lethal, with b[2]", "r"), ("c[1]", "x", "lethal, with Gal4", "r"),
         ("d[1]", "x", "lethal", "with e"), ("g[1]", "x", "viable, with b[2]", "r"),
         ("h[1]", "partially", "lethal", "r"), ("i[1]", "x", "lethal viable", "with e"),
         ("j[1]", "x", "wing", "r"), ("k[1]", "x", "lethal", "r")],
    )
    drivers = write("drivers.tsv.gz", [("id", "x", "with"), ("1", "x", "Gal4"), ("2", "x", ""), ("3", "x")])
    names = read_driver_lines(spark, drivers)
    assert tuples(names) == [("Gal4",)]
    rows = read_phenotypes(spark, path, SPECIES["fly"])
    assert tuples(cl.observe_fly_with(rows, names, limit)) == [
        ("c", "lethal"), ("d", "other"), ("g", "viable"), ("i", "viable"), ("j", "other"), ("k", "lethal")]


def test_fish(spark, write):
    tags = ["lethal", "semi-lethal", "dead", "viable", "semi-viable", "alive"]
    path = write("fish.tsv.gz", [("x", f"f{i}[q]", *["x"] * 8, tag) for i, tag in enumerate(tags)])
    observed = cl.observe(read_phenotypes(spark, path, SPECIES["fish"]), "fish")
    assert tuples(observed) == [("f0[q]", "lethal"), ("f1", "other"), ("f2[q]", "lethal"),
                                ("f3[q]", "viable"), ("f4", "other"), ("f5[q]", "viable")]


@pytest.mark.parametrize("limit", [200, 0])
def test_worm_and_mouse(spark, write, limit):
    terms = read_term_list(
        spark, write("terms.tsv.gz", [("ID", "Name"), ("WBPhenotype:0000050", "x"), ("MP:0002080", "y"), ("", "z")])
    )
    assert terms.count() == 2
    worm = write(
        "worm.tsv.gz",
        [("x", "x", "wa", "", "WBPhenotype:0000050"), ("x", "x", "wb", "NOT", "WBPhenotype:0000050"),
         ("x", "x", "wc", "", "WBPhenotype:0000051"), ("x", "x", "wd"),
         ("x", "x", "we", "", "WBPhenotype:00000501")],
    )
    rows = read_phenotypes(spark, worm, SPECIES["worm"])
    assert tuples(cl.observe_worm(rows, terms, limit)) == [
        ("wa", "lethal"), ("wb", "viable"), ("wc", "viable"), ("we", "lethal")]
    mouse = write(
        "mouse.tsv.gz",
        [("x", "x", "x", "MP:0002080", "x", "MGI:1"), ("x", "x", "x", "MP:0002080", "x", "MGI:2,MGI:3"),
         ("x", "x", "x", "MP:1", "x", "MGI:4")],
    )
    rows = read_phenotypes(spark, mouse, SPECIES["mouse"])
    assert tuples(cl.observe_mouse(rows, terms, limit)) == [("MGI:1", "lethal"), ("MGI:4", "viable")]


def test_an_empty_word_list_matches_nothing(spark):
    from traitloom.operators.matching import flag_texts

    texts = spark.createDataFrame([("a",)], "t string")
    none = spark.createDataFrame([], "term string")
    for limit in (200, -1):
        assert tuples(flag_texts(texts, "t", none, "hit", limit)) == [("a", False)]


def test_worm_needs_terms(spark):
    with pytest.raises(ValueError, match="lethal terms"):
        cl.observe(spark.createDataFrame([], "cells array<string>"), "worm")


def gaf(db, gene, term, qualifier="", synonyms="s"):
    return (db, f"{gene}-id", gene, qualifier, term, "x", "x", "x", "x", "x", synonyms)


def test_annotations(spark, write):
    path = write(
        "a.gaf.gz",
        ["!gaf-version: 2.2", gaf("SGD", "A", "GO:1", "", "YA|alias"), gaf("SGD", "A", "GO:1", "", "YA"),
         gaf("SGD", "A", "GO:2", "NOT|part_of", "YA|b"), gaf("FB", "B", "GO:3")],
    )
    read = read_annotations(spark, path, SPECIES["yeast"])
    assert tuples(read, "gene", "term") == [("YA", "GO:1"), ("YA", "GO:1"), ("YA", "GO:2")]
    kept = read_annotations(spark, path, SPECIES["yeast"], exclude_not=True)
    assert tuples(kept, "gene", "term") == [("YA", "GO:1"), ("YA", "GO:1")]
    assert tuples(read_annotations(spark, path, SPECIES["fly"]), "gene", "term") == [("B", "GO:3")]


def test_assignments(spark, write):
    path = write(
        "assign.tsv.gz",
        [("h", "", "", "Current", "melanogaster"), ("a", "", "", "Current", "melanogaster"),
         ("b", "", "", "Withdrawn", "melanogaster"), ("c", "", "", "", "simulans"), ("d", "", "", "", "melanogaster"),
         ("e", "", "", "x")],
    )
    assert tuples(read_assignments(spark, path)) == [("a",), ("d",)]


def test_allele_records(spark, write):
    path = write(
        "alleles.tsv",
        ["# comment", "", "  ", ("a[1]", "FB1", "lethal", "r"), ("a[2]", "FB2", "viable, with x[1]", "r", "more"),
         ("b[1]", "FB3", "Dies early", "r"), ("c", "FB4", "dietary defect", "r"), ("d[1]", "FB5", "wing", "r"),
         ("e[1]", "FB6", "", "")],
    )
    records = read_allele_observations(spark, path)
    assert tuples(records, "gene", "allele", "context", "simple_pheno") == [
        ("a", "a[1]", "", "lethal"), ("a", "a[2]", "x[1]", "viable"), ("b", "b[1]", "", "lethal"),
        ("c", "c", "", "lethal"), ("d", "d[1]", "", "other")]
    summary = lb.gene_summary(records.selectExpr("gene", "simple_pheno AS status"))
    assert dict(tuples(summary, "gene", "summary")) == {
        "a": lb.BOTH, "b": lb.ONLY_LETHAL, "c": lb.ONLY_LETHAL, "d": lb.NEITHER}


def test_species_is_validated():
    assert species_named("Yeast").source_db == "SGD"
    with pytest.raises(ValueError, match="unknown species"):
        species_named("plant")


def test_flag_texts_is_the_same_either_way(spark, no_broadcast):
    """Null texts and words, an empty text and word list entry, repeats, and the order of the columns."""
    from traitloom.operators.matching import flag_texts

    texts = spark.createDataFrame(
        [("abc", 1), (None, 2), ("", 3), ("xbcx", 4), ("abc", 5), ("b" * 500 + "cd", 6)], "t string, n int"
    )
    for words, want in (([("bc",), (None,), ("zz",), ("bcd",)], {1, 4, 5, 6}), ([(None,)], set()), ([("",)], {1, 3, 4, 5, 6})):
        listed = spark.createDataFrame(words, "w string")
        for limit in (200, 0):
            flagged = flag_texts(texts, "t", listed, "hit", limit)
            assert flagged.columns == ["t", "n", "hit"]
            assert {row["n"] for row in flagged.collect() if row["hit"]} == want
            assert flagged.where("hit IS NULL").count() == 0 and flagged.count() == 6
