import pytest
from conftest import tuples, written_lines
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from traitloom.operators import diff as di
from traitloom.operators import matrix as mx
from traitloom.operators import ontology as on
from traitloom.queries.registry import _rough_lines
from traitloom.sinks import files
from traitloom.sources.arff import read_arff

A = [("g1", "lethal", "GO:5"), ("g1", "lethal", "GO:3"), ("g2", "viable", "GO:1"), ("o'c", "viable", "GO:6"),
     ("o'c", "viable", "XX:1")]
EDGES = [("GO:1", "GO:2"), ("GO:1", "GO:3"), ("GO:2", "GO:4"), ("GO:3", "GO:4"), ("GO:4", "GO:5"), ("GO:1", "XX:1")]


@pytest.fixture(scope="module")
def annotated(spark):
    return spark.createDataFrame(A, "gene string, status string, term string")


@pytest.fixture(scope="module")
def closure(spark):
    return on.ancestors(spark.createDataFrame(EDGES, "parent string, child string"))


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame([(f"GO:{i}",) for i in range(1, 6)], "term string")


def lines_of(matrix):
    lines = files.arff_lines(matrix).where("section = 3").orderBy("gene")
    return [row["line"] for row in lines.collect()]


def test_direct_pruned_encoding(spark, annotated, terms):
    matrix = mx.encode(annotated, terms)
    assert tuples(matrix.vocab, "idx", "term") == [(0, "GO:1"), (1, "GO:3"), (2, "GO:5")]
    assert lines_of(matrix) == ["g1,0,1,1,lethal", "g2,1,0,0,viable", "o-c,0,0,0,viable"]
    unpruned = mx.encode(annotated, terms, prune=False)
    assert lines_of(unpruned)[0] == "g1,0,0,1,0,1,lethal"


def test_repeated_vocabulary_rows_are_not_broadcast(spark, annotated, terms):
    repeated = terms.crossJoin(spark.range(1000)).select("term")
    used = mx.used_terms(repeated, annotated, None)
    assert tuples(used) == [("GO:1",), ("GO:3",), ("GO:5",)]
    # both sides of the join are made distinct
    assert used._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [term") == 2


def test_propagated_encoding(spark, annotated, terms, closure):
    matrix = mx.encode(annotated, terms, closure, prune=False, mark="GO")
    assert lines_of(matrix) == ["g1,1,1,1,1,1,lethal", "g2,1,0,0,0,0,viable", "o-c,0,0,0,0,0,viable"]
    pruned = mx.encode(annotated.where("gene = 'g2'"), terms, closure, mark="GO")
    assert tuples(pruned.vocab, "term") == [("GO:1",)]


def test_pairs(spark, annotated, closure):
    obsolete = spark.createDataFrame([("GO:6",)], "term string")
    pairs = mx.term_pairs(annotated, closure, "GO", obsolete)
    labelled = tuples(mx.labelled_pairs(pairs))
    assert labelled == [("g1", f"GO:{i}", 1) for i in range(1, 6)] + [("g2", "GO:1", 0), ("o'c", "GO:6", 0)]
    assert ("o'c", "GO:6", 0) not in tuples(mx.labelled_pairs(mx.term_pairs(annotated, closure, "GO")))
    assert tuples(files.pair_lines(mx.labelled_pairs(pairs)))[-2] == ("g2\tGO:1\t0",)


def test_inherited_terms_travel_as_lists(spark, annotated, closure, monkeypatch):
    pairs = mx.term_pairs(annotated, closure, "GO", settled=True)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct(flatten(" in plan and "bit_or(" not in plan.split("array_distinct(flatten(")[0]
    expected = tuples(pairs)
    # names of all but two ancestors travel, and genes with many of them go through rows
    monkeypatch.setattr(mx, "_SHARED", 2)
    assert tuples(mx.term_pairs(annotated, closure, "GO")) == expected
    monkeypatch.setattr(mx, "_TOGETHER", 7)
    assert tuples(mx.term_pairs(annotated, closure, "GO")) == expected


@settings(max_examples=20, deadline=None)
@given(some.integers(0, 30), some.sets(some.integers(0, 29)))
def test_dense_text_matches_brute_force(spark, width, chosen):
    ix = sorted(i for i in chosen if i < width)
    df = spark.createDataFrame([(ix, width)], "ix array<bigint>, width bigint")
    text = df.select(mx.dense_text(F.col("ix"), F.col("width"))).first()[0]
    assert text == "".join("1," if i in ix else "0," for i in range(width))


def test_empty_vocabulary(spark, annotated, terms):
    matrix = mx.encode(annotated.where("gene = \"o'c\""), terms)
    assert lines_of(matrix) == ["o-c,,viable"]


def test_wide_table(spark, annotated):
    pairs = annotated.where("term < 'X'")
    wide = mx.wide_table(pairs, ["GO:1", "GO:3", "GO:5", "GO:6"])
    assert wide.columns == ["gene", "status", "GO:1", "GO:3", "GO:5", "GO:6"]
    assert tuples(wide)[0] == ("g1", "lethal", 0, 1, 1, 0)


def test_wide_blocks(spark, annotated):
    pairs = annotated.where("term < 'X'").select("gene", "status", "term").distinct()
    vocab, _ = on.vocabulary(pairs.select("term").distinct())
    for width, want in ((1000, [[0, 1, 1, 0]]), (3, [[0, 1, 1], [0]])):
        blocks = mx.wide_blocks(pairs, vocab, width).where("gene = 'g1'").orderBy("block").collect()
        assert [row["flags"] for row in blocks] == want
    many = spark.range(2500).selectExpr("'g' AS gene", "'viable' AS status", "concat('t', 10000 + id * 2) AS term")
    other = spark.range(2500).selectExpr("'h' AS gene", "'lethal' AS status", "concat('t', 10001 + id * 2) AS term")
    both = many.union(other)
    vocab, _ = on.vocabulary(both.select("term").distinct())
    rows = mx.wide_blocks(both, vocab).orderBy("gene", "block").collect()
    flags = {gene: [x for row in rows if row["gene"] == gene for x in row["flags"]] for gene in "gh"}
    assert flags == {"g": [1, 0] * 2500, "h": [0, 1] * 2500}


def test_arff_file_and_round_trip(spark, annotated, terms, tmp_path):
    matrix = mx.encode(annotated, terms)
    path = str(tmp_path / "m.arff")
    files.write_arff(matrix, path)
    assert written_lines(path) == [
        "@RELATION gene_lethality", "", "@ATTRIBUTE gene string", "@ATTRIBUTE GO:1 {0,1}", "@ATTRIBUTE GO:3 {0,1}",
        "@ATTRIBUTE GO:5 {0,1}", "@ATTRIBUTE class {viable,lethal}", "", "@DATA", "g1,0,1,1,lethal",
        "g2,1,0,0,viable", "o-c,0,0,0,viable"]
    read = read_arff(spark, path)
    assert tuples(read.vocab, "idx", "term") == tuples(matrix.vocab, "idx", "term")
    assert tuples(mx.term_cells(read)) == [("g1", "GO:3", "1"), ("g1", "GO:5", "1"), ("g2", "GO:1", "1")]
    assert tuples(di.report(di.compare(read, read)), "Status") == [("EXACT_MATCH",)] * 3
    with pytest.raises(Exception, match="already exists"):
        files.write_arff(matrix, path)


def test_arff_reader_rules(spark, write):
    path = write(
        "a.arff",
        ["% comment", "@relation x", "junk, before", "@attribute gene string", "  @ATTRIBUTE 'GO:1' {0,1}",
         "@attribute \"GO:2\" {0,1}", "@attribute class {a,b}", "", "@Data", " g1 , 1 , 0 , lethal ",
         "% more", "g2,0,0,viable", "g1,0,1,viable", "short,1,lethal", "long,0,1,1,1,viable", "lone"],
    )
    matrix = read_arff(spark, path)
    assert tuples(matrix.vocab) == [("GO:1", 0), ("GO:2", 1)]
    assert tuples(matrix.genes) == [("g1", "viable"), ("g2", "viable"), ("lone", "lone"), ("long", "viable"),
                                    ("short", "lethal")]
    assert tuples(mx.term_cells(matrix)) == [("g1", "GO:2", "1"), ("lone", "GO:1", "NA"), ("lone", "GO:2", "NA"),
                                    ("long", "GO:2", "1"), ("short", "GO:1", "1"), ("short", "GO:2", "NA")]


def test_arff_lines_keep_their_order_over_splits(spark, write):
    rows = [f"g{i % 50},{i % 2},{'lethal' if i >= 450 else 'viable'}" for i in range(500)]
    path = write("a.arff", ["@attribute gene string", "@attribute t {0,1}", "@attribute class {a}", "@data", *rows])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        matrix = read_arff(spark, path)
        assert {row["status"] for row in matrix.genes.collect()} == {"lethal"}
        assert matrix.genes.count() == 50 and matrix.cells.count() == 25
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_repeated_attribute_keeps_its_last_place(spark, write):
    path = write("a.arff", arff(["t", "u", "t"], ["g,1,0,0,viable", "h,0,1,1,lethal"]))
    matrix = read_arff(spark, path)
    assert tuples(mx.term_cells(matrix)) == [("h", "t", "1"), ("h", "u", "1")]
    assert matrix.cells.count() == 2


def arff(attributes, rows):
    return ["@attribute gene string", *[f"@attribute {a} {{0,1}}" for a in attributes], "@attribute class {x}", "@data", *rows]


def test_diff(spark, write):
    a = write("a.arff", arff(["t1", "t2"], ["miss,1,0,lethal", "label,1,0,lethal", "term,1,0,viable", "same,0,1,viable",
                                            "both,1,1,lethal"]))
    b = write("b.arff", arff(["t1", "t2"], ["label,1,0,viable", "term,0,1,viable", "same,0,1,viable", "both,0,1,viable",
                                            "only-b,1,1,viable"]))
    compared = di.compare(read_arff(spark, a), read_arff(spark, b))
    ordered = di.ordered_report(compared)
    assert ordered.columns == ["Gene", "Label A", "Label B", "GO Terms Differ", "Status"]
    both = ("both", "lethal", "viable", "t1", "LABEL_MISMATCH;GO_TERM_MISMATCH")
    assert [tuple(row) for row in ordered.collect()] == [
        ("miss", "lethal", "", "", "MISSING_IN_B"), both, ("label", "lethal", "viable", "", "LABEL_MISMATCH"),
        both, ("term", "viable", "viable", "t1;t2", "GO_TERM_MISMATCH"), ("same", "viable", "viable", "", "EXACT_MATCH")]
    assert dict(tuples(di.status_counts(compared))) == {
        "MISSING_IN_B": 1, "LABEL_MISMATCH": 2, "GO_TERM_MISMATCH": 2, "EXACT_MATCH": 1}


def test_diff_of_different_attribute_lists(spark, write, no_broadcast):
    a = write("a.arff", arff(["t1", "t3"], ["g,1,0,viable", "h,0,0,viable"]))
    b = write("b.arff", arff(["t1", "t0"], ["g,1,0,viable", "h,1,0,viable"]))
    report = di.ordered_report(di.compare(read_arff(spark, a), read_arff(spark, b)))
    assert tuples(report, "Gene", "GO Terms Differ", "Status") == [
        ("g", "t0;t3", "GO_TERM_MISMATCH"), ("h", "t0;t1;t3", "GO_TERM_MISMATCH")]


def test_diff_counts_show_zeros(spark, annotated, terms):
    matrix = mx.encode(annotated, terms)
    assert dict(tuples(di.status_counts(di.compare(matrix, matrix)))) == {
        "MISSING_IN_B": 0, "LABEL_MISMATCH": 0, "GO_TERM_MISMATCH": 0, "EXACT_MATCH": 3}


def test_diff_of_a_short_row(spark, write):
    """A term of one side that the gene's short row does not reach is 'NA' on both sides."""
    a = write("a.arff", ["@attribute gene string", "@attribute T1 {0,1}", "@attribute T2 {0,1}", "@attribute class {x}",
                         "@data", "g1,1,viable", "g2,1,0,viable"])
    b = write("b.arff", ["@attribute gene string", "@attribute T1 {0,1}", "@attribute class {x}", "@data",
                         "g1,1,viable", "g2,1,viable"])
    compared = di.compare(read_arff(spark, a), read_arff(spark, b))
    assert tuples(di.report(compared), "Gene", "GO Terms Differ", "Status") == [
        ("g1", "", "EXACT_MATCH"), ("g2", "T2", "GO_TERM_MISMATCH")]


def test_diff_of_many_one_sided_terms(spark, write):
    """More terms than a block holds, in the order of the terms."""
    names = [f"T{i:04d}" for i in range(1300)]
    head = ["@attribute gene string", *(f"@attribute {name} {{0,1}}" for name in names), "@attribute class {x}", "@data"]
    a = write("a.arff", [*head, "g1," + "0," * 1300 + "viable"])
    b = write("b.arff", ["@attribute gene string", "@attribute T0700x {0,1}", "@attribute class {x}", "@data", "g1,1,viable"])
    report = di.report(di.compare(read_arff(spark, a), read_arff(spark, b))).collect()
    assert [row["GO Terms Differ"] for row in report] == [";".join(sorted([*names, "T0700x"]))]


def test_csv_files_have_one_header_and_keep_blanks(spark, tmp_path):
    rows = spark.range(40).selectExpr(
        "concat('g', 10 + id) AS gene", "'a' AS allele", "' x \"y\", ' AS context", "' lethal, with x ' AS phenotype",
        "'lethal' AS simple_pheno").repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would make one part of so few rows
    files.write_raw(rows, str(tmp_path / "raw"))
    spark.conf.unset("spark.sql.adaptive.enabled")
    lines = written_lines(tmp_path / "raw")
    assert len(list((tmp_path / "raw").glob("part-*"))) > 1
    assert lines[0] == "gene,allele,context,phenotype,simple_pheno"
    assert lines[1:] == [f'g{10 + i},a," x ""y"", "," lethal, with x ",lethal' for i in range(40)]


def test_parts_are_read_by_number(spark, tmp_path):
    folder = tmp_path / "m.arff"
    folder.mkdir()
    (folder / "part-99999-x").write_text("@attribute gene string\n@attribute T1 {0,1}\n@attribute class {x}\n@data\ng,0,viable\n")
    (folder / "part-100000-x").write_text("g,1,lethal\n")
    assert tuples(read_arff(spark, str(folder)).genes) == [("g", "lethal")]


def test_rough_lines_are_written_out_after_the_sort(spark, tmp_path):
    """Sorting runs what stands below it three times and in as few tasks as read the table: no line is made there."""
    lit = [(k, f"n{k % 30}", None if k == 50 else f"Brand#{k % 25 + 1}", None if k == 51 else k % 12) for k in range(60)]
    parts = spark.createDataFrame([*lit, (None, "n", "Brand#2", 4)], "p_partkey bigint, p_name string, p_brand string, p_size int")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    lines = _rough_lines(spark, str(tmp_path), 5, "p_partkey % 4 = 0", "p_size <> 9")
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" in plan and "array_join" not in plan[plan.index("RepartitionByExpression") :]

    def data(key, name, brand, size):
        if size in (7, 8):
            return "% " + name if size == 7 else "  "
        brand = brand and int(brand[6:])
        brand = brand % 25 + 1 if brand and key is not None and key % 4 == 0 else brand
        named = [i for i in range(1, 26) if i != 5]
        wide = {0: 10, 1: 26}.get(size % 5, 24)
        values = [" 1 " if i < 24 and named[i] == brand else "0" for i in range(wide)]
        return f" {name}/{size},{','.join(values)}, {'lethal' if key is not None and key % 3 == 0 else 'viable'}"

    head = ["@RELATION x", "@attribute gene string", *(f"@ATTRIBUTE 'Brand#{i}' {{0,1}}" for i in range(1, 26) if i != 5)]
    rows = [(None, "n", "Brand#2", 4), *(row for row in lit if row[3] is not None and row[3] != 9)]
    want = [*head, "@ATTRIBUTE class {viable,lethal}", "@Data", *(data(*row) for row in rows)]
    assert [row["line"] for row in lines.collect()] == want
