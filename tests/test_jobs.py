from pathlib import Path
import json

import pytest
from conftest import tuples, written_lines
from test_observations import gaf, yeast
from test_ontology import OBO

from traitloom.plans import jobs


@pytest.fixture
def inputs(write):
    return {
        "phenotypes": write("p.tsv.gz", [yeast("YA", "inviable"), yeast("YB", "viable"), yeast("YC", "viable"),
                                         yeast("YC", "inviable"), yeast("YD", "viable")]),
        "annotations": write("a.gaf.gz", ["!comment", gaf("SGD", "A", "GO:3", "", "YA|x"), gaf("SGD", "A", "GO:5", "", "YA"),
                                          gaf("SGD", "A", "GO:3", "", "YA"), gaf("SGD", "B", "GO:40", "", "YB"),
                                          gaf("SGD", "B", "GO:6", "NOT", "YB"), gaf("SGD", "C", "GO:1", "", "YC"),
                                          gaf("SGD", "Z", "GO:1", "", "YZ"), gaf("FB", "D", "GO:1", "", "YD")]),
        "ontology": write("o.obo.gz", [OBO]),
    }


def data(folder):
    lines = written_lines(f"{folder}/matrix.arff")
    return lines[lines.index("@DATA") + 1 :]


def test_default_matrix(spark, inputs, tmp_path):
    out = str(tmp_path / "out")
    counts = jobs.build_matrix(spark, "yeast", output=out, pair_file=True, **inputs)
    assert data(out) == ["YA,0,1,0,1,lethal", "YB,0,0,1,0,viable", "YC,1,0,0,0,lethal"]
    assert written_lines(f"{out}/nodes.txt") == ["GO:1", "GO:2", "GO:3", "GO:4", "GO:40", "GO:5"]
    assert sorted(written_lines(f"{out}/pairs.tab")) == sorted(
        [f"YA\tGO:{i}\t1" for i in range(1, 6)] + [f"YB\tGO:{i}\t0" for i in (40, 2, 3, 1)] + ["YC\tGO:1\t1"])
    adjacency = [tuple(json.loads(line).values()) for line in written_lines(f"{out}/adjacency.json")]
    assert [row for row in adjacency if row[0] == "GO:4"] == [
        ("GO:4", "c", "GO:5"), ("GO:4", "p", "GO:2"), ("GO:4", "p", "GO:3")]
    assert adjacency == sorted(adjacency)
    assert tuples(counts, "stage", "status", "genes") == [
        ("annotated", "lethal", 2), ("annotated", "viable", 1), ("labelled", "lethal", 2), ("labelled", "viable", 2),
        ("obsolete terms skipped", "", 1), ("terms without a place", "", 1)]


def test_propagated_full_matrix(spark, inputs, tmp_path):
    out = str(tmp_path / "out")
    jobs.build_matrix(spark, "yeast", output=out, propagate=True, prune=False, mixed="drop", **inputs)
    assert data(out) == ["YA,1,1,1,1,0,1,lethal", "YB,1,1,1,0,1,0,viable"]


def test_skip_first_and_keep_obsolete(spark, inputs, tmp_path):
    out = str(tmp_path / "out")
    jobs.build_matrix(spark, "yeast", output=out, propagate=True, prune=False, skip_first=True, pair_file=True,
                      keep_obsolete=True, **inputs)
    # the only annotation of YC is its first; YB keeps just the obsolete term
    assert data(out) == ["YA,1,1,1,1,0,1,lethal", "YB,0,0,0,0,0,0,viable", "YC,0,0,0,0,0,0,lethal"]
    assert sorted(written_lines(f"{out}/pairs.tab")) == [f"YA\tGO:{i}\t1" for i in range(1, 6)] + ["YB\tGO:6\t0"]


def test_unknown_terms_stop_the_job(spark, inputs, write, tmp_path):
    inputs["annotations"] = write("b.gaf.gz", [gaf("SGD", "A", "GO:7", "", "YA"), gaf("SGD", "A", "GO:1", "", "YA")])
    with pytest.raises(jobs.UnknownTerms, match="GO:7"):
        jobs.build_matrix(spark, "yeast", output=str(tmp_path / "x"), **inputs)
    jobs.build_matrix(spark, "yeast", output=str(tmp_path / "y"), on_unknown="drop", **inputs)
    assert data(tmp_path / "y") == ["YA,1,lethal"]


def test_output_is_not_overwritten(spark, inputs, tmp_path):
    out = str(tmp_path / "out")
    jobs.build_matrix(spark, "yeast", output=out, **inputs)
    with pytest.raises(Exception, match="already exists"):
        jobs.build_matrix(spark, "yeast", output=out, **inputs)
    jobs.build_matrix(spark, "yeast", output=out, mode="overwrite", **inputs)


def test_fly_with_partners_and_assignments(spark, write, tmp_path):
    inputs = {
        "phenotypes": write("p.tsv.gz", [("a[1]", "x", "lethal, with q[2]", "r"), ("a[2]", "x", "viable", "r"),
                                         ("b[1]", "x", "lethal, with Gal4", "r"), ("c[1]", "x", "lethal", "r")]),
        "annotations": write("a.gaf.gz", [gaf("FB", g, "GO:2") for g in ("a", "b", "c")]),
        "ontology": write("o.obo.gz", [OBO]),
    }
    extra = {
        "driver_lines": write("d.tsv.gz", [("h", "h", "h"), ("1", "x", "Gal4")]),
        "assignments": write("s.tsv.gz", [("h",) * 5, ("a", "", "", "x", "melanogaster"), ("b", "", "", "x", "melanogaster")]),
    }
    jobs.build_matrix(spark, "fly", output=str(tmp_path / "w"), filter_with=True, **inputs, **extra)
    assert data(tmp_path / "w") == ["a,1,viable", "b,1,lethal"]
    jobs.build_matrix(spark, "fly", output=str(tmp_path / "n"), **inputs, **extra)
    assert data(tmp_path / "n") == ["a,1,lethal", "b,1,lethal"]
    with pytest.raises(ValueError, match="assignments"):
        jobs.build_matrix(spark, "fly", output=str(tmp_path / "z"), **inputs)


@pytest.mark.parametrize("species", ["fish", "worm", "mouse"])
def test_other_species(spark, write, tmp_path, species):
    rows = {
        "fish": [("x", "g", *["x"] * 8, "dead"), ("x", "h", *["x"] * 8, "alive")],
        "worm": [("x", "x", "g", "", "T:1"), ("x", "x", "h", "NOT", "T:1")],
        "mouse": [("x", "x", "x", "T:1", "x", "g-id"), ("x", "x", "x", "T:2", "x", "h-id")],
    }[species]
    db = {"fish": "ZFIN", "worm": "WB", "mouse": "MGI"}[species]
    jobs.build_matrix(
        spark,
        species,
        write("p.tsv.gz", rows),
        write("a.gaf.gz", [gaf(db, "g", "GO:2"), gaf(db, "h", "GO:3")]),
        write("o.obo.gz", [OBO]),
        str(tmp_path / "out"),
        lethal_terms=None if species == "fish" else write("t.tsv.gz", [("ID", "Name"), ("T:1", "n")]),
    )
    suffix = "-id" if species == "mouse" else ""
    assert data(tmp_path / "out") == [f"g{suffix},1,0,lethal", f"h{suffix},0,1,viable"]


def test_diff_job(spark, write, tmp_path):
    head = ["@attribute gene string", "@attribute GO:1 {0,1}", "@attribute class {x}", "@data"]
    a, b = write("a.arff", [*head, "g,1,lethal", "h,0,viable"]), write("b.arff", [*head, "g,0,viable"])
    counts = jobs.diff_matrices(spark, a, b, str(tmp_path / "diff"))
    lines = written_lines(tmp_path / "diff")
    both = "g,lethal,viable,GO:1,LABEL_MISMATCH;GO_TERM_MISMATCH"
    assert lines == ["Gene,Label A,Label B,GO Terms Differ,Status", "h,viable,,,MISSING_IN_B", both, both]
    assert dict(tuples(counts))["MISSING_IN_B"] == 1


def test_summary_job(spark, write, tmp_path):
    path = write("f.tsv", ["#c", ("a[1]", "1", "lethal, with \"x\"", "r"), ("a[2]", "2", "viable", "r"), ("b", "3", "wing", "r")])
    jobs.summarise_alleles(spark, path, str(tmp_path / "raw"), str(tmp_path / "sum"))
    raw = written_lines(tmp_path / "raw")
    assert raw[0] == "gene,allele,context,phenotype,simple_pheno"
    assert 'a,a[1],"""x""","lethal, with ""x""",lethal' in raw and "b,b,,wing,other" in raw
    summary = {line for line in written_lines(tmp_path / "sum")}
    assert "b,False,False,no lethal/viable phenotypes found" in summary
    assert 'a,True,True,"sometimes lethal, sometimes viable (context-dependent)"' in summary


def test_expand_terms_job(spark, write, tmp_path):
    def stanza(i, *parents, name=True):
        return ["[Term]", f"id: WBPhenotype:{i:07d}", *([f"name: n{i}"] if name else []),
                *[f"is_a: WBPhenotype:{p:07d} ! p" for p in parents]]

    obo = write("wb.obo", ["format-version: 1.2", *stanza(1), *stanza(2, 1), *stanza(3, 2, 4), *stanza(4, name=False),
                           *stanza(5, 3), "is_obsolete: true", "[Typedef]", "id: WBPhenotype:0000009", "is_a: WBPhenotype:0000001"])
    roots = write("roots.txt", ["WBPhenotype:0000002 x", "WBPhenotype:0000004", "WBPhenotype:0000077"])
    counts = jobs.expand_terms(spark, roots, obo, str(tmp_path / "terms"))
    assert written_lines(tmp_path / "terms") == [
        "ID\tName", "WBPhenotype:0000002\tn2", "WBPhenotype:0000003\tn3", "WBPhenotype:0000004\t**NOT-FOUND**",
        "WBPhenotype:0000005\tn5", "WBPhenotype:0000077\t**NOT-FOUND**"]
    assert tuples(counts) == [
        ("*", 5), ("WBPhenotype:0000002", 2), ("WBPhenotype:0000004", 2), ("WBPhenotype:0000077", 0),
        ("edges parsed", 4), ("terms parsed", 5)]


def scratch_files(spark):
    from traitloom.scratch import shared_folder

    return {str(path) for path in Path(shared_folder(spark).removeprefix("file:")).rglob("job-*/*")}


def test_jobs_free_their_tables(spark, inputs, write, tmp_path):
    before = scratch_files(spark)
    counts = jobs.build_matrix(spark, "yeast", output=str(tmp_path / "out"), propagate=True, pair_file=True, **inputs)
    assert scratch_files(spark) == before and counts.count() > 0
    bad = write("bad.arff", ["no data"])
    with pytest.raises(Exception):
        jobs.diff_matrices(spark, bad, str(tmp_path / "missing.arff"), str(tmp_path / "diff"))
    assert scratch_files(spark) == before


def test_shared_pairs_give_the_same_matrix(spark, inputs, tmp_path):
    for name, options in (("one", {}), ("two", {"pair_file": True}), ("three", {"pair_file": True, "keep_obsolete": True})):
        jobs.build_matrix(spark, "yeast", output=str(tmp_path / name), propagate=True, **options, **inputs)
    one = written_lines(tmp_path / "one" / "matrix.arff")
    assert one == written_lines(tmp_path / "two" / "matrix.arff") == written_lines(tmp_path / "three" / "matrix.arff")
    assert set(written_lines(tmp_path / "two" / "pairs.tab")) <= set(written_lines(tmp_path / "three" / "pairs.tab"))


def test_command_line(spark, write, tmp_path, capsys):
    from traitloom.__main__ import main, parser

    head = ["@attribute gene string", "@attribute GO:1 {0,1}", "@attribute class {x}", "@data"]
    a, b = write("a.arff", [*head, "g,1,lethal"]), write("b.arff", [*head, "g,1,lethal"])
    main(["diff", "--a", a, "--b", b, "--output", str(tmp_path / "diff")])
    assert "EXACT_MATCH\t1" in capsys.readouterr().out
    options = parser().parse_args(["matrix", *"--species fly --phenotypes p --annotations a --ontology o --output x --propagate".split()])
    assert options.propagate and options.prune and options.mode == "errorifexists"


def test_gz_rows_are_dealt_out(spark, write):
    from traitloom.sources.lines import read_rows

    path = write("x.tsv.gz", [(str(i), "v") for i in range(100)])
    assert read_rows(spark, path).rdd.getNumPartitions() == 4


def test_ontology_attributes_job(spark, write, tmp_path):
    jobs.ontology_attributes(spark, write("o.obo.gz", [OBO]), str(tmp_path / "o"))
    assert written_lines(tmp_path / "o" / "attributes.txt") == [
        f"@attribute GO:{i} {{1,0}}" for i in range(1, 7)]
