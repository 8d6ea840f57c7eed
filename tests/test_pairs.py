"""The file of gene-term pairs: lists of a gene's terms, written compressed and in waves."""

import gzip
from pathlib import Path

import pytest
from conftest import TABLES, tuples
from pyspark.sql import functions as F

from traitloom.operators import matrix as mx
from traitloom.queries import registry
from traitloom.sinks import files

LISTS = "gene string, terms array<string>, label int"


def gzipped_lines(folder):
    parts = sorted(Path(folder).glob("part-*"))
    assert all(part.name.endswith(".txt.gz") for part in parts)
    return sorted(line for part in parts for line in gzip.decompress(part.read_bytes()).decode().splitlines())


@pytest.fixture
def lists(spark):
    rows = [(f"g{i}", [f"GO:{i}", f"GO:{i + 1}"], i % 2) for i in range(40)]
    odd = [("none", [], 1), (None, ["GO:1", "GO:2"], 0), ("one", ["GO:7"], 1), ("g3", ["GO:9"], 1), ("g3", ["GO:9"], 1)]
    return spark.createDataFrame(rows + odd, LISTS)


def test_a_list_is_written_as_the_lines_of_its_pairs(spark, lists):
    pairs = lists.select("gene", F.explode("terms").alias("term"), "label")
    expected = sorted(row["line"] for row in files.pair_lines(pairs).collect())
    texts = [row["line"] for row in files.pair_lines(lists).collect()]
    assert sorted(line for text in texts for line in text.split("\n")) == expected
    assert len(texts) == 44 and "GO:1\t0\nGO:2\t0" in texts


@pytest.mark.parametrize("waves", [1, 3])
def test_waves_write_every_line_once(lists, tmp_path, monkeypatch, waves):
    freed, seen = [], []
    path = tmp_path / "pairs"
    monkeypatch.setattr(files, "free_shuffles", lambda _: (freed.append(1), seen.append((path / "_SUCCESS").exists())))
    files.write_pairs(lists, str(path), compression="gzip", waves=waves)
    pairs = lists.select("gene", F.explode("terms").alias("term"), "label")
    assert gzipped_lines(path) == sorted(row["line"] for row in files.pair_lines(pairs).collect())
    # each wave's shuffles are freed before the next, and only the last says that the folder is whole
    assert len(freed) == (waves if waves > 1 else 0) and not any(seen[:-1]) and (path / "_SUCCESS").exists()
    with pytest.raises(Exception, match="(?i)already exists"):
        files.write_pairs(lists, str(path), compression="gzip", waves=waves)


def test_names_are_not_a_column_of_the_lists(spark):
    annotated = spark.createDataFrame([("g", "lethal", "GO:1")], "gene string, status string, term string")
    closure = spark.createDataFrame([("GO:1", "GO:1")], "term string, ancestor string")
    for found in (mx.term_lists(annotated, closure, "GO"), mx.term_pairs(annotated, closure, "GO")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        # looked up where the terms are named: as a column the whole array would be copied into each row
        assert "lambdafunction(scalar-subquery#" in plan


def test_waves_do_not_add_to_an_ignored_folder(lists, tmp_path):
    with pytest.raises(ValueError, match="later waves"):
        files.write_pairs(lists, str(tmp_path / "pairs"), mode="ignore", waves=2)


def test_the_query_writes_compressed_and_in_waves(spark, monkeypatch):
    shares = []
    monkeypatch.setattr(registry, "_WAVE", 500)
    monkeypatch.setattr(files, "free_shuffles", lambda _: shares.append(1))
    written = registry.QUERIES["file_pairs"](spark, TABLES)
    assert all(path.endswith(".txt.gz") for path in written.inputFiles()) and len(shares) > 1
    labelled = registry.QUERIES["gene_term_label"](spark, TABLES)
    assert tuples(written) == tuples(files.pair_lines(labelled))


@pytest.mark.parametrize("shared, together", [(2**16, 2**20), (2, 2**20), (2, 7)])
def test_lists_hold_each_inherited_term_once(spark, monkeypatch, shared, together):
    monkeypatch.setattr(mx, "_SHARED", shared)
    monkeypatch.setattr(mx, "_TOGETHER", together)
    above = {i: {i // 2**k for k in range(5)} for i in range(16)}
    closure = [(f"GO:{i}", f"GO:{a}") for i in above for a in above[i]] + [("GO:5", None)] * 3 + [("GO:6", None)] * 30
    direct = [("a", "lethal", i) for i in (5, 6, 15)] + [("b", "viable", 6), (None, "viable", 2), ("c", None, 1), ("d", "lethal", 99)]
    annotated = spark.createDataFrame([(g, s, f"GO:{i}") for g, s, i in direct], "gene string, status string, term string")
    found = mx.term_lists(annotated, spark.createDataFrame(closure, "term string, ancestor string"), "GO").collect()
    met = [(row["gene"], row["status"], term) for row in found for term in row["terms"]]
    assert len(met) == len(set(met))
    assert set(met) == {(g, s, f"GO:{a}") for g, s, i in direct if i in above for a in above[i]}
