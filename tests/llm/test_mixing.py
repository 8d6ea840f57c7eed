from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from llm_fixtures import TABLES, docs  # noqa: F401

from traitloom.llm.mixing import cyclic_weights, mix_sources, route, share_targets, word_count
from traitloom.llm.queries import op3_source_mix


def test_targets_stop_and_reshare():
    targets = share_targets({"a": 10, "b": 1000, "c": 990}, {"a": 1, "b": 1, "c": 2})
    assert targets["a"] == 30 and abs(sum(targets.values()) - 2000) < 1e-6
    assert abs(targets["c"] - 2 * targets["b"]) < 1e-6
    assert cyclic_weights([None, "b", "a", "c", "d"]) == {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}


def test_flow_avoids_repeats_by_rerouting():
    # the shared pattern must give way to a: only so nothing is repeated
    flow = route({"x": (("a", "b"), 10), "y": (("b",), 10)}, {"a": 10, "b": 10}, 3)
    assert flow["x"].get("a") == 10 and flow["y"]["b"] == 10
    # 30 words for b out of 10 + 10: the second copies are shared before a third is used
    flow = route({"x": (("b",), 10), "y": (("b", "a"), 10)}, {"b": 40}, 3)
    assert sum(flow["x"].values()) == 20 and sum(flow["y"].values()) == 20


def test_sources_come_near_their_targets(spark):
    rows = op3_source_mix(spark, TABLES).collect()
    taken, target = defaultdict(int), {}
    for row in rows:
        assert 0 <= row.taken <= 3 * row.size
        taken[row.target, row.source_size] += row.taken
        target[row.target, row.source_size] = row.target
    # what is missing is less than any document that could be taken once more
    key = lambda row: (row.target, row.source_size)
    fewest = {k: min(row.taken // row.size for row in rows if row.size and key(row) == k) for k in target}
    for row in rows:
        missing = target[key(row)] - taken[key(row)]
        assert -1 <= missing and (not row.size or row.taken // row.size > fewest[key(row)] or row.size > missing - 1)
    again = op3_source_mix(spark, TABLES).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_many_buckets(docs):
    rows = [(i, "w " * (1 + i % 40), "en", "ab"[i % 3 == 0]) for i in range(3000)]
    mixed, _, targets = mix_sources(docs(rows), F.array("source"), word_count(F.col("text")))
    taken = dict(mixed.groupBy("row.source").agg(F.sum(F.col("size") * F.col("copies"))).collect())
    assert mixed.count() == 3000
    assert all(abs(taken[s] - targets[s]) <= 2 for s in targets)


@pytest.mark.parametrize("seed", range(4))
def test_one_very_long_document(docs, seed):
    rows = [(0, "w " * 20_000, "en", "a")] + [(i, "w " * (9 + i % 3), "en", "a") for i in range(1, 2500)]
    rows += [(None, "v " * (3 + i % 50), "en", "b") for i in range(2600)]
    weigh = lambda sources: dict.fromkeys(sources, 1)
    data = docs(rows)
    mixed, _, targets = mix_sources(data, F.array("source"), word_count(F.col("text")), weigh, seed=seed)
    found = mixed.select("row.source", "size", "copies").collect()
    assert len(found) == len(rows)
    for source, target in targets.items():
        missing = target - sum(row.size * row.copies for row in found if row.source == source)
        least = min(row.copies for row in found if row.source == source)
        # no document is left that would still fit
        open_ = [row.size for row in found if row.source == source and row.copies == least]
        assert -1 <= missing <= min(open_)


def test_nulls_empty_repeats_and_clashing_columns(docs):
    rows = [(1, "a b", "en", None), (None, "a b c", "en", None), (2, None, "en", "x"), (3, "", "en", "y"), (3, "", "en", "y")]
    rows += [(4, "q r s t", "en", "x")] * 5
    data = docs(rows, extra=["size", "pattern", "copies", "bucket", "row"])
    mixed, sizes, _ = mix_sources(data, F.array("source"), word_count(F.col("text")))
    found = mixed.select("row.*", mixed["copies"].alias("n")).collect()
    assert len(found) == 10 and sizes == {None: 5, "x": 20, "y": 0}
    assert all(0 <= row.n <= 3 for row in found)
    empty, sizes, targets = mix_sources(docs([]), F.array("source"), word_count(F.col("text")))
    assert empty.count() == 0 and sizes == targets == {}


def test_overlapping_sources(docs):
    data = docs([(i, "w " * 10) for i in range(300)]).withColumn(
        "sources", F.when(F.col("doc_id") < 100, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    )
    mixed, sizes, targets = mix_sources(data, F.col("sources"), word_count(F.col("text")), lambda s: {"a": 1, "b": 1})
    assert sizes == {"a": 3000, "b": 2000} and mixed.count() == 300
    assert max(row.copies for row in mixed.collect()) <= 2
