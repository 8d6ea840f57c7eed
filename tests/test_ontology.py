from collections import defaultdict

import pytest
from conftest import tuples
from hypothesis import given, settings
from hypothesis import strategies as some

from traitloom.operators import ontology as on
from traitloom.operators.annotate import missing_terms, obsolete_terms, unknown_terms
from traitloom.sources.lines import read_lines
from traitloom.sources.obo import ids_in_text, read_stanzas, term_names, with_prefix

OBO = """format-version: 1.2
ontology: go

[Term]
id: GO:1
name: root

[Term]
id: GO:2
name: two: with colon
is_a: GO:1 ! root

[Term]
id: GO:3
is_a: GO:1
relationship: part_of GO:2

[Typedef]
id: part_of
is_a: GO:overlap

 [Term]
id: GO:4
name: four
alt_id: GO:40
is_a: GO:2 {source="x"} ! two
is_a: GO:3

[Term]
id: GO:5
is_a: GO:4
[Term]
id: GO:6
is_a: GO:1
is_obsolete: true

[Term]
id: GO:7
"""
EDGES = [("GO:1", "GO:2"), ("GO:1", "GO:3"), ("GO:2", "GO:4"), ("GO:2", "GO:40"),
         ("GO:3", "GO:4"), ("GO:3", "GO:40"), ("GO:4", "GO:5")]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(EDGES, "parent string, child string")


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
@pytest.mark.parametrize("name", ["o.obo", "o.obo.gz"])
def test_obo_edges(spark, write, name, ending):
    path = write(name, [OBO.replace("\n", ending)])
    stanzas = read_stanzas(spark, path)
    assert tuples(on.edges_of(stanzas)) == EDGES
    assert tuples(on.obsolete_of(stanzas)) == [("GO:6",)]
    assert dict(tuples(term_names(stanzas))) == {"GO:1": "root", "GO:2": "two: with colon", "GO:4": "four"}
    everything = on.edges_of(stanzas, alternate_ids=False, live_only=False)
    assert ("GO:1", "GO:6") in tuples(everything) and ("GO:2", "GO:40") not in tuples(everything)


def test_a_file_that_starts_with_a_stanza(spark, write):
    path = write("o.obo", ["[Term]", "id: GO:2", "is_a: GO:1"])
    assert tuples(on.edges_of(read_stanzas(spark, path))) == [("GO:1", "GO:2")]


def test_stanzas_survive_file_splits(spark, write):
    path = write("o.obo", [f"[Term]\nid: GO:{i}\nname: n{i}\nis_a: GO:{i // 2}\n" for i in range(1, 400)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        stanzas = read_stanzas(spark, path)
        assert stanzas.rdd.getNumPartitions() > 4
        assert tuples(on.edges_of(stanzas)) == sorted((f"GO:{i // 2}", f"GO:{i}") for i in range(1, 400))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ancestors_and_descendants(spark, graph):
    found = defaultdict(set)
    for term, ancestor in tuples(on.ancestors(graph)):
        found[term].add(ancestor)
    assert found["GO:5"] == {"GO:5", "GO:4", "GO:2", "GO:3", "GO:1"}
    assert found["GO:40"] == {"GO:40", "GO:2", "GO:3", "GO:1"}
    roots = spark.createDataFrame([("GO:4",), ("GO:2",), ("GO:9",)], "term string")
    pairs = on.descendants(graph, roots)
    assert tuples(pairs) == [("GO:2", "GO:4"), ("GO:2", "GO:40"), ("GO:2", "GO:5"), ("GO:4", "GO:5")]
    assert tuples(on.descendant_counts(pairs, roots)) == [("GO:2", 3), ("GO:4", 1), ("GO:9", 0)]
    assert tuples(on.with_descendants(pairs, roots)) == [
        ("GO:2",), ("GO:4",), ("GO:40",), ("GO:5",), ("GO:9",)]


def test_ancestors_of_seeds_only(spark, graph):
    seeds = spark.createDataFrame([("GO:3",), ("GO:1",), ("GO:7",)], "term string")
    assert tuples(on.ancestors(graph, seeds)) == [("GO:1", "GO:1"), ("GO:3", "GO:1"), ("GO:3", "GO:3")]


def brute_distances(edges, upward):
    step = defaultdict(set)
    for parent, child in edges:
        step[child if upward else parent].add(parent if upward else child)
    pairs = set()
    for start in list(step):
        level, seen, depth = {start}, set(), 0
        while level:
            depth += 1
            level = {n for t in level for n in step[t]} - seen
            seen |= level
            pairs |= {(start, t, depth) for t in level}
    return sorted(pairs)


@settings(max_examples=6, deadline=None)
@given(
    some.sets(some.tuples(some.integers(0, 9), some.integers(0, 9)), min_size=1, max_size=18),
    some.sampled_from([1, 2, 4]),
    some.booleans(),
)
def test_closure_matches_brute_force_also_on_cycles(spark, edges, stride, upward):
    graph = spark.createDataFrame(sorted(edges), "parent int, child int")
    assert tuples(on.closure(graph, upward=upward, stride=stride)) == brute_distances(edges, upward)


def test_closure_of_a_long_chain(spark):
    graph = spark.range(1, 31).selectExpr("id - 1 AS parent", "id AS child")
    pairs = on.closure(graph)
    assert pairs.count() == 30 * 31 // 2
    assert pairs.where("term - reached <> hops").count() == 0
    # closing the pairs again adds nothing
    again = on.closure(pairs.selectExpr("reached AS parent", "term AS child"))
    assert tuples(again, "term", "reached") == tuples(pairs, "term", "reached")


def test_closure_with_salted_hubs(spark, no_broadcast):
    """A hub with most of the edges on both sides, joined by shuffles only."""
    edges = {(f"t{i}", "hub") for i in range(20)} | {("hub", f"b{i}") for i in range(300)}
    graph = spark.createDataFrame(sorted(edges), "parent string, child string")
    assert tuples(on.closure(graph, stride=1)) == brute_distances(edges, True)
    assert tuples(on.closure(graph, stride=1, upward=False)) == brute_distances(edges, False)


def test_reachable_and_seeded_closure(spark, graph):
    """A cycle, a seed outside the graph, a null seed; both directions."""
    loop = graph.union(spark.createDataFrame([("GO:5", "GO:2"), ("Z1", "Z2")], graph.schema))
    edges = set(tuples(loop))
    for upward in (True, False):
        seeds = spark.createDataFrame([("GO:4",), ("none",), (None,)], "term string")
        want = {reached for seed, reached, _ in brute_distances(edges, upward) if seed == "GO:4"} | {"GO:4", "none"}
        assert {row[0] for row in on.reachable(loop, seeds, upward).collect()} == want
        assert tuples(on.closure(loop, seeds, upward)) == [x for x in brute_distances(edges, upward) if x[0] == "GO:4"]
    lower = {reached for seed, reached, _ in brute_distances(edges, False) if seed in ("GO:4", "Z1")}
    roots = spark.createDataFrame([("GO:4",), ("Z1",)], "term string")
    assert {row[0] for row in on.below(loop, roots).collect()} == lower


def test_adjacency_has_one_shape(spark, graph):
    rows = tuples(on.adjacency(graph).where("id IN ('GO:4', 'GO:1')"))
    assert rows == [("GO:1", "c", "GO:2"), ("GO:1", "c", "GO:3"), ("GO:4", "c", "GO:5"), ("GO:4", "p", "GO:2"), ("GO:4", "p", "GO:3")]


def test_vocabulary_and_attribute_lines(spark, graph):
    nodes = on.nodes_of(graph.union(spark.createDataFrame([("RO:1", "RO:2")], graph.schema)))
    vocab, size = on.vocabulary(nodes, nodes["term"].contains("GO"))
    assert size == 6
    assert tuples(vocab, "idx", "term") == list(enumerate(["GO:1", "GO:2", "GO:3", "GO:4", "GO:40", "GO:5"]))
    assert tuples(on.attribute_lines(vocab))[0] == ("@attribute GO:1 {1,0}",)


def test_term_checks(spark, graph):
    terms = spark.createDataFrame([("GO:5",), ("GO:6",), ("GO:7",), ("GO:7",)], "term string")
    nodes, obsolete = on.nodes_of(graph), spark.createDataFrame([("GO:6",), ("GO:2",)], "term string")
    assert tuples(unknown_terms(terms, nodes, obsolete)) == [("GO:7",)]
    assert tuples(obsolete_terms(terms, nodes, obsolete)) == [("GO:6",)]
    assert tuples(missing_terms(terms, nodes)) == [("GO:6",), ("GO:7",)]


def test_ids_in_text(spark, write):
    path = write("roots.txt", ["WBPhenotype:0000062    lethal", "x WBPhenotype:0000050WBPhenotype:0000062", "WBPhenotype:12"])
    ids = ids_in_text(read_lines(spark, path), "value", r"WBPhenotype:\d{7}")
    assert [row["id"] for row in ids.collect()] == ["WBPhenotype:0000050", "WBPhenotype:0000062"]


def test_named_terms_and_prefix(spark, write):
    path = write("wb.obo", ["[Term]", "id: WBPhenotype:1", "name: one", "[Term]", "id: XX:1", "name: other"])
    stanzas = with_prefix(read_stanzas(spark, path), "WBPhenotype:")
    terms = spark.createDataFrame([("WBPhenotype:2",), ("WBPhenotype:1",)], "term string")
    assert [tuple(row) for row in on.named_terms(terms, term_names(stanzas)).collect()] == [
        ("WBPhenotype:1", "one"), ("WBPhenotype:2", "**NOT-FOUND**")]
