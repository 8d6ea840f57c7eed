"""Edges, vocabulary and closures of a term graph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.operators.bitmaps import bit_of, carried, named, places, word_of
from traitloom.operators.ordering import dense_index
from traitloom.operators.skew import spread_join
from traitloom.scratch import cut, cut_measured


def edges_of(
    stanzas: DataFrame, alternate_ids: bool = True, live_only: bool = True
) -> DataFrame:
    """Distinct ``(parent, child)`` from the ``is_a`` lines.

    An alternate id becomes a child of its term's parents, not of the term.
    """
    if live_only:
        stanzas = stanzas.where(~F.col("is_obsolete"))
    children = F.array("id")
    if alternate_ids:
        children = F.concat(children, F.coalesce("alt_id", F.array().cast("array<string>")))
    return (
        stanzas.select(F.explode("is_a").alias("parent"), children.alias("children"))
        .select("parent", F.explode("children").alias("child"))
        .distinct()
    )


def obsolete_of(stanzas: DataFrame) -> DataFrame:
    return stanzas.where(F.col("is_obsolete")).select(F.col("id").alias("term")).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    """Every term that is an endpoint of an edge."""
    return edges.select(F.explode(F.array("parent", "child")).alias("term")).distinct()


def vocabulary(nodes: DataFrame, keep: Column | None = None) -> tuple[DataFrame, int]:
    """``(term, idx)`` in the order of the terms, and the number of terms."""
    terms = nodes if keep is None else nodes.where(keep)
    return dense_index(terms, ["term"], "idx")


def union_vocabulary(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("term").union(b.select("term")).distinct()


def attribute_lines(vocab: DataFrame) -> DataFrame:
    return vocab.select(F.concat(F.lit("@attribute "), "term", F.lit(" {1,0}")).alias("line"))


def adjacency(edges: DataFrame) -> DataFrame:
    """``(id, side, other)``: one row for each parent (side ``p``) and child (``c``) of a term.

    A term with very many neighbours makes many rows of the same shape, not a long one.
    """
    sides = F.array(
        F.struct(F.col("child").alias("id"), F.lit("p").alias("side"), F.col("parent").alias("other")),
        F.struct(F.col("parent").alias("id"), F.lit("c").alias("side"), F.col("child").alias("other")),
    )
    return edges.select(F.inline(sides))


def _strides(steps: DataFrame, stride: int) -> tuple[DataFrame, int]:
    """``(at, next, hops)`` for everything within ``stride`` steps, by doubling."""
    reach, _ = cut(steps.withColumn("hops", F.lit(1)), "steps")
    width = 1
    while width < stride:
        onward = reach.select(
            F.col("at").alias("via"), F.col("next").alias("far"), F.col("hops").alias("more")
        )
        longer = spread_join(
            reach.withColumnRenamed("next", "via"),
            onward,
            "via",
            salt_by=["at"],
            few_salt_by=["far"],
            settled=True,
        ).select("at", F.col("far").alias("next"), (F.col("hops") + F.col("more")).alias("hops"))
        reach, _ = cut(
            reach.unionByName(longer).groupBy("at", "next").agg(F.min("hops").alias("hops")),
            "strides",
        )
        width *= 2
    return reach, width


def _steps(edges: DataFrame, upward: bool) -> DataFrame:
    here, there = ("child", "parent") if upward else ("parent", "child")
    return (
        edges.select(F.col(here).alias("at"), F.col(there).alias("next"))
        .where(F.col("at").isNotNull() & F.col("next").isNotNull())
        .distinct()
    )


def reachable(edges: DataFrame, seeds: DataFrame, upward: bool = True, stride: int = 4) -> DataFrame:
    """The seeds and every term that an edge path from one of them leads to.

    Only terms are followed, not pairs; a round goes ``stride`` steps on from the terms
    that the round before found first.
    """
    steps, _ = cut(_steps(edges, upward), "steps")
    frontier, found = cut(seeds.select("term").where(F.col("term").isNotNull()).distinct(), "reached")
    known = [frontier]
    while found:
        level, levels = frontier, []
        for _ in range(stride):
            level = level.join(steps, F.col("term") == F.col("at")).select(F.col("next").alias("term")).distinct()
            levels.append(level)
        seen = reduce(DataFrame.unionByName, known)
        fresh = reduce(DataFrame.unionByName, levels).distinct().join(seen, "term", "left_anti")
        frontier, found = cut(fresh, "reached")
        known.append(frontier)
    return reduce(DataFrame.unionByName, known)


def closure(
    edges: DataFrame,
    seeds: DataFrame | None = None,
    upward: bool = True,
    stride: int = 4,
) -> DataFrame:
    """``(term, reached, hops)``: terms reached from each seed, with the distance.

    ``seeds`` has a column ``term``; without it every term is a seed. A seed
    itself appears only where a cycle leads back to it.

    Breadth first over the edges, ``stride`` levels per round: each round joins
    the pairs found at the last level with the stride table and keeps the pairs
    not found before. Every round is written to the shared folder, so the plan
    of a round never holds the ones before it. With seeds, edges that none of them
    leads to are left out first.
    """
    steps = _steps(edges, upward)
    if seeds is not None:
        steps, _ = cut(steps, "steps")
        reached = reachable(edges, seeds, upward).withColumnRenamed("term", "at")
        steps = spread_join(steps, reached, "at", "left_semi", ["next"], settled=True)
    onward, width = _strides(steps, stride)
    hop = onward.select(
        F.col("at").alias("reached"), F.col("next").alias("far"), F.col("hops").alias("more")
    )
    start = onward.select(F.col("at").alias("term"), F.col("next").alias("reached"), "hops")
    if seeds is not None:
        wanted = seeds.select("term").distinct()
        start, _ = cut(spread_join(start, wanted, "term", "left_semi", ["reached"], settled=True), "closure")
    rounds = [start]
    depth = 0
    while True:
        depth += width
        # a pair found before the last level of its round had its steps taken there
        frontier = rounds[-1].where(F.col("hops") == depth)
        candidates = spread_join(
            frontier, hop, "reached", salt_by=["term"], few_salt_by=["far"], settled=True
        ).select("term", F.col("far").alias("reached"), (F.col("hops") + F.col("more")).alias("hops"))
        # pairs of earlier rounds are at most ``depth`` away, so the smallest
        # distance tells the new ones apart without a join
        fresh, measured = cut_measured(
            reduce(DataFrame.unionByName, rounds, candidates)
            .groupBy("term", "reached")
            .agg(F.min("hops").alias("hops"))
            .where(F.col("hops") > depth),
            "closure",
            deepest=F.max("hops"),
        )
        if measured["rows"]:
            rounds.append(fresh)
        if not measured["rows"] or measured["deepest"] < depth + width:
            return reduce(DataFrame.unionByName, rounds)


@dataclass(frozen=True)
class Reached:
    """Terms and which of the sources lead to them, as bitmaps over the numbers of the sources."""

    marks: DataFrame  # at, word, bits
    sources: DataFrame  # source, place

    @property
    def terms(self) -> DataFrame:
        """``term``: everything that some source leads to."""
        return self.marks.select(F.col("at").alias("term")).distinct()


def reached_from(edges: DataFrame, seeds: DataFrame, upward: bool, stride: int = 8) -> Reached:
    """What the distinct seeds (term) lead to over one edge or more; a seed itself through a cycle only.

    A seed's bit travels over the edges, so that nothing else is touched and no pairs are made.
    """
    steps, _ = cut(_steps(edges, upward), "steps")
    wanted = seeds.select(F.col("term").alias("source")).where(F.col("source").isNotNull()).distinct()
    sources, _ = dense_index(wanted, ["source"], "place")
    start = sources.select(F.col("source").alias("at"), word_of("place").alias("word"), bit_of("place").alias("bits"))
    return Reached(carried(steps, start, stride), sources)


def ancestors(edges: DataFrame, seeds: DataFrame | None = None, **options) -> DataFrame:
    """``(term, ancestor)`` of each node among the seeds, the term itself included."""
    nodes = nodes_of(edges)
    if seeds is not None:
        nodes = nodes.join(seeds.select("term").distinct(), "term", "left_semi")
    nodes, _ = cut(nodes, "nodes")
    found = reached_from(edges, nodes, upward=True, **options)
    pairs = named(found.marks, found.sources, "source", "place", settled=True)
    return (
        pairs.where(F.col("source") != F.col("at"))
        .select(F.col("source").alias("term"), F.col("at").alias("ancestor"))
        .unionByName(nodes.select("term", F.col("term").alias("ancestor")))
    )


def descendants(edges: DataFrame, roots: DataFrame, **options) -> DataFrame:
    """``(root, term)``: what each root leads down to; a root only through a cycle."""
    found = reached_from(edges, roots, upward=False, **options)
    return named(found.marks, found.sources, "source", "place", settled=True).select(
        F.col("source").alias("root"), F.col("at").alias("term")
    )


def counts_below(found: Reached, roots: DataFrame) -> DataFrame:
    """``(root, descendants)`` for every root, 0 for those without any, counted from the bitmaps."""
    counts = places(found.marks).groupBy("place").agg(F.count(F.lit(1)).alias("descendants"))
    known = found.sources.join(counts, "place").select(F.col("source").alias("root"), "descendants")
    return (
        roots.select(F.col("term").alias("root"))
        .distinct()
        .join(known, "root", "left")
        .select("root", F.coalesce("descendants", F.lit(0)).alias("descendants"))
    )


def below(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``term``: what any of the roots leads down to; a root only if an edge leads to it from there."""
    reached = reachable(edges, roots, upward=False)
    lower = edges.join(reached.select(F.col("term").alias("parent")), "parent", "left_semi")
    return lower.select(F.col("child").alias("term")).where(F.col("term").isNotNull()).distinct()


def with_descendants(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots and everything below any of them, as distinct terms."""
    return roots.select("term").union(pairs.select("term")).distinct()


def descendant_counts(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``(root, descendants)`` for every root, 0 for those without any."""
    counts = pairs.groupBy("root").agg(F.count(F.lit(1)).alias("descendants"))
    return (
        roots.select(F.col("term").alias("root"))
        .distinct()
        .join(counts, "root", "left")
        .select("root", F.coalesce("descendants", F.lit(0)).alias("descendants"))
    )


def named_terms(terms: DataFrame, names: DataFrame) -> DataFrame:
    """``(ID, Name)`` sorted by id, with a marker where no name is known."""
    return (
        terms.join(names, "term", "left")
        .select(
            F.col("term").alias("ID"), F.coalesce("name", F.lit("**NOT-FOUND**")).alias("Name")
        )
        .orderBy("ID")
    )
