"""Mixing sources to target weights as a min-cost flow.

Documents with the same set of sources form one pattern. Words flow from patterns
to the quotas of their sources; the first copy of a pattern's words is free, each
further one costs more. The flow is solved over patterns, never over documents,
and documents are then taken whole, in a seeded order, up to their pattern's flow.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitloom.llm.common import WORD
from traitloom.scratch import cut

BUCKET = 256  # documents in a bucket of the seeded order, about
MOST_BUCKETS = 2**16  # of one pattern, or of one size


def share_targets(sizes: dict[str | None, int], weights: dict[str | None, float], most: float = 3) -> dict:
    """Share the sum of all sizes by weight; no target is over ``most`` times its source's size.

    What a source can't take is shared again among the others. In the order of
    most * size / weight the sources that stop come first, so one pass finds them.
    """
    order = sorted(sizes, key=lambda s: (most * sizes[s] / weights[s], s is None, s or ""))
    left, weight = sum(sizes.values()), sum(weights[s] for s in sizes)
    targets = {}
    for at, source in enumerate(order):
        if most * sizes[source] >= left / weight * weights[source]:
            return targets | {s: float(left / weight * weights[s]) for s in order[at:]}
        targets[source] = float(most * sizes[source])
        left, weight = left - most * sizes[source], weight - weights[source]
    return targets
    return targets


def route(supply: dict[str, tuple[tuple, int]], quotas: dict, copies: int = 3) -> dict[str, dict]:
    """Min-cost flow from patterns to quotas: {pattern: {source: words}}.

    supply: {pattern: (its sources, its words)}. Costs stand on the arcs into the
    patterns only and grow with every copy, so that filling one copy's capacity after
    the other along shortest augmenting paths gives a flow of least cost.
    """
    flow: dict[str, dict] = {pattern: {} for pattern in supply}
    room = dict(quotas)
    members: dict = {}
    for pattern, (sources, _) in supply.items():
        for source in sources:
            members.setdefault(source, []).append(pattern)
    used = dict.fromkeys(supply, 0)
    for copy in range(1, copies + 1):
        for start, (_, words) in supply.items():
            while (free := copy * words - used[start]) > 0:
                # breadth first over patterns and the sources whose words could go elsewhere
                came: dict = {("p", start): None}
                queue, end = deque([("p", start)]), None
                while queue and end is None:
                    kind, node = at = queue.popleft()
                    if kind == "p":
                        following = [("s", source) for source in supply[node][0]]
                    elif room.get(node, 0) > 0:
                        end = at
                        continue
                    else:
                        following = [("p", p) for p in members[node] if flow[p].get(node, 0) > 0]
                    for step in following:
                        if step not in came:
                            came[step] = at
                            queue.append(step)
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                back = [flow[p][s] for (_, s), (_, p) in zip(path[1::2], path[2::2])]
                moved = min(free, room[end[1]], *back)
                for (_, pattern), (_, source) in zip(path[::2], path[1::2]):
                    flow[pattern][source] = flow[pattern].get(source, 0) + moved
                for (_, source), (_, pattern) in zip(path[1::2], path[2::2]):
                    flow[pattern][source] -= moved
                room[end[1]] -= moved
                used[start] += moved
    return flow


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def cyclic_weights(sources, weights=(1, 2, 3)) -> dict:
    """1, 2, 3, 1, ... for sources in the order of their code points, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {source: weights[i % len(weights)] for i, source in enumerate(ordered)}


def mix_sources(
    docs: DataFrame, sources: Column, size: Column, weigh=cyclic_weights, most: int = 3, seed: int = 7
) -> tuple[DataFrame, dict, dict]:
    """Decide how often each document is taken; also the sources' sizes and targets.

    ``sources`` is the array of a document's sources, in which a null is a source of
    its own. The result has the document itself in the struct ``row``, so that no
    column of its own can clash, and next to it size, pattern and ``copies``, 0 to
    ``most``. ``docs`` is read three times and must give the same rows each time. The
    driver gets one row for each pattern, so the patterns are bounded by the mixing
    table that names the sources, not by the documents.

    What a pattern lacks after as many whole copies as fit is taken in buckets of the
    seeded order until one does not fit. The rest is filled from the documents of that
    and all later buckets, the longest that fit first and those of one size in seeded
    order, so that in the end no document is left that would still fit.

    A document without words is taken at most as often as any other. Documents
    that repeat are taken each on its own. A document's place in the order is the md5 of
    the seed and its doc_id, or its hash if that is null; ties go by that hash.
    """
    pattern = F.to_json(F.struct(F.array_sort(F.array_distinct(sources)).alias("s")), {"ignoreNullFields": "false"})
    given = F.xxhash64(*[F.col(f"`{name}`") for name in docs.columns]).cast("string")
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), given))))
    rows = docs.select(
        F.struct("*").alias("row"), size.alias("size"), pattern.alias("pattern"),
        F.array_sort(F.array_distinct(sources)).alias("members"), place.alias("place"),
    )
    slim, _ = cut(rows.drop("row"), "mix-sizes")
    stats = slim.groupBy("pattern").agg(
        F.any_value("members"), F.sum("size"), F.count(F.lit(1))
    ).collect()
    supply = {name: (tuple(members), words) for name, members, words, _ in sorted(stats)}
    sizes: dict = {}
    for members, words in supply.values():
        for source in members:
            sizes[source] = sizes.get(source, 0) + words
    total = sum(words for _, words in supply.values())
    targets = share_targets(sizes, weigh(sizes), most) if total else dict.fromkeys(sizes, 0.0)
    flow = route(supply, {source: int(x + 0.5) for source, x in targets.items()}, most)
    plan = [
        (name, int(amount // words) if words else 0, int(amount % words) if words else 0, _buckets(count))
        for name, _, words, count in stats
        for amount in [sum(flow[name].values())]
    ]
    spark = docs.sparkSession
    # one row for each pattern, as collected above
    planned = F.broadcast(spark.createDataFrame(plan, "pattern string, whole int, rest bigint, buckets bigint"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.drop("members").join(planned, "pattern").withColumn("bucket", _nth_part("place", 1, F.col("buckets")))

    # the first bucket, in the seeded order, that does not fit any more
    upto = Window.partitionBy("pattern").orderBy("bucket")
    border = (
        dealt(slim).groupBy("pattern", "bucket", "rest").agg(F.sum("size").alias("words"))
        .withColumn("upto", F.sum("words").over(upto))
        .where(F.col("upto") > F.col("rest"))
        .groupBy("pattern").agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("left")), "bucket").alias("border"))
        .select("pattern", "border.*").collect()
    )
    borders = F.broadcast(spark.createDataFrame(border, "pattern string, border bigint, left bigint"))
    marks = F.broadcast(_fill(dealt(slim).join(borders, "pattern")))
    split = (
        dealt(rows).join(borders, "pattern", "left").join(marks, ["pattern", "size"], "left")
        .withColumn("nest", F.when(F.col("bucket") >= F.col("border"), _nth_part("place", 9, F.col("nests"))))
    )
    at_edge = F.coalesce(F.col("nest") == F.col("edge"), F.lit(False))
    # whole buckets and whole nests are taken or not; patterns whose rest is 0 end at their first bucket
    more = (F.col("bucket") < F.col("border")) | F.coalesce(F.col("nest") < F.col("edge"), F.lit(False))
    plain = split.where(~at_edge).select(
        "row", "size", "pattern", F.coalesce(F.col("whole") + more.cast("int"), F.lit(0)).alias("copies")
    )
    order = Window.partitionBy("pattern", "size").orderBy(F.substring("place", 9, 24), "hash")
    filled = (
        split.where(at_edge).withColumn("hash", F.xxhash64("row"))
        .withColumn("copies", F.col("whole") + (F.row_number().over(order) <= F.col("keep")).cast("int"))
        .select("row", "size", "pattern", "copies")
    )
    taken = plain.unionByName(filled).withColumn("copies", F.least("copies", F.lit(most)))
    return taken, sizes, targets


def _buckets(count):
    """How many buckets ``count`` documents are dealt to."""
    return min(-(-count // BUCKET), MOST_BUCKETS)


def _nth_part(place: str, start: int, parts: Column) -> Column:
    """Which of ``parts`` equal ranges the 8 digits from ``start`` of a place lie in."""
    high = F.conv(F.substring(place, start, 8), 16, 10).cast("bigint")
    return F.floor(high * parts / F.lit(2.0**32)).cast("bigint")


def _fill(split: DataFrame) -> DataFrame:
    """What fills the patterns' ``left``: rows (pattern, size, nests, edge, keep).

    Of the documents of a size, dealt to ``nests`` by their place, those below the nest
    ``edge`` are taken, and the first ``keep`` of that nest. One task of the plan sees the
    lengths of a pattern and their numbers, so at most as many as the longest text has words.
    The result has few rows: n different sizes take n * n / 2 words of the left at least.
    """
    rest = split.where(
        (F.col("bucket") >= F.col("border")) & F.col("size").between(1, F.col("left"))
    ).select("pattern", "size", "left", "place")

    def longest_first(lengths):
        lengths = lengths.sort_values("size", ascending=False)
        left, takes = int(lengths["left"].iloc[0]), []
        for size, many in zip(lengths["size"].tolist(), lengths["many"].tolist()):
            takes.append(min(many, left // size))
            left -= takes[-1] * size
        return lengths.assign(take=takes)[["pattern", "size", "many", "take"]]

    lengths = rest.groupBy("pattern", "size").agg(F.any_value("left").alias("left"), F.count(F.lit(1)).alias("many"))
    takes = (
        lengths.groupBy("pattern").applyInPandas(longest_first, "pattern string, size bigint, many bigint, take bigint")
        .where(F.col("take") > 0)
        .withColumn("nests", F.least(F.ceil(F.col("many") / BUCKET), F.lit(MOST_BUCKETS)).cast("bigint"))
    )
    takes, _ = cut(takes, "mix-lengths")
    upto = Window.partitionBy("pattern", "size").orderBy("nest")
    return (
        rest.join(F.broadcast(takes), ["pattern", "size"])
        .groupBy("pattern", "size", "nests", "take", _nth_part("place", 9, F.col("nests")).alias("nest"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(upto) - F.col("n"))
        .where((F.col("before") < F.col("take")) & (F.col("before") + F.col("n") >= F.col("take")))
        .select("pattern", "size", "nests", F.col("nest").alias("edge"), (F.col("take") - F.col("before")).alias("keep"))
    )
