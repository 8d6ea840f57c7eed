"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

The graph starts from exact neighbours within cells around pivots. In every round the
neighbours of a node, in both directions, meet at that node and are compared with each
other: a neighbour of a neighbour is likely a neighbour. Queries walk the graph: the best
nodes seen so far that were not expanded yet show their neighbours, until the best are
all expanded. What is found is measured again on the original vectors.

Inner products become cosines by one more component that gives all vectors the length
of the longest. Graph and search work on half-precision codes of these.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitloom.llm.common import arrow_rows, in_parts, map_rows
from traitloom.scratch import cut, cut_measured, scratch_path

_PARTS = 2**20


@dataclass(frozen=True)
class Settings:
    neighbours: int = 40  # of a node of the graph
    cell: int = 1000  # vectors in a cell, about
    most_pivots: int = 4096  # the sample that cells are made around
    cells_each: int = 4  # cells that a vector joins
    from_cell: int = 24  # neighbours that a vector takes from one cell
    settled: float = 0.25  # the graph is done when a round changes a smaller share of it
    beam: int = 320  # best nodes of a query that must all be expanded
    at_once: int = 64  # nodes that a query expands in a round
    spare: int = 2  # times the wanted neighbours that are measured again


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """Rows (id, vec): vectors that can take part, as doubles; one row for each id.

    Left out are null ids, null, empty and zero vectors, vectors with a null or non-finite
    component, and vectors of another length than most. Of rows with one id the one with the
    least vector stays.
    """
    vec = F.col(f"`{vector}`").cast("array<double>")
    whole = vectors.select(F.col(f"`{id_}`").cast("bigint").alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    sizes = whole.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").take(1)
    if sizes:
        whole = whole.where(F.size("vec") == sizes[0].size)
    return whole.groupBy("id").agg(F.min("vec").alias("vec"))


def matrix(codes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(codes), dtype="<f2").reshape(len(codes), -1).astype(np.float32) if codes else np.zeros((0, 1), np.float32)


def encoded(points: DataFrame) -> DataFrame:
    """Rows (id, code): vectors scaled to the longest, with the component that fills them up, in half precision."""
    longest = points.select(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 1.0

    def coded(batch: pa.RecordBatch) -> dict:
        many = batch.num_rows
        x = batch["vec"].flatten().to_numpy().reshape(many, -1) / np.sqrt(longest)
        rest = np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1, keepdims=True)))
        return {"id": batch["id"], "code": [row.tobytes() for row in np.hstack([x, rest]).astype("<f2")]}

    return map_rows(points, coded, "id bigint, code binary")


def best(scores: np.ndarray, many: int) -> np.ndarray:
    """Columns of the ``many`` best scores of each row."""
    if scores.shape[1] <= many:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    return np.argpartition(-scores, many - 1, axis=1)[:, :many]


def top_neighbours(edges: DataFrame, many: int) -> DataFrame:
    """Of rows (id, other, sim, fresh) the ``many`` best of each id; an edge that was there is not fresh."""
    once = edges.groupBy("id", "other").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other"))
    return once.withColumn("place", place).where(F.col("place") <= many).drop("place")


def first_graph(codes: DataFrame, pivots: np.ndarray, settings: Settings) -> DataFrame:
    """Exact neighbours within the cells of the nearest pivots; large cells are dealt into parts."""

    def placed(batch: pa.RecordBatch) -> dict:
        near = best(matrix(batch["code"].to_pylist()) @ pivots.T, settings.cells_each)
        rows = np.repeat(np.arange(len(near)), near.shape[1])
        return {"cell": near.ravel(), "id": batch["id"].to_numpy()[rows], "code": batch["code"].take(pa.array(rows))}

    in_cells = map_rows(codes, placed, "cell int, id bigint, code binary")
    # one row for each pivot, of which there are at most most_pivots
    sizes = dict(in_cells.groupBy("cell").count().collect())
    parts = F.lit([-(-sizes.get(cell, 1) // (2 * settings.cell)) for cell in range(len(pivots))])
    part = F.pmod(F.xxhash64("id"), F.get(parts, F.col("cell"))).cast("int")

    def compared(cell: pd.DataFrame) -> pd.DataFrame:
        ids, x = cell["id"].to_numpy(), matrix(list(cell["code"]))
        found = []
        for start in range(0, len(ids), 1024):
            scores = x[start : start + 1024] @ x.T
            own = np.arange(len(scores))
            scores[own, own + start] = -2
            near = best(scores, settings.from_cell + 1)
            sims = np.take_along_axis(scores, near, axis=1)
            rows = np.repeat(ids[start : start + 1024], near.shape[1])
            found.append(pd.DataFrame({"id": rows, "other": ids[near.ravel()], "sim": sims.ravel()}))
        edges = pd.concat(found)
        return edges[edges["id"] != edges["other"]]

    edges = in_cells.withColumn("part", part).groupBy("cell", "part").applyInPandas(
        compared, "id bigint, other bigint, sim float"
    )
    return top_neighbours(edges.withColumn("fresh", F.lit(1)), settings.neighbours)


def descend(graph: DataFrame, codes: DataFrame, settings: Settings) -> DataFrame:
    """One round: all neighbours of a node, in both directions, are compared with each other.

    Only pairs with a fresh edge are. Nodes that very many others have as a neighbour meet
    these in parts, so that no list is long; every one of them is in some part.
    """
    many = settings.neighbours
    outward = graph.select(F.col("id").alias("node"), F.col("other").alias("member"), "fresh")
    inward = graph.select(F.col("other").alias("node"), F.col("id").alias("member"), "fresh")
    hubs = (
        graph.groupBy(F.col("other").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 2 * many).select("node", F.ceil(F.col("n") / (2 * many)).cast("int").alias("parts"))
    )
    whole = F.coalesce("parts", F.lit(1))
    met = outward.join(hubs, "node", "left").select(
        "node", "member", "fresh", F.explode(F.sequence(F.lit(0), whole - 1)).alias("part")
    ).unionByName(
        inward.join(hubs, "node", "left").select(
            "node", "member", "fresh", F.pmod(F.xxhash64("member"), whole).cast("int").alias("part")
        )
    ).groupBy("node", "part", "member").agg(F.max("fresh").alias("fresh"))
    least = graph.groupBy("id").agg(
        F.when(F.count(F.lit(1)) >= many, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("least")
    )
    known = codes.join(least, "id", "left").select(
        F.col("id").alias("member"), F.coalesce("least", F.lit(-2.0).cast("float")).alias("least"), "code"
    )
    lists = met.join(known, "member").groupBy("node", "part").agg(
        F.collect_list(F.struct("member", "fresh", "least", "code")).alias("met")
    )

    def compared(batch: pa.RecordBatch) -> dict:
        met = batch["met"]
        ends = np.append(0, np.cumsum(pc.list_value_length(met).to_numpy()))
        flat = met.flatten()
        members, fresh, least = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        x = matrix(flat.field(3).to_pylist())
        out = ([], [], [])
        for a, b in zip(ends, ends[1:]):
            new = fresh[a:b] > 0
            if not new.any() or b - a < 2:
                continue
            scores = x[a:b] @ x[a:b].T
            scores[~new[:, None] & ~new[None, :]] = -3
            np.fill_diagonal(scores, -3)
            near = best(scores, many)
            sims = np.take_along_axis(scores, near, axis=1)
            row, column = np.nonzero(sims > least[a:b, None])
            for to, values in zip(out, (members[a:b][row], members[a:b][near[row, column]], sims[row, column])):
                to.append(values)
        ids, others, sims = (np.concatenate(values) if values else np.zeros(0) for values in out)
        return {"id": ids.astype(np.int64), "other": others.astype(np.int64), "sim": sims.astype(np.float32)}

    found = map_rows(lists.select("met"), in_parts(compared, 512), "id bigint, other bigint, sim float")
    old = graph.withColumn("fresh", F.lit(0))
    return top_neighbours(old.unionByName(found.withColumn("fresh", F.lit(1))), many)


def neighbour_graph(codes: DataFrame, rows: int, settings: Settings) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The written graph (id, other, sim, fresh), and the ids and codes of the pivots."""
    wanted = min(settings.most_pivots, -(-rows * settings.cells_each // settings.cell))
    sample = codes.where(F.pmod(F.xxhash64("id"), F.lit(_PARTS)) * rows < wanted * _PARTS).toArrow()
    if not len(sample):
        sample = codes.orderBy("id").limit(1).toArrow()
    pivots = matrix(sample["code"].to_pylist())
    graph, edges = cut(first_graph(codes, pivots, settings), "graph")
    changed = edges
    while edges and changed >= settings.settled * edges:
        graph, seen = cut_measured(descend(graph, codes, settings), "graph", changed=F.sum("fresh"))
        edges, changed = seen["rows"], seen["changed"]
    return graph, sample["id"].to_numpy(), pivots


def walk(
    queries: DataFrame, graph: DataFrame, codes: DataFrame, pivot_ids: np.ndarray, pivots: np.ndarray, settings: Settings
) -> DataFrame:
    """Rows (id, ids): what a greedy search finds for each query (id, code), the nearest first.

    A query starts from its own place in the graph, if it is in it, and from the nearest
    pivots. The graph is written in buckets with its codes, so that each round only moves
    the nodes to be expanded.
    """
    spark = queries.sparkSession
    name = f"graph_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = (
        graph.join(codes.withColumnRenamed("id", "other"), "other").groupBy("id")
        .agg(F.collect_list("other").alias("others"), F.collect_list("code").alias("codes"))
    )
    lists.repartition(buckets, "id").write.bucketBy(buckets, "id").option("path", scratch_path(spark, "lists")).saveAsTable(name)

    def started(batch: pa.RecordBatch) -> dict:
        scores = matrix(batch["code"].to_pylist()) @ pivots.T
        near = best(scores, 16)
        sims = np.take_along_axis(scores, near, axis=1)
        return {
            "id": batch["id"], "code": batch["code"],
            "found": [list(map(dict, zip([("other", i) for i in ids], [("sim", s) for s in own])))
                      for ids, own in zip(pivot_ids[near].tolist(), sims.tolist())],
        }

    pool = "ids array<bigint>, sims array<float>, done array<boolean>"
    none = "array<struct<other:bigint,sim:float>>"
    begin = map_rows(queries, started, f"id bigint, code binary, found {none}")
    own = F.array(F.struct(F.col("id").alias("other"), F.lit(2.0).cast("float").alias("sim")))
    state = begin.select(
        "id", "code", F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<float>").alias("sims"),
        F.array().cast("array<boolean>").alias("done"), F.concat("found", own).alias("found"),
    )

    def merged(batch: pa.RecordBatch) -> dict:
        out = {"id": batch["id"], "code": batch["code"], "ids": [], "sims": [], "done": []}
        columns = [batch[name].to_pylist() for name in ("id", "ids", "sims", "done", "found")]
        for query, ids, sims, done, found in zip(*columns):
            ids, sims, done = np.array(ids, dtype=np.int64), np.array(sims), np.array(done, dtype=bool)
            done[np.nonzero(~done)[0][: settings.at_once]] = True  # they have just been expanded
            new = {x["other"]: x["sim"] for x in found or ()}
            new.update({query: 2.0} if query in new else {})  # before all others
            for known in ids.tolist():
                new.pop(known, None)
            ids = np.append(ids, np.array(list(new), dtype=np.int64))
            sims = np.append(sims, np.array(list(new.values())))
            done = np.append(done, np.zeros(len(new), dtype=bool))
            order = np.lexsort((ids, -sims))[: settings.beam]
            for to, values in zip(("ids", "sims", "done"), (ids, sims, done)):
                out[to].append(values[order])
        return out

    left = F.sum(F.size(F.filter("done", lambda x: ~x)))
    merge = f"id bigint, code binary, {pool}"
    state, seen = cut_measured(map_rows(state, in_parts(merged, 64), merge), "walk", left=left)

    def shown(batch: pa.RecordBatch) -> dict:
        ids, others, scores = [], [], []
        columns = [batch[name].to_pylist() for name in ("query", "code", "least", "others", "codes")]
        for query, code, least, near, codes in zip(*columns):
            sims = matrix(codes) @ matrix([code])[0]
            good = np.nonzero(sims > least)[0]
            ids += [query] * len(good)
            others += [near[i] for i in good]
            scores += sims[good].tolist()
        return {"id": ids, "other": others, "sim": scores}

    while seen["left"]:
        place = F.transform("ids", lambda x, i: F.struct(x.alias("node"), F.get("done", i).alias("done")))
        asked = F.slice(F.filter(place, lambda x: ~x["done"]), 1, settings.at_once)
        least = F.when(F.size("sims") >= settings.beam, F.array_min("sims")).otherwise(F.lit(-2.0)).cast("float")
        front = state.select(F.col("id").alias("query"), "code", least.alias("least"), F.explode(asked).alias("x"))
        opened = front.withColumn("node", F.col("x.node")).join(spark.table(name), F.col("node") == F.col("id"))
        found = map_rows(
            opened.select("query", "code", "least", "others", "codes"), in_parts(shown, 512), "id bigint, other bigint, sim float"
        )
        found = found.groupBy("id").agg(F.collect_list(F.struct("other", "sim")).alias("found"))
        state, seen = cut_measured(map_rows(state.join(found, "id", "left"), in_parts(merged, 64), merge), "walk", left=left)
    spark.sql(f"DROP TABLE {name}")
    return state.select("id", F.filter("ids", lambda x: x != F.col("id")).alias("ids"))


def nearest_neighbours(
    vectors: DataFrame, asks: Column, wanted: int = 20, id_: str = "vec_id", vector: str = "embedding",
    settings: Settings = Settings(),
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``wanted`` nearest found of each query, itself left out.

    ``asks`` is a condition on ``id``. score is the inner product of the original vectors in
    double precision; ties go to the smaller id. What ``usable`` leaves out takes no part.
    """
    points, rows = cut(usable(vectors, id_, vector), "points")
    # a row of the graph holds the codes of all its neighbours
    with arrow_rows(vectors.sparkSession, 512):
        codes, _ = cut(encoded(points), "codes")
        graph, pivot_ids, pivots = neighbour_graph(codes, rows, settings)
        # without the component that fills it up, a query's cosines are inner products
        plain = F.concat(F.expr("substring(code, 1, length(code) - 2)"), F.lit(bytes(2)))
        found = walk(codes.where(asks).select("id", plain.alias("code")), graph, codes, pivot_ids, pivots, settings)
    pairs = found.select(
        F.col("id").alias("query_id"), F.explode(F.slice("ids", 1, settings.spare * wanted)).alias("vec_id")
    )
    left = points.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    right = points.select(F.col("id").alias("vec_id"), "vec")
    product = F.aggregate(F.zip_with("query_vec", "vec", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        pairs.join(left, "query_id").join(right, "vec_id").select("query_id", "vec_id", product.alias("score"))
        .withColumn("rank", place).where(F.col("rank") <= wanted).select("query_id", "rank", "vec_id", "score")
    )
