import numpy as np
from llm_fixtures import TABLES
from pyspark.sql import functions as F

from traitloom.llm.neighbours import Settings, nearest_neighbours
from traitloom.llm.queries import op5_nn_descent

SMALL = Settings(neighbours=20, cell=100, cells_each=2, from_cell=12, beam=200, at_once=40)


def brute(ids, vectors, queries, wanted=20):
    want = {}
    for i in queries:
        scores = vectors @ vectors[i]
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:wanted]
        want[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in order]
    return want


def recall(found, want):
    got = {}
    for row in found:
        got.setdefault(row.query_id, {})[row.rank] = (row.vec_id, row.score)
    hits = total = 0
    assert got.keys() == want.keys()
    for query, near in want.items():
        assert sorted(got[query]) == list(range(1, len(near) + 1))
        assert [got[query][r] for r in sorted(got[query])] == sorted(got[query].values(), key=lambda x: (-x[1], x[0]))
        hits += len({v for v, _ in near} & {v for v, _ in got[query].values()})
        total += len(near)
    return hits / total


def test_whole_table(spark):
    rows = spark.read.parquet(f"{TABLES}/embeddings.parquet").collect()
    ids = np.array([row.vec_id for row in rows])
    vectors = np.array([row.embedding for row in rows], dtype=float)
    want = brute(ids, vectors, np.nonzero(ids % 20 == 0)[0])
    assert recall(op5_nn_descent(spark, TABLES).collect(), want) >= 0.95


def test_graph_of_many_cells_and_lengths(spark):
    """Vectors of different lengths, a dense group of near copies, and a graph that must be walked."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(900, 8)) * rng.uniform(0.9, 1.1, size=(900, 1))
    vectors[:200] = vectors[0] + 0.01 * rng.normal(size=(200, 8))
    rows = [(i, list(map(float, v))) for i, v in enumerate(vectors)]
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = nearest_neighbours(data, F.col("id") % 10 == 0, 5, settings=SMALL).collect()
    assert recall(found, brute(np.arange(900), vectors, range(0, 900, 10), 5)) >= 0.9


def test_left_out_rows_few_rows_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]),
            (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (None, [1.0, 0.0]), (7, []), (8, [1.0, 2.0, 3.0])]
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS id", "'x' AS rank", "2 AS score")
    found = sorted(map(tuple, nearest_neighbours(data, F.col("id") % 20 == 0).collect()))
    assert found == [(0, 1, 1, 1.0), (0, 2, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 0, 0.0)]
    assert nearest_neighbours(data.limit(0), F.col("id") % 20 == 0).count() == 0
    assert nearest_neighbours(data.where("vec_id = 0"), F.col("id") % 20 == 0).count() == 0
