import numpy as np
import xxhash
from pyspark.sql import functions as F

from llm_fixtures import TABLES, docs  # noqa: F401

from traitloom.llm.simhash import HALVES, components, fingerprint, grow, joined, linked_pairs, route, simhash_components


def naive_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(prints, links=3):
    """{id: smallest linked id} over [(id, fingerprint)], all pairs."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in prints:
        for j, b in prints:
            if j < i and (a ^ b).bit_count() <= links:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in prints}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    prints = [(row.doc_id, naive_fingerprint(row.text)) for row in docs.collect()]
    want = naive_components(prints)
    found = simhash_components(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {
        i: (f"{fp:016x}", want[i]) for i, fp in prints
    }


def test_long_text_in_blocks():
    text = " ".join(f"w{i * i % 1013}" for i in range(40_000))
    assert fingerprint(text) == naive_fingerprint(text)


def near_points(seed, many):
    """Random fingerprints, chains of near ones, and a set that shares one half."""
    rng = np.random.default_rng(seed)
    points = list(rng.integers(0, 2**64, many, dtype=np.uint64))
    for _ in range(many):
        flips = np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
        points.append(points[rng.integers(len(points))] ^ flips)
    points += list(points[0] ^ (rng.integers(0, 2**32, many, dtype=np.uint64) << np.uint64(32)))
    return np.unique(np.array(points, dtype=np.uint64))


def test_trees_lose_no_link():
    points = near_points(1, 500)
    want = naive_components(list(enumerate(map(int, points))))
    parent = np.arange(len(points))
    for own, other in HALVES:
        shards = []
        parts = route(points, grow(points, own, other, 3, 16, shards))
        assert len(shards) > 20 and max(len(rows) for _, rows in parts) < len(points) / 3
        for _, rows in parts:
            local = joined(points[rows], 3)
            for at, first in enumerate(local):
                x, y = rows[at], rows[first]
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return int(i)

    assert {i: find(i) for i in range(len(points))} == want
    assert {i: int(x) for i, x in enumerate(joined(points, 3, leaf=32))} == want


def test_distributed_links_and_components(spark):
    points = near_points(2, 300)
    want = naive_components(list(enumerate(map(int, points))))
    nodes = spark.createDataFrame([(i, int(p)) for i, p in enumerate(points.view(np.int64))], "id bigint, fp bigint")
    pairs = linked_pairs(nodes, leaf=16, sample=200)
    found = dict(components(pairs).collect())
    assert {i: found.get(i, i) for i in want} == want


def test_chain_and_hot_star(spark, no_broadcast):
    chain = [(i + 1, i) for i in range(60)] + [(1000 + i, 999) for i in range(500)]
    found = dict(components(spark.createDataFrame(chain, "a bigint, b bigint")).collect())
    assert found == {i: 0 for i in range(1, 61)} | {1000 + i: 999 for i in range(500)}


def test_nulls_empty_repeats_and_clashing_columns(docs):
    rows = [(5, None), (6, ""), (None, "x y z q"), (7, "X y z q"), (7, "x y z q"), (None, "other words entirely here")]
    found = simhash_components(docs(rows, extra=["fp", "component_id", "id"])).collect()
    assert len(found) == 6
    by_id = {(r.doc_id, r.component_id) for r in found}
    assert by_id == {(5, 5), (6, 5), (None, 7), (7, 7), (None, None)}
    assert simhash_components(docs([])).count() == 0
