"""SimHash near-duplicates found with vantage-point trees.

Distinct fingerprints are dealt over shards by vantage-point trees. A node measures
the Hamming distance to its vantage point and sends near fingerprints inside, far
ones outside. By the triangle inequality two linked fingerprints can only part at a
node if both lie close to its border, so that those just outside also enter the inside:
every linked pair then meets in some shard, and only shards are compared.

Whole fingerprints of unlike texts are all about 32 bits apart, so that most of
them would lie near a border. A pair with at most three different bits has a half with at
most one, and halves give borders of width one. There is one tree for each half: on
its own half a node's border is as wide as a pair may differ there, and where a half
can't tell fingerprints apart any more the other half is used, with its wider border.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import free_name, map_rows, raw_words, ship, typed
from traitloom.operators.skew import spread_join
from traitloom.scratch import cut

BITS = 64
_LOW, _HIGH = np.uint64(0x00000000FFFFFFFF), np.uint64(0xFFFFFFFF00000000)
HALVES = ((_LOW, _HIGH), (_HIGH, _LOW))


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, as an unsigned number.

    A-Z are lower-cased. A text with fewer words than ``width`` is one shingle, one
    without words has fingerprint 0. Long texts are hashed in blocks.
    """
    words = [] if text is None else raw_words(text)
    if not words:
        return 0
    words = b" ".join(words).lower().split()
    many = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, many, 16_384):
        stop = min(many, start + 16_384)
        hashes = np.array(
            [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), seed) for i in range(start, stop)], dtype="<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > many, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, carry: list[str], width: int = 3) -> tuple[DataFrame, str]:
    """The columns ``carry`` of all documents and the fingerprint of their text, a signed bigint; also its name."""
    kept = docs.select(*[F.col(f"`{name}`") for name in carry])
    text, fp = free_name(kept, "text_"), free_name(kept, "fp")
    asked = kept if "text" in carry else docs.select(*kept.columns, F.col("text").alias(text))
    text = "text" if "text" in carry else text

    def hashed(batch: pa.RecordBatch) -> dict:
        prints = np.array([fingerprint(x, width) for x in batch[text].to_pylist()], dtype=np.uint64)
        return {name: batch[name] for name in carry} | {fp: prints.view(np.int64)}

    return map_rows(asked, hashed, kept.withColumn(fp, F.lit(0).cast("bigint")).schema), fp


@dataclass(frozen=True)
class Node:
    """A node that splits at ``radius`` around ``vantage`` on the bits of ``mask``."""

    mask: np.uint64
    vantage: np.uint64
    radius: int
    border: int  # how far outside a fingerprint still enters the inside
    inside: Node | int  # a shard's number at the leaves
    outside: Node | int


def distance(points: np.ndarray, other: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((points ^ other) & mask)


def grow(points: np.ndarray, own: np.uint64, other: np.uint64, links: int, leaf: int, shards: list[int]) -> Node | int:
    """A tree over ``points`` whose leaves hold at most ``leaf`` of them, if they can be told apart.

    Pairs to be found differ in at most ``links // 2`` bits of ``own`` and in at most
    ``links`` bits of ``other``. ``shards`` counts the leaves.
    """
    if len(points) > leaf:
        for mask, border in ((own, links // 2), (other, links)):
            # vantage points are tried at both ends and in the middle of the bit order
            for vantage in (points[0], points[len(points) // 2], points[-1]):
                far = distance(points, vantage, mask)
                radius = int(np.median(far))
                inside = far <= radius
                if inside.all():
                    radius, inside = radius - 1, far <= radius - 1
                entering = far <= radius + border
                # both sides must be clearly smaller than the whole, or splitting would only copy
                if 0 < inside.sum() and max(entering.sum(), len(points) - inside.sum()) <= 0.9 * len(points):
                    return Node(
                        mask, vantage, radius, border,
                        grow(points[entering], own, other, links, leaf, shards),
                        grow(points[~inside], own, other, links, leaf, shards),
                    )
    shards.append(len(points))
    return len(shards) - 1


def route(points: np.ndarray, tree: Node | int, rows: np.ndarray | None = None) -> list[tuple[int, np.ndarray]]:
    """[(shard, rows of ``points`` that enter it)]."""
    rows = np.arange(len(points)) if rows is None else rows
    if not len(rows):
        return []
    if isinstance(tree, int):
        return [(tree, rows)]
    far = distance(points[rows], tree.vantage, tree.mask)
    return route(points, tree.inside, rows[far <= tree.radius + tree.border]) + route(
        points, tree.outside, rows[far > tree.radius]
    )


def _root(parent: np.ndarray, at: int) -> int:
    while parent[at] != at:
        parent[at] = at = parent[parent[at]]
    return at


def joined(points: np.ndarray, links: int, parent: np.ndarray | None = None, leaf: int = 1024) -> np.ndarray:
    """For each point the place of the first point that links lead to, within ``points``.

    Large sets are split by trees of their own first; what can't be split any more is compared in
    blocks, of which no more than one is held at a time.
    """
    parent = np.arange(len(points)) if parent is None else parent

    def compare(rows: np.ndarray) -> None:
        block = 2048
        for i in range(0, len(rows), block):
            for j in range(i, len(rows), block):
                left, right = rows[i : i + block], rows[j : j + block]
                for a, b in zip(*np.nonzero(np.bitwise_count(points[left][:, None] ^ points[right][None, :]) <= links)):
                    x, y = _root(parent, left[a]), _root(parent, right[b])
                    parent[max(x, y)] = min(x, y)

    if len(points) <= 2 * leaf:
        compare(np.arange(len(points)))
    else:
        for own, other in HALVES:
            for _, rows in route(points, grow(points, own, other, links, leaf, [])):
                compare(rows)
    return np.array([_root(parent, i) for i in range(len(points))])


def linked_pairs(nodes: DataFrame, links: int = 3, leaf: int = 512, sample: int = 65_536) -> DataFrame:
    """Rows (a, b), a > b: within each shard a spanning forest of the links between ``nodes`` (id, fp).

    fp must be distinct. The trees are grown on the driver from about ``sample``
    fingerprints, chosen by their hashes, so that their size is bounded, and
    all fingerprints pass through them. A leaf is to hold about ``leaf`` of all
    fingerprints; where the sample is too coarse for that, shards split themselves.
    """
    many = nodes.count()
    chosen = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(2**20)) * many < sample * 2**20)
    points = np.sort(chosen.select("fp").toArrow()["fp"].to_numpy().view(np.uint64))
    share = max(8, int(leaf * len(points) / many)) if many else 8
    shards: list[int] = []
    trees = [grow(points, own, other, links, share, shards) for own, other in HALVES]

    def dealt(batch: pa.RecordBatch) -> dict:
        own = batch["fp"].to_numpy().view(np.uint64)
        parts = [part for tree in trees for part in route(own, tree)]
        rows = np.concatenate([rows for _, rows in parts]) if parts else np.zeros(0, dtype=np.int64)
        return {
            "shard": np.repeat([shard for shard, _ in parts], [len(rows) for _, rows in parts]),
            "id": batch["id"].to_numpy()[rows],
            "fp": batch["fp"].to_numpy()[rows],
        }

    def links_of(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("id")
        ids = shard["id"].to_numpy()
        first = ids[joined(shard["fp"].to_numpy(dtype=np.int64).view(np.uint64), links)]
        apart = first != ids
        return pd.DataFrame({"a": ids[apart], "b": first[apart]})

    ship(nodes.sparkSession)
    shared = map_rows(nodes.select("id", "fp"), dealt, "shard int, id bigint, fp bigint")
    return shared.groupBy("shard").applyInPandas(links_of, "a bigint, b bigint").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """Rows (id, root): the smallest id that links lead to, for all ids in ``pairs`` (a, b), a > b.

    Large and small stars in turn: every round hangs the neighbours of a node on its
    smallest neighbour. Each round is a written table; a round joins on nodes whose
    rows may be skewed, which are salted.
    """
    stars, rows = cut(pairs, "stars")
    while rows:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
        # large star: neighbours above a node go to the least around it
        large = (
            spread_join(both, least, "a", salt_by=["b"])
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
            .where("a <> b")
            .distinct()
        )
        large, _ = cut(large, "stars")
        # small star: a node and its neighbours below go to the least of these
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (
            spread_join(large, least, "a", salt_by=["b"], settled=True)
            .select(F.explode(F.array(F.struct("b", "least"), F.struct(F.col("a").alias("b"), "least"))).alias("x"))
            .select(F.col("x.b").alias("a"), F.col("x.least").alias("b"))
            .where("a <> b")
            .distinct()
        )
        small, rows = cut(small, "stars")
        # settled if no node hangs on two others and none that is hung on hangs itself
        open_nodes = small.groupBy("a").count().where("count > 1").select("a").unionByName(
            small.select("a").distinct().join(small.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        )
        stars = small
        if open_nodes.isEmpty():
            break
    return stars.select(F.col("a").alias("id"), F.col("b").alias("root"))


def linked_classes(prints: DataFrame, first: Column, links: int) -> tuple[DataFrame, DataFrame]:
    """Tables (fp, root, first) of the fingerprints and (root, first) of their components.

    root names a component; first is the least ``first`` of the documents in either. A
    fingerprint is one node, however many documents have it.
    """
    classes, _ = cut(prints.groupBy("fp").agg(F.min(first).alias("first")), "classes")
    linked = components(linked_pairs(classes.select(F.col("fp").alias("id"), "fp"), links))
    member = classes.join(linked, classes["fp"] == linked["id"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"
    )
    return member, member.groupBy("root").agg(F.min("first").alias("first"))


def simhash_components(docs: DataFrame, width: int = 3, links: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id.

    Fingerprints with at most ``links`` different bits are linked; component_id is the
    smallest doc_id of all documents that links lead to. Null and empty texts have
    fingerprint 0 and are linked like others. Documents with a null doc_id are linked
    too, but never name a component unless it has no other documents: then it is null.
    Rows that repeat stay rows. Other columns are neither read nor returned.
    """
    prints, _ = cut(with_fingerprints(typed(docs, doc_id="bigint", text="string"), ["doc_id"], width)[0], "prints")
    member, roots = linked_classes(prints, F.col("doc_id"), links)
    roots = roots.withColumnRenamed("first", "component_id")
    named = spread_join(member.select("fp", "root"), roots, "root", salt_by=["fp"]).select("fp", "component_id")
    return spread_join(prints, named, "fp", salt_by=["doc_id"], settled=True).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, width: int = 3, links: int = 3) -> DataFrame:
    """The documents, one of each component: the one with the smallest doc_id, null last.

    Of rows that tie one stays. All columns are kept; texts are handled as by
    ``simhash_components``.
    """
    marked, fp = with_fingerprints(docs, docs.columns, width)
    at = free_name(marked, "at")
    # written once: the number of a row must not change between its uses
    marked, _ = cut(marked.withColumn(at, F.monotonically_increasing_id()), "marked")
    prints = marked.select(F.col(fp).alias("fp"), F.col("doc_id").alias("doc_id"), F.col(at).alias("at"))
    _, roots = linked_classes(prints, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at"), links)
    stays = roots.select(F.col("first.at").alias(at))
    return marked.join(stays, at, "left_semi").select(*[F.col(f"`{name}`") for name in docs.columns])
