"""MinHash near-duplicates with tensored banding.

A text has two collections of half keys, each made of a few minhashes. The key of a table is a
half of the first collection with one of the second, so that ``halves`` halves a side make
``halves`` squared tables from 2 x ``halves`` x ``hashes`` minhashes instead of that times
``halves``. Two texts meet in a table exactly if they share a half on either side, which is
how the tables are filled: halves that nobody shares are left out before any are combined,
and the rest are combined where rows with the same first half meet.

Texts are linked by their full sets of shingles. Before tables are made, texts that share a half are
compared with one text of that half at a time. A half or table within one component needs no
more comparing, so that groups of copies never make pairs of all their members.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import arrow_rows, map_rows, ship, typed
from traitloom.llm.simhash import components
from traitloom.operators.skew import spread_join
from traitloom.scratch import cut


@dataclass(frozen=True)
class Settings:
    """A pair of exactly ``percent`` similarity meets in no table once in 60,000 times.

    The share of minhashes that two texts have in common lies five standard deviations above ``percent - margin``.
    """

    width: int = 3
    percent: int = 85
    hashes: int = 5  # a half
    halves: int = 20  # a side
    margin: int = 13
    most: int = 2048  # rows that are compared in one task
    seed: int = 42

    @property
    def signature(self) -> int:
        return 2 * self.halves * self.hashes


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = 3) -> np.ndarray:
    """The distinct word shingles of a text as sorted 64-bit hashes; A-Z are lower-cased.

    A text with fewer words than ``width`` is one shingle, one without words or text has none.
    """
    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    taken = min(width, len(words))
    x = np.full(len(words) - taken + 1, taken, dtype=np.uint64)
    for i in range(taken):
        x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(x)])
    return np.unique(x)


def minhashes(x: np.ndarray, settings: Settings) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    many = settings.signature
    numbers = _mixed(np.arange(1, 2 * many + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(settings.seed))
    add, factor = numbers[:many], numbers[many:] | np.uint64(1)
    least = np.full(many, 2**64 - 1, dtype=np.uint64)
    for start in range(0, len(x), 1024):
        np.minimum(least, ((x[start : start + 1024, None] ^ add) * factor).min(axis=0), out=least)
    return least


def half_keys(least: np.ndarray, settings: Settings) -> np.ndarray:
    """The half keys, first those of the one side, then those of the other; equal ones of different places differ."""
    rows = least.reshape(2 * settings.halves, settings.hashes)
    key = np.arange(len(rows), dtype=np.uint64)
    for column in rows.T:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


PRINT = "doc_id bigint, t binary, set binary, n bigint, a array<bigint>, b array<bigint>, signature binary"


def prints_of(docs: DataFrame, settings: Settings) -> DataFrame:
    """For each document the digest and size of its set, its half keys and a byte of each minhash."""

    def run(batch: pa.RecordBatch) -> dict:
        out = {"doc_id": batch["doc_id"], "t": batch["t"], "set": [], "n": [], "a": [], "b": [], "signature": []}
        for text in batch["text"].to_pylist():
            x = shingles(text, settings.width)
            out["n"].append(len(x))
            out["set"].append(xxhash.xxh3_128_digest(x.tobytes()))
            if not len(x):
                out["a"].append(None)
                out["b"].append(None)
                out["signature"].append(None)
                continue
            least = minhashes(x, settings)
            keys = half_keys(least, settings)
            out["a"].append(keys[: settings.halves])
            out["b"].append(keys[settings.halves :])
            out["signature"].append((least & np.uint64(255)).astype(np.uint8).tobytes())
        return out

    return map_rows(typed(docs, doc_id="bigint", text="string").select("doc_id", "text", _text_key()), run, PRINT)


def _text_key():
    return F.unhex(F.md5("text")).alias("t")


def _shared(nodes: DataFrame, side: str) -> DataFrame:
    """(key, id) of the half keys of a side that several nodes have."""
    rows = nodes.select("id", F.explode(side).alias("key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    return spread_join(rows, shared, "key", "left_semi", salt_by=["id"], settled=True)


def live_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes that share a half on either side; halves that no other node has are 0."""
    sides = [
        _shared(nodes, side).groupBy("id").agg(F.collect_list("key").alias(f"{side}_"))  # at most ``halves`` keys
        for side in ("a", "b")
    ]
    both = nodes.join(sides[0].join(sides[1], "id"), "id")

    def only(side: str):
        return F.transform(side, lambda key: F.when(F.array_contains(f"{side}_", key), key).otherwise(0)).alias(side)

    return both.select("id", "doc_id", "t", "n", only("a"), only("b"), "signature")


def linked(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Of distinct pairs (x, y) those whose full sets are similar enough."""
    left = spread_join(pairs, texts.select(F.col("id").alias("x"), F.col("text").alias("left")), "x", salt_by=["y"], settled=True)
    both = spread_join(left, texts.select(F.col("id").alias("y"), F.col("text").alias("right")), "y", salt_by=["x"])

    def run(batch: pa.RecordBatch) -> dict:
        x, y, last, other = [], [], None, None
        for i, j, left, right in zip(*(batch[c].to_pylist() for c in ("x", "y", "left", "right"))):
            own = shingles(left, settings.width)
            if j != last:
                last, other = j, shingles(right, settings.width)
            common = len(np.intersect1d(own, other, assume_unique=True))
            if 100 * common >= settings.percent * (len(own) + len(other) - common):
                x.append(i)
                y.append(j)
        return {"x": x, "y": y}

    with arrow_rows(pairs.sparkSession, 128):
        return cut(map_rows(both, run, "x bigint, y bigint"), "links")[0]


def joined_by(stars: DataFrame, links: DataFrame) -> DataFrame:
    """Stars (id, root) of what the stars and the links (x, y) connect, without those of one node."""
    edges = stars.select("id", "root").unionByName(links.select(F.col("x").alias("id"), F.col("y").alias("root")))
    edges = edges.select(F.greatest("id", "root").alias("a"), F.least("id", "root").alias("b")).where("a <> b").distinct()
    return cut(components(edges), "components")[0]


def _with_roots(live: DataFrame, stars: DataFrame) -> DataFrame:
    return live.join(stars, "id", "left").withColumn("root", F.coalesce("root", "id"))


def centre_pairs(live: DataFrame, side: str, settings: Settings) -> DataFrame:
    """Pairs (x, y): each node with a node of another component that it shares most halves with.

    Asked are the nodes of least component of each half, one for each.
    """
    rows, _ = cut(live.select("id", "root", "n", F.explode(F.array_remove(side, 0)).alias("key")), "halves")
    centres = rows.groupBy("key").agg(F.min(F.struct("root", "id", "n")).alias("centre"), F.max("root").alias("hi"))
    centres = centres.where("centre.root < hi").select("key", "centre")
    met = spread_join(rows, centres, "key", salt_by=["id"], settled=True).where(
        (F.col("root") != F.col("centre.root")) & _near_sizes(F.col("n"), F.col("centre.n"), settings)
    )
    counts = met.groupBy("id", F.col("centre.id").alias("y")).agg(F.count(F.lit(1)).alias("halves"))
    best = counts.groupBy("id").agg(F.max_by("y", F.struct("halves", -F.col("y"))).alias("y"))
    return best.select(F.col("id").alias("x"), "y")


def _near_sizes(n, m, settings: Settings):
    return 100 * F.least(n, m) >= settings.percent * F.greatest(n, m)


def _open(rows: DataFrame) -> DataFrame:
    """The keys with nodes of several components, and their numbers of rows."""
    return rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("many"), F.min("root").alias("lo"), F.max("root").alias("hi")
    ).where("lo < hi").select("key", "many")


def tables_of(live: DataFrame, settings: Settings) -> DataFrame:
    """Rows (half, half_b, lo, hi, part) and a node: what is compared in one task, one group for each (half, half_b, lo, hi).

    Nodes with one first half are compared in one task if they are few; half_b is 0 then. Those of a
    first half with many nodes are dealt by table, and where that is large, too, by pairs of its parts.
    """
    rows, _ = cut(live.withColumn("half", F.explode(F.array_remove("a", 0))), "tables")
    keyed = rows.withColumn("key", F.col("half"))
    halves, _ = cut(_open(keyed), "open")
    met = spread_join(keyed, halves, "key", salt_by=["id"], settled=True)
    few = met.where(F.col("many") <= settings.most).withColumn("parts", F.lit(1)).withColumn("half_b", F.lit(0).cast("bigint"))
    tables = met.where(F.col("many") > settings.most).drop("many", "key").withColumn("half_b", F.explode(F.array_remove("b", 0)))
    tables, _ = cut(tables.withColumn("key", F.xxhash64("half", "half_b")), "tables")
    large = spread_join(tables, _open(tables), "key", salt_by=["id"], settled=True).withColumn(
        "parts", F.ceil(F.col("many") / settings.most).cast("int")
    )
    dealt = few.unionByName(large.select(few.columns)).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(
        "half", "half_b", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"),
        "part", "id", "root", "n", "a", "b", "signature",
    )


GROUP = ["half", "half_b", "lo", "hi"]


def in_batches(rows: DataFrame, many: int, each: int, run, schema: str) -> DataFrame:
    """``run`` for the rows of every GROUP. Small groups share a task's call, about ``each`` rows of them."""
    batches = max(1, -(-many // each))
    keyed = rows.withColumn("batch", F.pmod(F.xxhash64(*GROUP), F.lit(batches)))
    names = [field.split()[0] for field in schema.split(", ")]

    def split(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(GROUP)
        keys = np.stack([batch[c].to_numpy(dtype=np.int64) for c in GROUP])
        borders = [0, *(np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1).tolist(), len(batch)]
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        made = []
        for start, stop in zip(borders, borders[1:]):
            if stop - start > 1:
                made += run({c: x[start:stop] for c, x in columns.items()})
        return pd.DataFrame(made, columns=names)

    return keyed.groupBy("batch").applyInPandas(split, schema)


def near_places(group: dict, settings: Settings, block: int = 192):
    """Pairs of places in a group, in blocks: of other components, in a common table, with minhashes alike enough.

    Each pair comes from the first half and the first table that it shares only.
    """
    if group["root"].min() == group["root"].max():
        return
    half, half_b, crossing = group["half"][0], group["half_b"][0], group["lo"][0] != group["hi"][0]
    order = np.argsort(group["n"], kind="stable")
    roots, sizes, part = (group[c][order] for c in ("root", "n", "part"))
    signatures = np.frombuffer(b"".join(group["signature"]), dtype=np.uint8).reshape(len(order), -1)[order]
    first, second = (np.stack(group[c]).astype(np.int64)[order] for c in ("a", "b"))
    lane = int(np.argmax(first[0] == half))
    lane_b = None if half_b == 0 else int(np.argmax(second[0] == half_b))
    least = settings.signature * (settings.percent - settings.margin) / 100
    for start in range(0, len(order), block):
        left = np.arange(start, min(start + block, len(order)))
        for begin in range(start, len(order), block):
            right = np.arange(begin, min(begin + block, len(order)))
            if settings.percent * sizes[right[0]] > 100 * sizes[left[-1]]:
                break
            good = (roots[left][:, None] != roots[right][None, :]) & (left[:, None] < right[None, :])
            good &= settings.percent * sizes[right][None, :] <= 100 * sizes[left][:, None]
            if crossing:
                good &= part[left][:, None] != part[right][None, :]
            x, y = np.nonzero(good)
            x, y = left[x], right[y]
            if lane:
                new = ~((first[x, :lane] == first[y, :lane]) & (first[x, :lane] != 0)).any(axis=1)
                x, y = x[new], y[new]
            met = (second[x] == second[y]) & (second[x] != 0)
            fits = met.any(axis=1) if lane_b is None else met[:, lane_b] & ~met[:, :lane_b].any(axis=1)
            x, y = x[fits], y[fits]
            alike = (signatures[x] == signatures[y]).sum(axis=1) >= least
            yield order[x[alike]], order[y[alike]]


def table_links(live: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Links (x, y) that join the components of nodes which meet in a table, for each group a forest of them.

    First each group names the nodes that have a partner whose minhashes are alike enough. Only these get their
    sets, and the groups compare them in full.
    """
    dealt, many = cut(tables_of(live, settings), "dealt")
    ship(live.sparkSession)

    def named(group: dict) -> list[tuple]:
        found: set[int] = set()
        for x, y in near_places(group, settings):
            found.update(x.tolist(), y.tolist())
        return [tuple(group[c][i] for c in (*GROUP, "part", "id")) for i in sorted(found)]

    kinds = "half bigint, half_b bigint, lo int, hi int, part int, id bigint"
    asked, rows = cut(in_batches(dealt, many, 2 * settings.most, named, kinds), "asked")
    nodes = live.select("id", "root", "n", "a", "b", "signature")
    if not rows:
        return live.select(F.col("id").alias("x"), F.col("id").alias("y")).limit(0)

    def sets(batch: pa.RecordBatch) -> dict:
        return {"id": batch["id"], "set": [shingles(text, settings.width).tobytes() for text in batch["text"].to_pylist()]}

    wanted = texts.join(asked.select("id").distinct(), "id", "left_semi")
    with arrow_rows(live.sparkSession, 512):
        full, _ = cut(map_rows(wanted, sets, "id bigint, set binary"), "sets")

    def forest(group: dict) -> list[tuple]:
        ids, roots, own = group["id"], group["root"], group["set"]
        above: dict[int, int] = {}

        def top(root: int) -> int:
            while root in above:
                root = above[root]
            return root

        links = []
        for x, y in near_places(group, settings):
            for i, j in zip(x, y):
                a, b = top(roots[i]), top(roots[j])
                if a == b:
                    continue
                left, right = np.frombuffer(own[i], dtype=np.uint64), np.frombuffer(own[j], dtype=np.uint64)
                common = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * common >= settings.percent * (len(left) + len(right) - common):
                    above[max(a, b)] = min(a, b)
                    links.append((ids[i], ids[j]))
        return links

    groups = asked.join(nodes, "id").join(full, "id")
    return cut(in_batches(groups, rows, settings.most // 2, forest, "x bigint, y bigint"), "links")[0]


def linked_sets(docs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """Stars (id, root) of the components of the distinct sets ``nodes``; those without links are left out."""
    live, rows = cut(live_nodes(nodes), "live")
    stars = live.select("id", F.col("id").alias("root")).limit(0)
    if not rows:
        return stars
    texts = typed(docs, doc_id="bigint", text="string").select(F.col("doc_id").alias("d"), _text_key(), "text")
    wanted = live.select("id", "t", F.col("doc_id").alias("d"))
    least = F.lit(-(2**63))
    texts = texts.withColumn("d", F.coalesce("d", least)).join(wanted.withColumn("d", F.coalesce("d", least)), ["t", "d"])
    texts, _ = cut(texts.select("id", "text").dropDuplicates(["id"]), "texts")
    found = rows
    while found:
        found = 0
        for side in ("a", "b"):
            pairs, many = cut(centre_pairs(_with_roots(live, stars), side, settings), "pairs")
            if many:
                links = linked(pairs, texts, settings)
                new = links.count()
                found += new
                stars = joined_by(stars, links) if new else stars
    return joined_by(stars, table_links(_with_roots(live, stars), texts, settings))


def minhash_components(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id and kept.

    Documents are linked if their sets of distinct word shingles have at least ``percent`` of a hundred in
    common; component_id is the smallest doc_id that links lead to, and kept says that it is the
    document's own. Null texts and those without words have empty sets and are linked with nothing. Documents
    with a null doc_id are linked too, but never name a component unless it has no other documents: then
    component_id is null and kept false. Rows that repeat stay rows. Other columns are neither read
    nor returned.
    """
    made = prints_of(docs, settings).withColumn("row", F.monotonically_increasing_id())
    prints, _ = cut(made, "prints")
    own = F.struct("doc_id", "t", "n", "a", "b", "signature")
    classes, _ = cut(
        prints.where("n > 0").groupBy("set").agg(
            F.min("row").alias("id"), F.min("doc_id").alias("first"), F.min_by(own, "row").alias("own")
        ).select("set", "id", "first", "own.*"),
        "classes",
    )
    stars = linked_sets(docs, classes.drop("set", "first"), settings)
    member = classes.select("set", "id", "first").join(stars, "id", "left").select(
        "set", F.coalesce("root", "id").alias("root"), "first"
    )
    firsts = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = spread_join(member.select("set", "root"), firsts, "root", salt_by=["set"]).select("set", "component_id")
    full = spread_join(prints.where("n > 0").select("set", "doc_id", "n", "row"), named, "set", salt_by=["row"], settled=True)
    empty = prints.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.select("doc_id", "n", "component_id").unionByName(empty).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
