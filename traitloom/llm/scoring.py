"""Language-model scores from counts in a log-frequency Bloom filter.

The filter holds the counts of words and word pairs on a logarithmic scale: a key with
count c is put in once for every level up to the level of c, and asking for level after
level until one is missing gives the count back. Filters hold all keys with all their
levels and grow with them; a small one is broadcast, a larger one is a table of lots that
keys are sent to, packed. The pairs of a lot are counted and put in where they arrive.
Probabilities are pairs by absolute discounting, with the word's own probability for the
rest; how much rest there is, is kept per level of the context's count.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import map_rows, slices, typed
from traitloom.scratch import cut, cut_measured, cut_outside, free_shuffles, job_tables

SEED = 42
LEVELS = 128
LOT = 8  # blocks that a lot of a table may take
WAVES = 4  # times that a table is asked, each time for the keys of so many of all texts
PART = 2**22  # bytes of texts whose keys are sent together
END = b""
_WIDE = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Settings:
    most_bits: int = 2**28  # of a filter that is broadcast
    most_pair_bits: int = 2**24  # of the filter of pairs, where it is broadcast: pairs grow with the texts
    block_bits: int = 2**20  # of the part of a filter that one task fills
    probes: int = 6
    steps: int = 2  # levels in which a count doubles
    least_pairs: int = 1  # a pair that is seen less often is left to its word
    discount: float = 0.75
    most_frequent: int = 200_000  # words whose exact counts go along, for the base score
    longest_frequent: int = 64  # bytes of such a word


def mixed(keys: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """A hash of unsigned 64-bit keys; the salt may be one for each key."""
    x = keys + np.atleast_1d(salt).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(mixed(first, 1) + second, 2)


@dataclass(frozen=True)
class LogBloom:
    """A filled filter, or a lot of one: counts of keys, never too small, too large with a small chance."""

    bits: np.ndarray
    block_bits: int
    probes: int
    steps: int

    @staticmethod
    def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
        return (mixed(keys, 3) % np.uint64(blocks)).astype(np.int64)

    @staticmethod
    def probe(hashed: np.ndarray, number: int, block_bits: int) -> np.ndarray:
        """A place in the block, from the hash of key and level."""
        step = (hashed >> np.uint64(32)) | np.uint64(1)
        return (((hashed & _WIDE) + np.uint64(number) * step) % np.uint64(block_bits)).astype(np.int64)

    def holds(self, keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """Whether each key is there with the given level."""
        begin = self.block_of(keys, len(self.bits) * 8 // self.block_bits) * self.block_bits
        hashed = mixed(keys, 4 + levels)
        alive = np.arange(len(keys))
        for number in range(self.probes):
            at = begin[alive] + self.probe(hashed[alive], number, self.block_bits)
            alive = alive[(self.bits[at >> 3] >> (at & 7)) & 1 == 1]
        found = np.zeros(len(keys), dtype=bool)
        found[alive] = True
        return found

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level of each key. A key has all levels below its own, so that after
        1, 2, 4, ... the place between the last that holds and the first that does not is halved."""
        low = self.holds(keys, np.ones(len(keys), dtype=np.int64)).astype(np.int64)
        high = np.where(low, LEVELS, 1)
        open_ = np.nonzero(low)[0]
        while len(open_):
            tried = np.where(high[open_] == LEVELS, np.minimum(2 * low[open_], LEVELS - 1), (low[open_] + high[open_]) // 2)
            there = self.holds(keys[open_], tried)
            low[open_[there]], high[open_[~there]] = tried[there], tried[~there]
            open_ = open_[high[open_] - low[open_] > 1]
        return low

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return level_counts(self.steps)[self.levels(keys)]


def level_of(count: Column, steps: int) -> Column:
    return (F.floor(F.log2(count) * steps + 1e-9) + 1).cast("int")


def level_counts(steps: int) -> np.ndarray:
    """The middle of the counts of each level; level 0 is no count."""
    made = [0.0]
    for level in range(1, LEVELS):
        low = math.ceil(2 ** ((level - 1) / steps) - 1e-9)
        high = math.ceil(2 ** (level / steps) - 1e-9) - 1
        made.append(max(low, (low + high) / 2))
    return np.array(made)


@dataclass(frozen=True)
class BlockTable:
    """A filter that is too large to be broadcast: written rows (lot, bits), each a filter of one block."""

    rows: DataFrame
    lots: int
    probes: int
    steps: int


def bits_per_entry(settings: Settings) -> float:
    return settings.probes / math.log(2)


def level_sizes(grams: DataFrame) -> dict[int, int]:
    """The number of keys of each level."""
    return dict(grams.groupBy("level").count().collect())


def filled(keys: np.ndarray, levels: np.ndarray, size: int, probes: int) -> bytes:
    """A block of ``size`` bits that holds each key with all levels up to its own."""
    bits = np.zeros(size, dtype=bool)
    for level in range(1, int(levels.max()) + 1):
        hashed = mixed(keys[levels >= level], 4 + level)
        for number in range(probes):
            bits[LogBloom.probe(hashed, number, size)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def filled_blocks(grams: DataFrame, blocks: int, block_bits: int, settings: Settings) -> DataFrame:
    """Rows (block, bits) of a filter that holds ``grams`` (key, level)."""

    def dealt(batch: pa.RecordBatch) -> dict:
        keys = batch["key"].to_numpy().view(np.uint64)
        return {"block": LogBloom.block_of(keys, blocks), "key": batch["key"], "level": batch["level"]}

    def fill(block: pd.DataFrame) -> pd.DataFrame:
        keys = block["key"].to_numpy(dtype=np.int64).view(np.uint64)
        packed = filled(keys, block["level"].to_numpy(), block_bits, settings.probes)
        return pd.DataFrame({"block": [block["block"].iloc[0]], "bits": [packed]})

    kept = map_rows(grams, dealt, "block bigint, key bigint, level int")
    return kept.groupBy("block").applyInPandas(fill, "block bigint, bits binary")


def build_filter(
    grams: DataFrame, settings: Settings, at_level: dict[int, int] | None = None
) -> tuple[LogBloom, int]:
    """A filter of ``grams`` (key, level) that can be broadcast, and the least level that it holds.

    Its size follows from the number of keys and levels. Where that would pass
    ``most_bits``, the keys of the lowest levels stay outside, and count as unseen;
    ``whole_filter`` makes a table then.
    """
    at_level = level_sizes(grams) if at_level is None else at_level
    per_item = bits_per_entry(settings)
    least, entries = 1, sum(level * n for level, n in at_level.items())
    while entries * per_item > settings.most_bits:
        entries -= least * at_level.get(least, 0)
        least += 1
    needed = max(2**16, 2 ** math.ceil(math.log2(max(1, entries * per_item))))
    block_bits = min(settings.block_bits, needed)
    blocks = min(settings.most_bits, needed) // block_bits
    # most_bits / 8 bytes at most come to the driver
    parts = filled_blocks(grams.where(F.col("level") >= least), blocks, block_bits, settings).collect()
    bits = np.zeros(blocks * block_bits // 8, dtype=np.uint8)
    for block, packed in parts:
        bits[block * block_bits // 8 : (block + 1) * block_bits // 8] = np.frombuffer(packed, dtype=np.uint8)
    return LogBloom(bits, block_bits, settings.probes, settings.steps), least


def whole_filter(grams: DataFrame, settings: Settings) -> LogBloom | BlockTable:
    """The filter of all ``grams`` (key, level) with all their levels, broadcast or a table."""
    at_level = level_sizes(grams)
    bits = sum(level * n for level, n in at_level.items()) * bits_per_entry(settings)
    if bits <= settings.most_bits:
        return build_filter(grams, settings, at_level)[0]
    lots = math.ceil(bits / (LOT * settings.block_bits))
    rows = filled_blocks(grams, lots, LOT * settings.block_bits, settings).withColumnRenamed("block", "lot")
    return BlockTable(cut_outside(rows, "filter"), lots, settings.probes, settings.steps)


def numbered(texts: pa.Array | list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different tokens, the number of each token in a row, and where each text begins.

    A text's tokens are its words, A-Z lower-cased, and the end.
    """
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    # cut at space and 0x09-0x0D; white space at either side of a text leaves an empty word, which is none
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    tokens = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
    if END in tokens:
        end = tokens.index(END)
        words = row != end
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[words], minlength=len(sizes))
        row = row[words]
    elif len(sizes):
        end = len(tokens)
        tokens.append(END)
    else:
        return [], row, np.array([0])
    ends = np.cumsum(sizes, dtype=np.int64)
    return tokens, np.insert(row, ends, end), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])


def hashes(tokens: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(token, SEED) for token in tokens], dtype=np.uint64)


@dataclass(frozen=True)
class Pairs:
    """The different pairs of a token and the one before it, and the pair of each token in a row."""

    first: np.ndarray  # numbers of tokens
    second: np.ndarray
    times: np.ndarray
    of: np.ndarray | None

    @staticmethod
    def among(row: np.ndarray, different: int, places: bool = True) -> Pairs:
        # each text ends with the end, so that one begins after it, and the first after that of the last
        codes = np.roll(row, 1) * different + row
        of = None
        if places:
            both, of, times = np.unique(codes, return_inverse=True, return_counts=True)
        else:
            both, times = np.unique(codes, return_counts=True)
        return Pairs(both // max(1, different), both % max(1, different), times, of)

    def keys(self, own: np.ndarray) -> np.ndarray:
        return pair_keys(own[self.first], own[self.second])


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (token, n) over all texts; each batch is counted before it is shuffled."""

    def counted(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, most=2 * PART):
            tokens, row, _ = numbered(part["text"])
            yield {"token": tokens, "n": np.bincount(row, minlength=len(tokens))}

    partial = map_rows(typed(docs, text="string"), counted, "token binary, n bigint")
    return partial.groupBy("token").agg(F.sum("n").alias("n"))


def coded_parts(docs: DataFrame, known: Broadcast | None = None) -> DataFrame:
    """Written rows of some texts each, with their number ``part``: the hashes of their different tokens and the place
    there of each token in a row, as bytes; with the Model ``known`` also lists of what needs no filter."""

    def coded(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, most=PART // 2):
            tokens, row, begins = numbered(part["text"])
            made = {"own": [hashes(tokens).tobytes()], "row": [row.astype(np.int32).tobytes()]}
            if known is not None:
                for name, column in without_filters(part, known.value, tokens, row, begins).items():
                    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
                    column = column if isinstance(column, pa.Array) else pa.array(column)
                    made[name] = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), column)
            yield made

    schema = "own binary, row binary"
    columns = {"text": "string"}
    if known is not None:
        schema += "".join(f", {name} array<{kind}>" for name, kind in DOCUMENT.items())
        columns = {"doc_id": "bigint", "text": "string"}
    parts = map_rows(typed(docs, **columns), coded, schema)
    # written once: the number of a part must not change between its uses
    return cut(parts.withColumn("part", F.monotonically_increasing_id()), "parts")[0]


def uncoded(part: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(part["own"], dtype=np.uint64), np.frombuffer(part["row"], dtype=np.int32).astype(np.int64)


def word_keys(own: np.ndarray, row: np.ndarray) -> np.ndarray:
    return own


def keys_of_pairs(own: np.ndarray, row: np.ndarray) -> np.ndarray:
    return Pairs.among(row, len(own), places=False).keys(own)


def by_lot(keys: np.ndarray, lots: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """An order of the keys by lot, the lots that have any, and where each begins and the last ends in that order."""
    of = LogBloom.block_of(keys, lots)
    of = of.astype(np.uint16) if lots <= 2**16 else of  # short integers are sorted in one pass
    order = np.argsort(of, kind="stable")
    of = of[order]
    begins = np.nonzero(np.concatenate([np.ones(min(1, len(of)), dtype=bool), of[1:] != of[:-1]]))[0]
    return order, of[begins].astype(np.int64), [*begins.tolist(), len(of)]


def cut_up(values: np.ndarray, bounds: list[int]) -> list[bytes]:
    return [values[start:stop].tobytes() for start, stop in zip(bounds, bounds[1:])]


def joined(chunks: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers of binary values, one after the other."""
    return np.frombuffer(b"".join(chunks.to_pylist()), dtype=kind)


def with_levels(
    parts: DataFrame, name: str, held: LogBloom | BlockTable, keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray]
) -> DataFrame:
    """``parts`` (``coded_parts``) with ``name``: the levels of ``keys_of`` of each part, a list of bytes by lot.

    Keys go to the lots of the filter, not lots to the texts. Null for a filter that is broadcast.
    """
    if isinstance(held, LogBloom):
        return parts.withColumn(name, F.lit(None).cast("array<binary>"))
    lots, probes, steps = held.lots, held.probes, held.steps

    def asked(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in rows_of(batch):
            keys = keys_of(*uncoded(part))
            order, found, bounds = by_lot(keys, lots)
            yield {"lot": found, "part": np.full(len(found), part["part"]), "keys": cut_up(keys[order], bounds)}

    def told(asks: pa.Table, rows: pa.Table) -> pa.Table:
        made: dict[str, list] = {"part": [], "lot": [], "levels": []}
        if asks.num_rows:
            bits = joined(rows["bits"], np.uint8)
            held_here = LogBloom(bits, len(bits) * 8, probes, steps) if len(bits) else None
            for batch in asks.to_batches():
                for some in slices(batch, "keys"):
                    keys = joined(some["keys"], np.uint64)
                    levels = held_here.levels(keys).astype(np.uint8) if held_here else np.zeros(len(keys), dtype=np.uint8)
                    made["levels"] += cut_up(levels, [0, *(np.cumsum(pc.binary_length(some["keys"])) // 8).tolist()])
                    made["part"] += some["part"].to_pylist()
                    made["lot"] += some["lot"].to_pylist()
        kinds = {"part": pa.int64(), "lot": pa.int64(), "levels": pa.binary()}
        return pa.table({column: pa.array(made[column], kind) for column, kind in kinds.items()})

    asks = map_rows(parts.select("part", "own", "row"), asked, "lot bigint, part bigint, keys binary")
    answers = asks.groupBy("lot").cogroup(held.rows.groupBy("lot")).applyInArrow(
        told, "part bigint, lot bigint, levels binary"
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("lot", "levels"))), lambda x: x["levels"])
    return parts.join(answers.groupBy("part").agg(listed.alias(name)), "part", "left")


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Each row of a batch, for rows that hold long values."""
    for at in range(batch.num_rows):
        yield {name: batch[name][at].as_py() for name in batch.schema.names}


def levels_told(keys: np.ndarray, told: list[bytes], lots: int) -> np.ndarray:
    """The levels of ``keys`` in their order, from the lists of ``with_levels``."""
    levels = np.empty(len(keys), dtype=np.int64)
    levels[by_lot(keys, lots)[0]] = np.frombuffer(b"".join(told), dtype=np.uint8)
    return levels


def pair_counts(docs: DataFrame, words: LogBloom | BlockTable, lots: int) -> DataFrame:
    """Rows (lot, keys, contexts, n) of bytes: the pairs of some texts by hash, with the level of the first token's count."""

    def count(own: np.ndarray, row: np.ndarray, levels_of: Callable[[np.ndarray], np.ndarray]) -> dict:
        pairs = Pairs.among(row, len(own), places=False)
        keys, contexts = pairs.keys(own), levels_of(own)[pairs.first].astype(np.uint8)
        order, found, bounds = by_lot(keys, lots)
        columns = {"keys": keys, "contexts": contexts, "n": pairs.times.astype(np.int32)}
        return {"lot": found} | {name: cut_up(column[order], bounds) for name, column in columns.items()}

    schema = "lot bigint, keys binary, contexts binary, n binary"
    if isinstance(words, LogBloom):
        shared = docs.sparkSession.sparkContext.broadcast(words)

        def counted(batch: pa.RecordBatch) -> Iterator[dict]:
            for part in slices(batch, most=PART):
                tokens, row, _ = numbered(part["text"])
                yield count(hashes(tokens), row, shared.value.levels)

        return map_rows(typed(docs, text="string"), counted, schema)
    word_lots = words.lots

    def counted_parts(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in rows_of(batch):
            yield count(*uncoded(part), lambda own: levels_told(own, part["words"], word_lots))

    return map_rows(with_levels(coded_parts(docs), "words", words, word_keys), counted_parts, schema)


def filter_of_pairs(
    counts: DataFrame, lots: int, broadcast: bool, settings: Settings
) -> tuple[LogBloom | BlockTable, np.ndarray]:
    """The filter of all pairs of ``pair_counts``, and the rest by the level of the context's count.

    The pairs of a lot are summed and put into its part of the filter at once; only where the filter is broadcast
    do they leave it, for the blocks follow from the number of all then.
    """

    def summed(partial: pa.Table) -> pa.Table:
        kinds = {"keys": np.uint64, "contexts": np.uint8, "n": np.int32}
        keys, contexts, n = (joined(partial[name], kind) for name, kind in kinds.items())
        order = np.argsort(keys)
        keys = keys[order]
        begins = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
        keys, contexts = keys[begins], np.maximum.reduceat(contexts[order], begins)
        n = np.add.reduceat(n[order].astype(np.int64), begins)
        often = n >= settings.least_pairs
        seen = np.bincount(contexts, weights=np.where(often, n - settings.discount, 0.0), minlength=LEVELS)
        all_ = np.bincount(contexts, weights=n, minlength=LEVELS)
        keys, levels = keys[often], (np.floor(np.log2(n[often]) * settings.steps + 1e-9) + 1).astype(np.uint8)
        bits = None
        if len(keys) and not broadcast:
            size = 8 * math.ceil(max(64, int(levels.sum(dtype=np.int64)) * bits_per_entry(settings)) / 8)
            bits = filled(keys, levels, size, settings.probes)
        made = {
            "lot": pa.array([partial["lot"][0].as_py()], pa.int64()),
            "bits": pa.array([bits], pa.binary()),
            "keys": pa.array([keys.tobytes() if broadcast else None], pa.binary()),
            "levels": pa.array([levels.tobytes() if broadcast else None], pa.binary()),
            "all": pa.array([all_], pa.list_(pa.float64())),
            "seen": pa.array([seen], pa.list_(pa.float64())),
        }
        return pa.table(made)

    made = counts.groupBy("lot").applyInArrow(
        summed, "lot bigint, bits binary, keys binary, levels binary, all array<double>, seen array<double>"
    )
    made = cut_outside(made, "filter")
    rest = np.ones(LEVELS)
    shares = made.select(F.posexplode(F.arrays_zip("all", "seen")).alias("context", "x")).groupBy("context").agg(
        F.sum("x.all").alias("all"), F.sum("x.seen").alias("seen")
    )
    for level, all_, seen in shares.where(F.col("all") > 0).collect():
        rest[level] = 1 - seen / all_
    if not broadcast:
        rows = made.where(F.col("bits").isNotNull()).select("lot", "bits")
        return BlockTable(rows, lots, settings.probes, settings.steps), rest

    def unpacked(batch: pa.RecordBatch) -> Iterator[dict]:
        for keys, levels in zip(batch["keys"].to_pylist(), batch["levels"].to_pylist()):
            yield {"key": np.frombuffer(keys, dtype=np.int64), "level": np.frombuffer(levels, dtype=np.uint8).astype(np.int32)}

    grams = map_rows(made.select("keys", "levels"), unpacked, "key bigint, level int")
    return build_filter(grams, settings)[0], rest


@dataclass(frozen=True)
class Model:
    """What scores texts; ``rest`` is by the level of the context's count. It is broadcast but for filters that are tables."""

    words: LogBloom | BlockTable | None
    pairs: LogBloom | BlockTable | None
    rest: np.ndarray
    tokens: int
    different: int
    frequent: dict[bytes, int]
    settings: Settings

    def one(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.tokens + 0.5 * (self.different + 1))

    def probabilities(
        self, own: np.ndarray, pairs: Pairs, levels: np.ndarray | None = None, both: np.ndarray | None = None
    ) -> np.ndarray:
        """Of each different pair: of its second token after its first; ``own`` are the tokens' hashes.

        ``levels`` of tokens and ``both`` of pairs are given where the filter is a table.
        """
        counted = level_counts(self.settings.steps)
        both = counted[self.pairs.levels(pairs.keys(own)) if both is None else both]
        levels = self.words.levels(own) if levels is None else levels
        counts = counted[levels]
        before = np.maximum(counts[pairs.first], both)
        seen = np.where(both >= self.settings.least_pairs, both - self.settings.discount, 0) / np.maximum(before, 1)
        return seen + self.rest[levels[pairs.first]] * self.one(counts[pairs.second])


def train(docs: DataFrame, settings: Settings = Settings()) -> tuple[Model, DataFrame]:
    """Learn from all texts of ``docs``; also the written table (token, n) of exact counts."""
    counts, sums = cut_measured(word_counts(docs), "words", tokens=F.sum("n"))
    tokens, different = sums["tokens"] or 0, sums["rows"]
    grams = counts.select(F.xxhash64("token").alias("key"), level_of(F.col("n"), settings.steps).alias("level"))
    words = whole_filter(grams, settings)
    free_shuffles(docs.sparkSession)
    # there are no more pairs than tokens
    bits = tokens * bits_per_entry(settings)
    lots = max(1, math.ceil(bits / (LOT * settings.block_bits)))
    with job_tables(docs.sparkSession):
        broadcast = bits <= min(settings.most_bits, settings.most_pair_bits)
        filled_pairs, rest = filter_of_pairs(pair_counts(docs, words, lots), lots, broadcast, settings)
    free_shuffles(docs.sparkSession)
    by_level = dict(
        counts.where(F.length("token") <= settings.longest_frequent)
        .groupBy(level_of(F.col("n"), settings.steps)).count().collect()
    )
    least_level, room = LEVELS, settings.most_frequent
    while least_level > 1 and room >= by_level.get(least_level - 1, 0):
        least_level -= 1
        room -= by_level.get(least_level, 0)
    frequent = counts.where(
        (F.length("token") <= settings.longest_frequent) & (level_of(F.col("n"), settings.steps) >= least_level)
    )
    # most_frequent rows at most
    exact = {bytes(token): n for token, n in frequent.collect()}
    return Model(words, filled_pairs, rest, tokens, different, exact, settings), counts


DOCUMENT = {
    "doc_id": "bigint",
    "n_tokens": "bigint",
    "known": "bigint",
    "base": "double",
    "rare": "array<struct<token:binary,n:int>>",
}


def without_filters(
    part: pa.RecordBatch, known: Model, tokens: list[bytes], row: np.ndarray, begins: np.ndarray
) -> dict:
    """The columns of DOCUMENT, of some documents whose ``numbered`` tokens are given."""
    many, different = len(begins) - 1, max(1, len(tokens))
    exact = np.array([known.frequent.get(token, -1) for token in tokens], dtype=np.int64)
    bases = np.where(exact >= 0, np.log10(known.one(np.maximum(exact, 0))), 0.0)[row]
    text = np.repeat(np.arange(many), np.diff(begins))
    # words that are not frequent: each text's different ones, with their number
    rare = exact[row] < 0
    each, times = np.unique(text[rare] * different + row[rare], return_counts=True)
    offsets = np.searchsorted(each, np.arange(many + 1) * different).astype(np.int32)
    items = pa.StructArray.from_arrays(
        [pa.array(tokens, pa.binary()).take(pa.array(each % different)), pa.array(times, pa.int32())], ["token", "n"]
    )
    return {
        "doc_id": part["doc_id"],
        "n_tokens": np.diff(begins),
        "known": np.bincount(text[~rare], minlength=many),
        "base": np.bincount(text, weights=bases, minlength=many),
        "rare": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items),
    }


def text_scores(
    own: np.ndarray,
    row: np.ndarray,
    sizes: np.ndarray,
    known: Model,
    words: Callable[[np.ndarray], np.ndarray] | None = None,
    both: Callable[[np.ndarray], np.ndarray] | None = None,
) -> np.ndarray:
    """The score of each text, of ``sizes`` tokens. ``words`` and ``both`` give the levels of keys of tokens and pairs where
    the filter is a table."""
    pairs = Pairs.among(row, len(own))
    levels = words(own) if words else None
    both_levels = both(pairs.keys(own)) if both else None
    logs = np.log10(known.probabilities(own, pairs, levels, both_levels))[pairs.of]
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=logs, minlength=len(sizes))


def _with_place(partial: DataFrame) -> DataFrame:
    return partial.withColumn("at", F.monotonically_increasing_id())


def _scored_in_waves(
    docs: DataFrame, model: Model, shared: Broadcast, score: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The written results of ``score``, which is given the parts of one wave at a time, with their levels.

    Each document is in one of the ``WAVES``. The keys that a wave asks for take more room than its texts; they and
    its parts are deleted before the next wave asks.
    """
    spark = docs.sparkSession

    def scored(wave: int) -> DataFrame:
        own = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(WAVES)) == wave)
        # a number in this wave and the wave: no two of the waves have the same
        parts = coded_parts(own, shared).withColumn("part", F.col("part") * WAVES + wave)
        asked = with_levels(with_levels(parts, "words", model.words, word_keys), "pairs", model.pairs, keys_of_pairs)
        return cut_outside(_with_place(score(asked)).withColumn("at", F.col("at") * WAVES + wave), "scored")

    results = []
    for wave in range(WAVES):
        with job_tables(spark):
            results.append(scored(wave))
        free_shuffles(spark)
    return reduce(DataFrame.unionByName, results)


def score_texts(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    base_score is exact: frequent words bring their counts along, the rest are joined with
    the table of all counts. A null text is empty and has the one token of its end. Rows
    that repeat are scored each. Other columns are neither read nor returned.
    """
    tables = {name: held.lots for name in ("words", "pairs") if isinstance(held := getattr(model, name), BlockTable)}
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, **dict.fromkeys(tables)))
    docs = typed(docs, doc_id="bigint", text="string")

    def scored(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch):
            tokens, row, begins = numbered(part["text"])
            score = text_scores(hashes(tokens), row, np.diff(begins), shared.value)
            yield without_filters(part, shared.value, tokens, row, begins) | {"score": score}

    def scored_parts(batch: pa.RecordBatch) -> Iterator[dict]:
        for at in range(batch.num_rows):
            part = {name: batch[name][at].as_py() for name in ("own", "row", "words", "pairs")}
            asked = [
                (lambda keys, name=name: levels_told(keys, part[name], tables[name])) if name in tables else None
                for name in ("words", "pairs")
            ]
            made = {name: batch[name][at].values for name in DOCUMENT}
            score = text_scores(*uncoded(part), made["n_tokens"].to_numpy(), shared.value, *asked)
            yield made | {"score": score}

    schema = ", ".join(f"{name} {kind}" for name, kind in DOCUMENT.items()) + ", score double"
    # written once: the number of a row must not change between its uses
    if tables:
        partial = _scored_in_waves(docs, model, shared, lambda asked: map_rows(asked, scored_parts, schema))
    else:
        partial, _ = cut(_with_place(map_rows(docs, scored, schema)), "scored")
    size = F.lit(model.tokens + 0.5 * (model.different + 1))
    rare = (
        partial.select("at", F.explode("rare").alias("x")).select("at", "x.token", F.col("x.n").alias("times"))
        .join(counts, "token", "left")
        .groupBy("at").agg(
            F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / size)).alias("rare_base"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    return partial.drop("rare").join(rare, "at", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score",
    )
