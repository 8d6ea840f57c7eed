"""Best-fit packing, planned over the histogram of lengths.

Texts are tokenized once into pieces of at most ``capacity`` tokens. The plan sees
only how many pieces there are of each length: whole runs of equal pieces are put
into whole runs of sequences with the smallest room that holds them. A piece finds
its place by its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from traitloom.llm.common import free_name, map_rows, raw_words, typed
from traitloom.scratch import cut

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
_MOST_CACHED = 400_000  # words a worker remembers
_LOADED: dict[str, TextEncoder] = {}


class Made(dict):
    """A dictionary that makes the values it is asked for."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class TextEncoder:
    """Token ids of texts as little-endian 32-bit numbers, each distinct word encoded once.

    A tokenizer that drops white space and splits at it encodes each word on its own,
    so that a text is its words one after the other. For words of Latin letters the
    model is called on their parts; all others, and all texts under other kinds of
    tokenizer, go through the tokenizer as a whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        steps = [step.get("type") for step in (config.get("normalizer") or {}).get("normalizers", [])]
        split = next(iter((config.get("pre_tokenizer") or {}).get("pretokenizers", [])), {})
        pattern = split.get("pattern", {}).get("Regex", "")
        self.by_word = (
            steps == ["NFC", "Replace", "Lowercase"]
            and (split.get("behavior"), split.get("invert")) == ("Removed", True)
            and r"[^\s\p{L}\p{N}]+" in pattern
        )
        self.split = regex.compile(pattern).findall
        self.specials = tuple(x["content"] for x in config.get("added_tokens", []))
        self.words: dict[bytes, bytes] = Made(self._word)
        self.parts: dict[str, bytes] = Made(self._part)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that show as themselves
        hidden = [byte for byte in range(256) if byte not in shown]
        self.bytes = {byte: chr(byte) for byte in shown} | {byte: chr(256 + i) for i, byte in enumerate(hidden)}

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() and part.isprintable() else "".join(map(self.bytes.__getitem__, part.encode()))
        tokens = self.tokenizer.model.tokenize(shown)
        return struct.pack(f"<{len(tokens)}I", *[token.id for token in tokens])

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode()
        # below U+0250 all characters are their own NFC form and lower-case one by one
        if (not word.isascii() and max(word) >= "ɐ") or ("<" in word and any(x in word for x in self.specials)):
            return self._whole(word)
        return b"".join(map(self.parts.__getitem__, self.split(word.lower())))

    def encode(self, text: str | None) -> bytes:
        if not self.by_word:
            return self._whole(text or "")
        if len(self.words) > _MOST_CACHED:
            self.words.clear()
            self.parts.clear()
        return b"".join(map(self.words.__getitem__, raw_words(text)))


def encoder(path: str) -> TextEncoder:
    """The encoder of a file, loaded once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = TextEncoder(path)
    return _LOADED[path]


def token_pieces(
    docs: DataFrame, path: str = WORD_BPE, end: int = 1, capacity: int = 4096, with_ids: bool = True
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, ids): each text's tokens and ``end``, cut at ``capacity``.

    A null text is empty and gives the one piece [end]. Rows that repeat give their
    pieces each. Other columns are neither read nor returned.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    last = struct.pack("<I", end)

    def pieces(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in columns}
        encode = encoder(path).encode
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            ids = encode(text) + last
            for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[start : start + 4 * capacity]
                row = (doc_id, piece, start // 4, len(own) // 4, zlib.crc32(own))
                for name, value in zip(columns, (*row, np.frombuffer(own, dtype="<u4")) if with_ids else row):
                    out[name].append(value)
        return out

    return map_rows(
        typed(docs, doc_id="bigint", text="string"),
        pieces,
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids,
    )


def plan_packing(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Best-fit decreasing over ``{length: how many}``; rows of runs, ordered by length and rank.

    A run says: the pieces of ``length`` from ``rank`` on (to the next run) go to the
    sequences from ``sequence`` on, one to each, at ``offset``. Equal pieces are placed
    by runs, so that the work and the plan depend on the number of different lengths
    (at most ``capacity``), not on the number of pieces.
    """
    runs: list[tuple[int, int, int, int]] = []
    rooms: list[int] = []  # rooms left that some sequence has, ascending
    open_runs: dict[int, deque[tuple[int, int]]] = {}  # room: (first sequence, how many)
    made = 0

    def leave(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in open_runs:
                open_runs[room] = deque()
                insort(rooms, room)
            open_runs[room].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = open_runs[room].popleft()
                if not open_runs[room]:
                    del open_runs[room], rooms[at]
            else:
                room, first = capacity, made
                many = -(-left // (capacity // length))
                made += many
            each = room // length  # the tightest sequence stays the tightest until it is full
            full = min(many, left // each)
            rest = left - full * each if full < many else 0
            for slot in range(each):
                if full:
                    runs.append((length, rank + slot * full, first, capacity - room + slot * length))
            rank += full * each
            leave(room - each * length, first, full)
            if rest:
                for slot in range(rest):
                    runs.append((length, rank + slot, first + full, capacity - room + slot * length))
                rank += rest
                leave(room - rest * length, first + full, 1)
                full += 1
            leave(room, first + full, many - full)
            left = counts[length] - rank
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T))


def rank_within(df: DataFrame, group: str, by: list[str], name: str) -> DataFrame:
    """Number the rows of each ``group`` from 0, in salted parts so that no group is one task.

    The order is that of a hash of ``by`` first; equal rows get different numbers.
    """
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt, before = free_name(df, "salt"), free_name(df, "before")
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    earlier = Window.partitionBy(group).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        salted.groupBy(group, salt)
        .agg(F.count(F.lit(1)).alias(before))
        .withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    )
    nth = F.row_number().over(Window.partitionBy(group, salt).orderBy(*by))
    numbered = salted.withColumn(name, nth.cast("bigint") - 1)
    return numbered.join(offsets, [group, salt]).withColumn(name, F.col(name) + F.col(before)).drop(salt, before)


def best_fit_packing(docs: DataFrame, path: str = WORD_BPE, end: int = 1, capacity: int = 4096) -> DataFrame:
    """Pack all texts; one row per piece with its sequence and its place there.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Equal lengths
    tie by doc_id, piece and checksum. Without documents there are no rows.
    """
    pieces, _ = cut(token_pieces(docs, path, end, capacity, with_ids=False), "pieces")
    # at most ``capacity`` rows come to the driver
    plan = plan_packing(dict(pieces.groupBy("length").count().collect()), capacity)
    shift = 2**40  # ranks within a length are smaller
    keys = plan["length"] * shift + plan["rank"]
    ranked = rank_within(pieces, "length", ["doc_id", "piece", "ids_crc32"], "rank")

    def placed(batch: pa.RecordBatch) -> dict[str, list]:
        length, rank = (batch[name].to_numpy() for name in ("length", "rank"))
        run = np.searchsorted(keys, length * shift + rank, side="right") - 1
        kept = {name: batch[name] for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
        return kept | {
            "sequence_id": plan["sequence"][run] + rank - plan["rank"][run],
            "offset": plan["offset"][run],
        }

    return map_rows(
        ranked,
        placed,
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )
