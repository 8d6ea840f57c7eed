"""Fill-in-the-middle transformation, cut by an indexable skip list.

A text is a list of tokens. Every lane of the list holds links that pass over some of
them, each with its width in tokens and in code points; the lowest lane has a link for each
token, every lane above leads over a random part of the nodes of the one below. A rank
is found from the top lane down: a link is taken as long as it does not lead beyond the rank, so
that the widths passed add up to the rank exactly, and the code points passed are where to cut.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import free_name, map_rows, slices

# The marks in front of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    changed: int = 50  # of 100 texts
    suffix_first: int = 80  # of 100 changed texts
    sparse: int = 4  # a lane has about one of so many nodes of the lane below
    shortest: int = 8  # no lane above one of so few links


def token_widths(text: str) -> np.ndarray:
    """The code points of each token: a word with the white space before it, or white space at the end.

    White space is space and 0x09-0x0D.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(codes):
        return np.zeros(0, dtype=np.int64)
    blank = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    ends = np.nonzero(~blank[:-1] & blank[1:])[0] + 1
    # whatever stands last ends a token, be it a word or the white space after the last word
    return np.diff(ends, prepend=0, append=len(codes))


def _tall(many: int, lane: int, sparse: int) -> np.ndarray:
    """Which of the first ``many`` nodes of a lane stand in the lane above; the same in every run."""
    x = np.arange(many, dtype=np.uint64) + np.uint64((lane + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) % np.uint64(sparse) == 0


class SkipList:
    """Tokens by rank. ``lanes``: from the lowest up, (tokens, code points, place below) of each link.

    A link's place below is where its first link stands in the lane below.
    """

    def __init__(self, widths: np.ndarray, sparse: int = 4, shortest: int = 8):
        units, chars = np.ones(len(widths), dtype=np.int64), np.asarray(widths, dtype=np.int64)
        self.many = len(widths)
        self.lanes = [(units, chars, np.arange(self.many))]
        while len(units) > shortest:
            # the head is a node of every lane
            tall = _tall(len(units), len(self.lanes), sparse)
            tall[0] = True
            starts = np.nonzero(tall)[0]
            if len(starts) == len(units):
                break
            units, chars = np.add.reduceat(units, starts), np.add.reduceat(chars, starts)
            self.lanes.append((units, chars, starts))

    def seek(self, rank: int) -> int:
        """The code points of the first ``rank`` tokens."""
        if not 0 <= rank <= self.many:
            raise IndexError(rank)
        passed = points = at = 0
        for units, chars, below in reversed(self.lanes):
            while at < len(units) and passed + units[at] <= rank:
                passed, points, at = passed + int(units[at]), points + int(chars[at]), at + 1
            if passed == rank:
                break
            at = int(below[at])
        return points


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2^32 that depend on the seed and the id only; a null id counts as empty."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(text: str, seeds: list[int], settings: Settings) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, code points of the prefix, of the middle, output); see ``fill_in_middle``."""
    tokens = SkipList(token_widths(text), settings.sparse, settings.shortest)
    plain = not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or seeds[2] % 100 >= settings.changed
    if plain:
        return tokens.many, "plain", None, None, text
    first, last = sorted(seed % (tokens.many + 1) for seed in seeds[:2])
    start, stop = tokens.seek(first), tokens.seek(last)
    prefix, middle, suffix = text[:start], text[start:stop], text[stop:]
    if seeds[3] % 100 < settings.suffix_first:
        return tokens.many, "spm", start, stop - start, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return tokens.many, "psm", start, stop - start, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output was made from.

    No changed text holds a mark, and a mark has its ``<`` in front only, so that none can arise at
    the borders: the marks found are those put in.
    """
    if form == "plain":
        return output
    rest, middle = output.split(MIDDLE)
    if form == "spm":
        suffix, prefix = rest.removeprefix(SUFFIX).split(PREFIX)
    else:
        prefix, suffix = rest.removeprefix(PREFIX).split(SUFFIX)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id") -> tuple[DataFrame, str]:
    """All columns of ``docs`` and a struct of what became of the text; also the name of that struct.

    The struct holds ``n`` (tokens), ``form`` (plain, psm or spm), ``prefix_chars`` and
    ``middle_chars`` (null if plain) and ``output``. Which texts change and where they are cut
    follows from the seed and ``doc_id`` alone, so that reruns, other partitions and repeated
    rows agree. Null texts count as empty; these, and texts that hold a mark, stay plain. A text
    of white space alone is one token. A null id draws like an empty one. Texts are worked on
    one after the other, whatever their length. No rows give no rows; columns of clashing names stay.
    """
    made = free_name(docs, "fim")
    kind = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"
    fields, kept = ("n", "form", "prefix_chars", "middle_chars", "output"), docs.columns

    def run(batch: pa.RecordBatch):
        for part in slices(batch):
            rows = [
                dict(zip(fields, rearranged(text or "", draws(settings.seed, i), settings)))
                for text, i in zip(part["text"].to_pylist(), part[doc_id].to_pylist())
            ]
            yield {name: part[name] for name in kept} | {made: rows}

    return map_rows(docs, run, docs.withColumn(made, F.lit(None).cast(kind)).schema), made


def restore(df: DataFrame, output: str, form: str) -> tuple[DataFrame, str]:
    """All columns and the text rebuilt from ``output`` and ``form``; also the name of the new column.

    An output or form that is null gives null.
    """
    made, kept = free_name(df, "restored"), df.columns

    def run(batch: pa.RecordBatch):
        for part in slices(batch, output):
            texts = [
                None if x is None or y is None else restored(x, y)
                for x, y in zip(part[output].to_pylist(), part[form].to_pylist())
            ]
            yield {name: part[name] for name in kept} | {made: texts}

    return map_rows(df, run, df.withColumn(made, F.lit(None).cast("string")).schema), made


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
