"""Quality rules: how far a document's distributions are from its language's.

Every language gets a reference that is counted over all its documents: a
histogram of character classes and one of its most common words. A document is
compared with the reference of its language by the Jensen-Shannon distance, or with
that of the whole corpus where its language has too few words for one. A
short text is far from any reference by chance alone, so that the distance it
is allowed grows with one over the root of its number of words, and below
``min_words`` the base rules decide alone.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitloom.llm.common import map_rows, raw_words, typed
from traitloom.scratch import cut

SYMBOLS = "#*$%&|<>"
CLASSES = ("letter", "upper", "digit", "space", "stop", "other")
STOPS = ".,;:!?"


@dataclass(frozen=True)
class Rules:
    """Parameters of the rules; distances lie between 0 and 1."""

    min_words: int = 50  # fewer words fail
    max_repeat_percent: int = 50  # of the words in repeated windows
    common_words: int = 100  # words of a language's reference
    longest_common: int = 32  # code points of a word that can be a common word
    min_reference_words: int = 2000  # words a language needs for a reference
    most_carried: int = 1000  # references that go along with the tasks; more are joined to the documents
    char_limit: float = 0.22
    char_slack: float = 0.5  # divided by the root of the number of words
    word_limit: float = 0.18
    word_slack: float = 2.8


@cache
def _class_of() -> np.ndarray:
    """The class of each code point as its place in CLASSES."""
    classes = np.full(0x110000, 5, dtype=np.uint8)
    for code in range(0x110000):
        char = chr(code)
        kind = unicodedata.category(char)
        if char.isspace():
            classes[code] = 3
        elif kind in ("Lu", "Lt"):
            classes[code] = 1
        elif kind[0] in "LM":
            classes[code] = 0
        elif kind[0] == "N":
            classes[code] = 2
        elif char in STOPS:
            classes[code] = 4
    return classes


def char_histogram(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.bincount(_class_of()[codes], minlength=len(CLASSES))


def divergence(left: np.ndarray, right: np.ndarray) -> float:
    """Jensen-Shannon distance (root of the divergence in bits); 0 if a side is empty."""
    if not left.sum() or not right.sum():
        return 0.0
    p, q = left / left.sum(), right / right.sum()
    middle = (p + q) / 2
    total = sum((x[x > 0] * np.log2(x[x > 0] / middle[x > 0])).sum() for x in (p, q))
    return math.sqrt(max(0.0, total / 2))


def base_counts(text: str | None, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    if text is None:
        return 0, 0, 0, 0
    chars = sum(len(word.decode("utf-8", "surrogatepass")) for word in words) if not text.isascii() else sum(map(len, words))
    lines = Counter(line for line in text.split("\n") if raw_words(line))
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(windows) < len(words) - 2:
        end = 0  # of the words counted so far
        for at, window in enumerate(zip(words, words[1:], words[2:])):
            if windows[window] > 1:
                repeated += at + 3 - max(at, end)
                end = at + 3
    return chars, sum(map(text.count, SYMBOLS)), sum(lines.values()) - len(lines), repeated


def language_counts(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Rows (lang, kind, item, n): counts of character classes and of lower-case words.

    Each batch of a task is counted before it is shuffled. kind is 'class',
    'word', or 'words' for the number of all words.
    """

    def counted(batch: pa.RecordBatch) -> dict[str, list]:
        words: Counter = Counter()
        classes: dict = {}
        totals: Counter = Counter()
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
            if text is None:
                continue
            found = raw_words(text.lower())
            totals[lang] += len(found)
            for word, n in Counter(found).items():
                words[lang, word] += n
            classes[lang] = classes.get(lang, 0) + char_histogram(text)
        rows = [(lang, "words", "", n) for lang, n in totals.items()]
        rows += [(lang, "class", CLASSES[i], int(n)) for lang, h in classes.items() for i, n in enumerate(h) if n]
        rows += [
            (lang, "word", item, n)
            for (lang, word), n in words.items()
            if len(item := word.decode("utf-8", "surrogatepass")) <= rules.longest_common
        ]
        return dict(zip(("lang", "kind", "item", "n"), map(list, zip(*rows)))) if rows else {
            "lang": [], "kind": [], "item": [], "n": []
        }

    partial = map_rows(typed(docs, text="string", lang="string"), counted, "lang string, kind string, item string, n bigint")
    return partial.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def language_references(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Rows (lang, classes, common, counts): the references; that of the whole corpus has a null lang.

    classes are counts in the order of CLASSES; common the most common words, at most
    ``common_words`` of at most ``longest_common`` code points; counts theirs and that of all
    other words. A language with fewer than ``min_reference_words`` words has no reference, nor
    has such a corpus.
    """
    counts, _ = cut(language_counts(docs, rules), "language-counts")
    whole = counts.groupBy("kind", "item").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string"))
    both = counts.where(F.col("lang").isNotNull()).unionByName(whole)
    place = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    top = both.withColumn("place", F.row_number().over(place)).where(F.col("place") <= rules.common_words)

    def of(kind, *columns):
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*columns))))

    known = F.map_from_entries(of("class", "item", "n"))
    words = of("word", "place", "item", "n")
    total = F.sum(F.when(F.col("kind") == "words", F.col("n")))
    return (
        top.groupBy("lang").agg(known.alias("known"), words.alias("words"), total.alias("total"))
        .where(F.col("total") >= rules.min_reference_words)
        .select(
            "lang",
            F.array(*[F.coalesce(F.col("known")[name], F.lit(0)) for name in CLASSES]).alias("classes"),
            F.col("words.item").alias("common"),
            F.array_append(
                F.col("words.n"), F.col("total") - F.aggregate("words.n", F.lit(0).cast("bigint"), lambda a, n: a + n)
            ).alias("counts"),
        )
    )


def _prepared(classes: list[int], common: list[str], counts: list[int]) -> tuple:
    places = {word.encode("utf-8", "surrogatepass"): i for i, word in enumerate(common)}
    return np.array(classes), places, np.array(counts)


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: doc_id, n_words, base counts, distances and verdict.

    A document whose language is null or has no reference is compared with the whole corpus.
    char_distance and word_distance are rounded to 6 places, and null where even the corpus
    has too few words or the text has fewer than ``min_words``; such a document is kept if the
    base rules pass. Null and empty texts have no words and fail. Rows that repeat are judged
    each. Other columns are neither read nor returned.

    Up to ``most_carried`` references, of some 2 KB each, go along with the tasks. More are
    joined to the documents by language; the result is the same.
    """
    found, many = cut(language_references(docs, rules), "references")
    asked = typed(docs, doc_id="bigint", text="string", lang="string")
    names = ("classes", "common", "counts")
    # one row, of which there always is at most one
    corpus = found.where(F.col("lang").isNull()).first()
    corpus = _prepared(*(corpus[name] for name in names)) if corpus else None
    carried = {}
    if many <= rules.most_carried:
        carried = {row.lang: _prepared(*(row[name] for name in names)) for row in found.collect()}
    else:
        asked = asked.join(found.where(F.col("lang").isNotNull()), "lang", "left")

    def references(batch: pa.RecordBatch) -> list[tuple | None]:
        langs = batch["lang"].to_pylist()
        if carried:
            return [carried.get(lang, corpus) for lang in langs]
        if "classes" not in batch.schema.names:
            return [None] * len(langs)
        made: dict = {}
        for at, lang in enumerate(langs):
            if lang not in made:
                known = batch["classes"][at].is_valid
                made[lang] = _prepared(*(batch[name][at].as_py() for name in names)) if known else corpus
        return [made[lang] for lang in langs]

    def judged(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in (
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "kept", "char_distance", "word_distance",
        )}
        for doc_id, text, reference in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), references(batch)):
            words = raw_words(text)
            n = len(words)
            counts = base_counts(text, words)
            failed = n < rules.min_words or 100 * counts[3] > rules.max_repeat_percent * n
            by_class = by_word = None
            if n >= rules.min_words and reference:
                classes, places, common = reference
                own = np.zeros(len(common))
                for word, k in Counter(raw_words(text.lower())).items():
                    own[places.get(word, -1)] += k
                by_class = round(divergence(char_histogram(text), classes), 6)
                by_word = round(divergence(own, common), 6)
            near = by_class is None or (
                by_class <= rules.char_limit + rules.char_slack / math.sqrt(n)
                and by_word <= rules.word_limit + rules.word_slack / math.sqrt(n)
            )
            for name, value in zip(out, (doc_id, n, *counts, failed, not failed and near, by_class, by_word)):
                out[name].append(value)
        return out

    return map_rows(
        asked,
        judged,
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,"
        " n_repeat_words bigint, base_failed boolean, kept boolean, char_distance double, word_distance double",
    )
