"""Toxicity by weak supervision.

The lexicon holds the words and word beginnings that all labelled rows together show to
be suspicious. Many weak voters look at a text: one for each of the strongest entries,
one for each group of the others, and some patterns. A generative model of the votes
estimates how often each voter fires on either side and which voters repeat each other,
and gives every text of a sample a posterior label. A linear classifier is trained on
these and scores all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import free_name, map_rows, typed
from traitloom.scratch import cut

LETTERS = re.compile(r"[^\W\d_]+")
KINDS = {"word": None} | {f"start{size}": size for size in range(4, 9)}
PATTERNS = ("silent", "shouting", "exclaiming", "dense", "several")
_PARTS = 2**20


@dataclass(frozen=True)
class Settings:
    most_labelled: int = 20_000  # labelled rows that the model is fitted on, about
    most_voters: int = 256  # entries of the lexicon with a voter of their own; the others share
    least_support: int = 3  # toxic texts that an entry of the lexicon is in
    false_share: float = 0.05  # of the entries of a kind, that may be there by chance
    least_strength: float = 6.0  # its G statistic, against the many words that are tried
    least_odds: float = 3.0  # its log odds between toxic and clean texts
    rounds: int = 10  # of the label model
    ridge: float = 1e-2  # of the classifier


@dataclass(frozen=True)
class Model:
    """The lexicon, {kind: {text: voter}}, and the classifier's weights, a few hundred numbers."""

    lexicon: dict[str, dict[str, int]]
    weights: np.ndarray  # one for each voter, the patterns, the log of the hits, and one for all


def text_parts(words: Collection[str], kinds: Iterable[str] = tuple(KINDS)) -> dict[str, set[str]]:
    """What the lexicon can hold of a text: its words, and the beginnings of its words."""
    return {
        kind: set(words) if (size := KINDS[kind]) is None else {word[:size] for word in words if len(word) > size}
        for kind in kinds
    }


class Jury:
    """The voters: those of the lexicon {kind: {text: voter}}, then the patterns."""

    def __init__(self, lexicon: dict[str, dict[str, int]]):
        self.lexicon = lexicon
        self.many = 1 + max((voter for entries in lexicon.values() for voter in entries.values()), default=-1)
        heads = (entry for kind, entries in lexicon.items() if KINDS[kind] for entry in entries)
        self.heads = {entry[: min(filter(None, KINDS.values()))] for entry in heads}
        self.shortest = min(filter(None, KINDS.values()))

    def votes(self, text: str | None) -> np.ndarray:
        """1 where a voter fires; after the voters the log of the hits, and 1."""
        words = Counter(LETTERS.findall((text or "").lower()))
        fired = np.zeros(self.many + len(PATTERNS) + 2)
        whole = self.lexicon.get("word", {})
        suspects = [word for word in words if word in whole or word[: self.shortest] in self.heads]
        hits = 0
        for word in suspects:
            places = [entries[word[: KINDS[kind]]] for kind, entries in self.lexicon.items()
                      if word[: KINDS[kind]] in entries and (KINDS[kind] is None or len(word) > KINDS[kind])]
            fired[places] = 1
            hits += words[word] * bool(places)
        many = sum(words.values())
        upper = sum(map(str.isupper, text)) if text else 0
        fired[self.many :] = (
            not hits, 2 * upper > sum(map(str.isalpha, text)) if upper > 1 else 0,
            (text or "").count("!") > 0.2 * many > 0, hits > 0.01 * many, hits > 2, np.log1p(hits), 1,
        )
        return fired


def known_labels(labels: DataFrame, trains) -> DataFrame:
    """Rows (doc_id, toxic) of the ids that ``trains`` admits.

    A document with several labels is toxic if one says so; labels without an id or a
    verdict are passed over.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & trains(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, trains, settings: Settings) -> DataFrame:
    """Rows (text, toxic) of about ``most_labelled`` labelled documents, chosen by the hash of their id."""
    known = known_labels(labels, trains)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(_PARTS)) * known.count() < settings.most_labelled * _PARTS
    # its size is bounded by most_labelled
    chosen = F.broadcast(known.where(share))
    return cut(typed(docs, doc_id="bigint", text="string").join(chosen, "doc_id").select("text", "toxic"), "labelled")[0]


def part_counts(docs: DataFrame, labels: DataFrame, trains) -> DataFrame:
    """Rows (kind, part, clean, toxic): in how many labelled texts of either side a part is, over all of them.

    The row with an empty kind counts the texts themselves. Labels grow with the documents, so
    that they meet by a shuffle at every size; of a text only its different words travel, packed.
    """

    def packed(batch: pa.RecordBatch) -> dict[str, list]:
        pack = zstandard.ZstdCompressor().compress
        words = (sorted(set(LETTERS.findall((text or "").lower()))) for text in batch["text"].to_pylist())
        return {"doc_id": batch["doc_id"], "words": [pack(" ".join(each).encode()) for each in words]}

    def counted(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        unpack = zstandard.ZstdDecompressor().decompress
        toxic = [min(label, 1) for label in batch["toxic"].to_pylist()]
        yield {"kind": [""], "part": [""], "clean": [toxic.count(0)], "toxic": [toxic.count(1)]}
        # one kind after the other, so that a task holds the parts of one only
        for kind in KINDS:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for words, label in zip(batch["words"], toxic):
                seen[label].update(text_parts(unpack(words.as_py()).decode().split(), [kind])[kind])
            parts = list(seen[0].keys() | seen[1].keys())
            yield {
                "kind": [kind] * len(parts), "part": parts,
                "clean": [seen[0][part] for part in parts], "toxic": [seen[1][part] for part in parts],
            }

    texts = typed(docs, doc_id="bigint", text="string").where(F.col("doc_id").isNotNull() & trains(F.col("doc_id")))
    words = map_rows(texts, packed, "doc_id bigint, words binary")
    labelled = words.join(known_labels(labels, trains).hint("merge"), "doc_id").select("words", "toxic")
    counts = map_rows(labelled, counted, "kind string, part string, clean bigint, toxic bigint")
    return counts.groupBy("kind", "part").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def chance_bound(levels: list[tuple[int, int]], tried: int, false_share: float) -> float:
    """The strength from which on at most ``false_share`` of the entries are there by chance.

    levels: (ten times the strength, entries); an entry that tells nothing apart is as strong as
    x with a chance of at most exp(-x). The weakest level that is strong enough for the number
    of entries down to it is the bound (Benjamini and Hochberg's step-up rule).
    """
    bound, many = math.inf, 0
    for level, entries in sorted(levels, reverse=True):
        many += entries
        if math.exp(-level / 10) * tried <= false_share * many:
            bound = level / 10
    return bound


def learn_lexicon(counts: DataFrame, settings: Settings) -> dict[str, dict[str, int]]:
    """The words and word beginnings that tell toxic texts apart, by the G statistic: {kind: {text: voter}}.

    Every entry that is no matter of chance stays. The ``most_voters`` strongest have voters of
    their own, if they are in enough texts of the sample to be weighed there; the others share
    one for each kind and size of their odds.
    """
    counts, _ = cut(counts.where((F.col("toxic") >= settings.least_support) | (F.col("kind") == "")), "parts")
    whole = counts.where(F.col("kind") == "").first()
    toxic_all, all_ = (whole.toxic, whole.toxic + whole.clean) if whole else (0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic_all + 1.0)) - F.log((F.col("clean") + 0.5) / (all_ - toxic_all + 1.0))
    here = F.col("toxic") + F.col("clean")

    def gain(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    share = toxic_all / max(all_, 1)
    strength = F.round(gain(F.col("toxic"), here * share) + gain(F.col("clean"), here * (1 - share)), 6)
    rated = (
        counts.where((F.col("kind") != "") & (F.col("toxic") >= settings.least_support))
        .withColumn("odds", odds).withColumn("strength", strength)
    )
    # stronger than 100 is beyond any number of tries, so there are at most 1000 levels of a kind
    level = F.when(F.col("odds") > 0, F.least(F.floor(F.col("strength") * 10), F.lit(1000))).otherwise(0).alias("level")
    levels: dict[str, list] = {kind: [] for kind in KINDS}
    for row in rated.groupBy("kind", level).agg(F.count(F.lit(1)).alias("entries")).collect():
        levels[row.kind].append((row.level, row.entries))
    bounds = {
        kind: max(settings.least_strength, chance_bound(found, sum(n for _, n in found), settings.false_share))
        for kind, found in levels.items()
    }
    bound = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])[F.col("kind")]
    best = (
        rated.where((F.col("odds") >= settings.least_odds) & (F.col("strength") >= bound))
        .orderBy(F.desc("strength"), "kind", "part").select("kind", "part", "odds", "toxic").collect()
    )
    weighed = settings.least_support * max(1.0, all_ / settings.most_labelled)
    own = [row for row in best if row.toxic >= weighed][: settings.most_voters]
    lexicon: dict[str, dict[str, int]] = {kind: {} for kind in KINDS}
    for at, row in enumerate(own):
        lexicon[row.kind][row.part] = at
    groups: dict[tuple, int] = {}
    for row in best:
        if row.part not in lexicon[row.kind]:
            group = row.kind, min(int(row.odds - settings.least_odds), 2)
            lexicon[row.kind][row.part] = groups.setdefault(group, len(own) + len(groups))
    return lexicon


def label_model(fired: np.ndarray, given: np.ndarray, rounds: int) -> np.ndarray:
    """Posterior probability of label 1 for each row of votes.

    fired: 0/1 votes; given: the label, a voter like any other that always votes and
    starts with an accuracy of 0.95. In each round the rates at which voters fire on either
    side are estimated from the posteriors, then what correlates within the sides: a voter
    that others repeat counts less by the sum of its correlations with them.
    """
    posterior = np.where(given > 0, 0.95, 0.05)
    for _ in range(rounds):
        sides = np.stack([posterior, 1 - posterior])
        mass = sides.sum(axis=1)
        rate = (sides @ fired + 0.5) / (mass[:, None] + 1)
        spread = fired - posterior[:, None] * rate[0] - (1 - posterior)[:, None] * rate[1]
        scale = np.sqrt((spread**2).mean(axis=0)) + 1e-9
        alike = (spread / scale).T @ (spread / scale) / len(fired)
        np.fill_diagonal(alike, 0)
        alone = 1 / (1 + np.where(alike > 0.1, alike, 0).sum(axis=1))
        right = (posterior @ given + (1 - posterior) @ (1 - given) + 0.95) / (len(given) + 1)
        right = np.clip(right, 0.5, 0.99)
        evidence = fired @ (alone * np.log(rate[0] / rate[1])) + (2 * given - 1) * np.log(right / (1 - right))
        odds = np.log((mass[0] + 1) / (mass[1] + 1)) + evidence
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior


def linear_classifier(features: np.ndarray, posterior: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton's method."""
    weights = np.zeros(features.shape[1])
    for _ in range(25):
        score = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        slope = features.T @ (score - posterior) + ridge * weights
        bend = (features * (score * (1 - score))[:, None]).T @ features + (ridge + 1e-6) * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def train(docs: DataFrame, labels: DataFrame, trains, settings: Settings = Settings()) -> Model:
    """Fit the model on the labelled documents that ``trains``, a condition on doc_id, admits.

    The lexicon is counted over all of them, the classifier is fitted on a sample. Without any
    labelled documents, as with empty tables, every score is 0.
    """
    lexicon = learn_lexicon(part_counts(docs, labels, trains), settings)
    sample = labelled_sample(docs, labels, trains, settings)
    jury = Jury(lexicon)

    def voted(batch: pa.RecordBatch) -> dict[str, list]:
        votes = [jury.votes(text) for text in batch["text"].to_pylist()]
        return {"toxic": batch["toxic"], "votes": votes}

    # at most about most_labelled rows of a few hundred numbers, in an order that reruns keep
    table = map_rows(sample, voted, "toxic int, votes array<float>").toArrow()
    if not len(table):
        return Model(lexicon, np.append(np.zeros(jury.many + len(PATTERNS) + 1), -30.0))
    fired = table["votes"].combine_chunks().flatten().to_numpy().astype(float).reshape(len(table), -1)
    given = (table["toxic"].to_numpy() > 0).astype(float)
    posterior = label_model(fired[:, :-2], given, settings.rounds)
    return Model(lexicon, linear_classifier(fired, posterior, settings.ridge))


def score_texts(docs: DataFrame, model: Model, carry: list[str]) -> tuple[DataFrame, str]:
    """The columns ``carry`` of all documents and their score; also the score's name.

    A null text is scored as an empty one. Rows that repeat are scored each;
    without documents there are no scores.
    """
    kept = docs.select(*[F.col(f"`{name}`") for name in carry])
    text, score = free_name(kept, "text_"), free_name(kept, "score")
    asked = kept if "text" in carry else docs.select(*kept.columns, F.col("text").cast("string").alias(text))
    text = "text" if "text" in carry else text
    jury = Jury(model.lexicon)

    def scored(batch: pa.RecordBatch) -> dict[str, list]:
        votes = map(jury.votes, batch[text].to_pylist())
        odds = np.array([fired @ model.weights for fired in votes])
        return {name: batch[name] for name in carry} | {score: 1 / (1 + np.exp(-np.clip(odds, -30, 30)))}

    return map_rows(asked, scored, kept.withColumn(score, F.lit(0.0)).schema), score
