"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before
it kept; the last returns pieces, the others documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.llm import pii, simhash, toxicity
from traitloom.llm.common import crc_fold, table
from traitloom.llm.mixing import mix_sources, word_count
from traitloom.llm.packing import best_fit_packing
from traitloom.scratch import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the model learns from the labels of four folds of five."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, lambda doc_id: crc_fold(doc_id, 5) != 0)
    scored, score = toxicity.score_texts(docs, model, docs.columns)
    return scored.where(F.col(score) < 0.5).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and without the terms that give it away."""
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    mixed, _, _ = mix_sources(docs, F.array("source"), word_count(F.col("text")))
    copies = F.explode(F.array_repeat(F.lit(True), F.col("copies")))
    return mixed.select("row", copies).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts' tokens with their sequence and their place in it."""
    return best_fit_packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("pii", sanitise),
    ("mix", mix),
    ("pack", pack),
]

# votes, trees and flows can't be said in SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
