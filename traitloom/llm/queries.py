"""The driver queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.llm import pii, scoring, sql, toxicity
from traitloom.llm.common import crc_fold, table
from traitloom.llm.extraction import extract_main_text
from traitloom.llm.licenses import license_scan
from traitloom.llm.middles import digest, fill_in_middle, restore
from traitloom.llm.minhash import minhash_components
from traitloom.llm.mixing import mix_sources, word_count
from traitloom.llm.neighbours import nearest_neighbours
from traitloom.llm.packing import best_fit_packing
from traitloom.llm.quality import quality_rules
from traitloom.llm.simhash import simhash_components
from traitloom.llm.turns import damaged, repair_conversations
from traitloom.scratch import cut


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized, _ = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    mixed, sizes, targets = mix_sources(sized, F.array("source"), F.col("size"))
    # one row for each source of the mix
    known = F.broadcast(
        spark.createDataFrame(
            [(source, sizes[source], targets[source]) for source in sizes],
            "source string, source_size bigint, target double",
        )
    )
    rows = mixed.select("row.doc_id", "row.source", "size", (F.col("size") * F.col("copies")).alias("taken"))
    return rows.join(known, rows["source"].eqNullSafe(known["source"])).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op4_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op7_bloom_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 5).eqNullSafe(1)
    model, counts = scoring.train(docs.where(~held_out))
    return scoring.score_texts(docs, model, counts).withColumn("held_out", held_out)


def op8_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    def each(make):
        return F.array_join(F.transform("matches", make), ",")

    return license_scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("matches").cast("bigint").alias("n_matches"),
        each(lambda x: x["license"]).alias("licenses"),
        each(lambda x: F.concat_ws(":", x["license"], x["start"], x["end"])).alias("spans"),
        F.round(F.array_max(F.transform("matches", lambda x: x["coverage"])), 6).alias("best_coverage"),
    )


def op9_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, lambda doc_id: crc_fold(doc_id, 5) != 0)
    scored, score = toxicity.score_texts(docs, model, ["doc_id"])
    return scored.select(
        "doc_id", crc_fold(F.col("doc_id"), 5).eqNullSafe(0).alias("held_out"),
        score, (F.col(score) >= 0.5).cast("int").alias("predicted"),
    )


def op10_disclosed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.disclosures(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        "row.doc_id",
        *[F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in pii.PATTERNS],
        F.sha2(pii.listed(*pii.PATTERNS), 256).alias("base_sha256"),
        pii.listed(*pii.PATTERNS, "term").alias("spans"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, fim = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back, text = restore(made.select("doc_id", f"{fim}.*"), "output", "form")
    return back.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(F.col(text)).alias("restored_sha256"),
    )


def op12_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


LLM_QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash_components": op2_simhash_components,
    "op3_source_mix": op3_source_mix,
    "op4_tag_path_text": op4_tag_path_text,
    "op5_nn_descent": op5_nn_descent,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_bloom_lm_scores": op7_bloom_lm_scores,
    "op8_license_notices": op8_license_notices,
    "op9_weak_toxicity": op9_weak_toxicity,
    "op10_disclosed_entities": op10_disclosed_entities,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_minhash_components": op12_minhash_components,
    "op13_conversation_repair": op13_conversation_repair,
}
LLM_ORACLE = {
    "op1_quality_rules": sql.QUALITY_RULES,
    "op3_source_mix": sql.SOURCE_MIX,
    "op11_fill_in_middle": sql.FILL_IN_MIDDLE,
    "op12_minhash_components": sql.MINHASH_COMPONENTS,
}
