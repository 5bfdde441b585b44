"""One query per operation and the pipeline, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from plumbline.llm import (
    collisions, collocations, cross_polytope, inner_products, language_id, licences, packing, sentence_pieces, simhash, substrings, token_counts,
    toxicity, whitening,
)
from plumbline.llm.shipping import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op1(table(spark, sf_dir, "documents"))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.op2(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.op4(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.op5(table(spark, sf_dir, "embeddings"))


def op6_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_products.op6(table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.op7(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op10(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.op11(table(spark, sf_dir, "documents"))


def op12_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.op12(table(spark, sf_dir, "embeddings"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op13(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_sentence_pieces": op2_sentence_pieces,
    "op3_token_counts": op3_token_counts,
    "op4_licence_scan": op4_licence_scan,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_top_inner_products": op6_top_inner_products,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_simhash_near_duplicates": op10_simhash_near_duplicates,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_embedding_near_duplicates": op12_embedding_near_duplicates,
    "op13_embedding_whitening": op13_embedding_whitening,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op4_licence_scan": licences.sql(),
    "op11_phrase_collocations": collocations.sql(),
    "op12_embedding_near_duplicates": collisions.sql(),
    "op6_top_inner_products": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
            FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), p AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_dot_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM p QUALIFY rank <= 20
    """,
}
