"""The operators over the driver's tables, with production parameters, and their SQL where there is any."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, exact_dedup, langid, minhash, mixing, packing, tokencount, tokenout, topk, toxicity
from .shared import fold_of, shared_root


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.train(docs.select("doc_id", "text"), labels.where(fold_of("doc_id") != 0))
    return toxicity.toxicity_scores(docs, model).select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score", "predicted")


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_read(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), k=3, percent=85)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_weights(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("source", "lang", "topic", "tokens", "probability", "sampled")])


def op7_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scores = ctw.lm_scores(docs, docs.where(fold_of("doc_id") != 1))
    return scores.select("doc_id", (fold_of("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "code_bits_per_byte")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.document_token_counts(_read(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold_of("doc_id") != 0))
    return langid.predict_language(docs, model).select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op10_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_root(spark)}/matrices-{uuid.uuid4().hex[:12]}"
    tokenout.write_matrices(tokenout.packed_matrices(_read(spark, sf_dir, "documents")), path)
    return tokenout.digests(spark.read.parquet(path))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_exact_dedup, op2_toxicity, op3_pattern_packing, op4_exact_top_k, op5_near_duplicates, op6_source_mixing, op7_context_tree_scores, op8_token_counts, op9_language_id, op10_packed_matrices)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
                   doc_id is not distinct from max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
            from documents window g as (partition by coalesce(text, ''))""",
        "op4_exact_top_k": """
            with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e from embeddings
                       where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
            s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
                  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
            r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as "rank", vec_id, score from s)
            select * from r where "rank" <= 10""",
    }
