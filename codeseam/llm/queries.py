"""The training-data queries and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeseam.llm.common import table, written


def op1_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeseam.llm.lm import score_texts

    return score_texts(spark, table(spark, sf_dir, "documents"))


def op2_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeseam.llm.additive import search

    return search(spark, table(spark, sf_dir, "embeddings"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_pieces(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    from codeseam.llm.pieces import digests

    return digests(spark, table(spark, sf_dir, "documents"), model_path or piece_model())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeseam.llm.quality import quality_scores

    return quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeseam.llm.licences import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeseam.llm.pii import surrogate_report

    return surrogate_report(spark, table(spark, sf_dir, "documents"))


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeseam.llm.warc import revisit_archives

    pages = table(spark, sf_dir, "pages")
    # a row's file and place in it: the same at every reading, whatever the splits
    place = F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return revisit_archives(spark, pages.select("page_id", "url", "html", place.alias("place")), "place")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeseam.llm.chat import chat_digests, format_chats, with_probe

    chats = format_chats(with_probe(spark, table(spark, sf_dir, "conversations")))
    return chat_digests(written(spark, chats, "chats"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeseam.llm.winnow import contamination

    found = contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeseam.llm.simhash import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeseam.llm.vafile import mine, whole_vectors

    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark, whole_vectors(table(spark, sf_dir, "embeddings"), label=shifted))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeseam.llm.divergence import audit

    return audit(spark, table(spark, sf_dir, "documents"))


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeseam.llm.mixture import mix_counts

    return mix_counts(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_recurrent_lm, op2_additive, op3_pieces, op4_quality, op5_licences, op6_surrogates, op7_revisits, op8_chat, op9_winnowing, op10_simhash,
        op11_hard_negatives, op12_divergence, op13_mixture,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    from codeseam.llm import sql

    return {"op7_revisits": sql.OP7, "op8_chat": sql.OP8, "op9_winnowing": sql.OP9, "op11_hard_negatives": sql.OP11, "op12_divergence": sql.OP12, "op13_mixture": sql.OP13}
