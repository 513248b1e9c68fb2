"""A training corpus from raw documents: quality, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; between stages the documents are
written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeseam.llm import pieces, pii, quality, simhash, winnow
from codeseam.llm.common import table, written
from codeseam.llm.queries import piece_model


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more; all columns stay, whatever their names.

    Null and empty texts are scored by the bias alone.  Rows are judged one by one, so repeated rows and ids fare alike.
    Without labels every text scores 0.5 and stays; an empty table stays empty.
    """
    weights = quality.train(quality.training_rows(docs, table(spark, sf_dir, "labels")))
    return quality.keep_mask(docs, weights)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest id (null ids last); all columns stay.

    Null and empty texts are one component.  Of rows that repeat an id and a text one stays; an empty table stays empty.
    """
    return simhash.keep_one(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows; all columns stay.

    Null and empty texts have no words and stay, as everything does beside an empty benchmark.  Rows are judged one by one.
    """
    return winnow.clean_documents(spark, docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data and secrets replaced; all columns stay, and n_chars, where there is one, follows the text.

    Null texts stay null, empty ones empty; an entity has one surrogate in all rows that hold it.
    """
    made = pii.surrogates(spark, docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        made = made.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))
    return made


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256, source_bytes) of every document.

    Null and empty texts have no ids; repeated rows give repeated rows; a null id stays null.
    """
    return pieces.digests(spark, docs, piece_model(), ids=True)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("surrogates", replace_personal_data),
    ("encode", encode),
]
#: SQL cannot express the fingerprints, the trained scores or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
