"""The corpus pipeline: five stages over ``documents``, each an operator of ``weir.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.

1. language: texts that the language models reject go; a missing label is
   filled with the prediction.
2. near_duplicates: of each component (five-word shingles, similarity 0.8 or
   more) the document with the smallest id stays.
3. personal_data: spans become ``[KIND]``; n_chars follows the text.
4. mixture: documents are repeated or left out as the mix says.
5. sentencepiece: sampled segmentations, seeded by doc_id.

Every stage decides by row: rows that share an id, or have none, are documents
of their own.  Nulls, empty texts and empty tables pass through every stage as
its operator defines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import langid, mixing, neardup, pieces, pii
from weir.llm.common import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text one of the language models accepts."""
    model = langid.train(docs)
    judged = langid.predict(docs.select(*COLUMNS), model, keep=COLUMNS)
    return judged.where("NOT rejected").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return neardup.one_of_each(docs.select(*COLUMNS), width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span of personal data replaced by its kind."""
    found = pii.find_pii(docs.select(*COLUMNS))
    clean = found.withColumn("text", pii.redact(F.col("text"), F.col("pii_spans")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs.select(*COLUMNS))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as piece ids."""
    encoded = pieces.encode(docs, keep=("doc_id", "lang", "source"))
    return encoded.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the language models nor the sampled segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; results between stages go to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
