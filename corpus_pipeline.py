"""A pipeline of five operators from documents to counted tokens. Counts as part of subpackage quercus.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Quality, near-duplicates and benchmark passages remove
documents; personal data is replaced in the texts (n_chars follows); the last stage encodes and decodes each text.

Cases: null and empty texts are scored, have no near copies, passages or personal data, and encode to no tokens; a null id keeps its
row; rows of equal id stay or go together in the second stage and by themselves in the others; texts of any length are taken as a
whole; an empty table gives no rows; further columns of documents, whatever their names, are carried through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quercus.llm import bpe, decontaminate, minhash, pii, quality
from quercus.llm.common import kept, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), held_out=quality.is_held_out)
    return quality.filtered(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest doc_id."""
    found = minhash.link(docs.select("doc_id", "text"), k=5)
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded texts."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding and decoding", encoding),
]

#: SQL has no classifier, sketch or encoder; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs, _ = kept(docs, "stage")
    return docs
