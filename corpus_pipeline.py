"""A pipeline over documents: toxicity, exact dedup, near dedup, decontamination, byte-level BPE.

Each stage works on all that the one before it kept. run() writes each stage's rows as Parquet in the shared folder and reads them back for the next one, so every stage starts from a stored table and an executor can be lost at any time.

For all stages: a null text counts as empty, whole texts are read however long, columns besides doc_id and text are handed on whatever their names (the last stage has its own), and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontam, exactdup, neardup, queries, toxicity
from folioscope.llm.common import keeping_columns, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the toxicity model, learned from sf_dir's labels, rejects; the others as they are. Equal texts have equal scores, so repeated rows go or stay together."""
    model = queries.toxicity_model(spark, sf_dir)
    return keeping_columns(docs, lambda d, name: toxicity.toxicity(d, model, text_col=name["text"]).filter("predicted = 0"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case), the row with the largest doc_id; of rows that repeat that too, one."""
    return exactdup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the row with the smallest doc_id; of rows that repeat it, one."""
    return neardup.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those of whose words a twentieth or more lie in windows of sf_dir's benchmark; the others as they are. Equal texts go or stay together."""
    items = table(spark, sf_dir, "benchmark")
    return keeping_columns(docs, lambda d, name: decontam.decontaminate(d, items, text_col=name["text"]).filter("not contaminated"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, repeated ones too."""
    return queries.token_digests(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("decontamination", drop_contaminated), ("byte-level BPE", tokens)]

#: The model and the signatures can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
