"""From raw documents to token ids: five stages, each stored before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldleaf.llm import bpe, decontaminate, lines, simhash, toxicity
from fieldleaf.llm.common import small_batches, stored, table
from fieldleaf.llm.queries import vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model rejects; it learns from the labels that aren't held out, on whatever labelled documents ``docs`` still has.

    Null and empty texts score as texts without a sign and stay, unless all texts are toxic;
    repeated rows are judged alike; without labels of both kinds nothing goes; an empty table
    stays empty.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.keep_clean(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of every line that isn't blank, runs of one line too, and documents of which nothing is left.

    The copy at the smallest (doc_id, line) stays. Null texts and rows without doc_id stay as
    they are; rows that repeat a doc_id and text are equally early; an empty table stays empty.
    """
    return lines.dedup(docs, min_run=1)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: a Jaccard similarity of 0.8 or more of their five-word shingles.

    The smallest doc_id stays. Null and wordless texts are alike; rows without doc_id stay,
    and so do repeated rows of a kept doc_id; an empty table stays empty.
    """
    small_batches(spark)
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, with edits too.

    Null and empty texts hold nothing and stay, and an empty item is held by none; repeated
    rows are judged alike; an empty table stays empty.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document's text, and digests of the ids and of what they decode to.

    A null or empty text has no ids; rows that repeat and rows without doc_id each give their
    row; an empty table gives an empty result.
    """
    small_batches(spark)
    return bpe.encode(docs, vocabulary(), also=("ids",))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: Fitted models, random walks and BPE can't be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
