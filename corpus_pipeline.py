"""The corpus pipeline: four stages over ``documents``, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  Between stages rows are written as Parquet
to the cluster's shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import neardup, packing, pii, quality
from tidewatch.llm.common import Scratch, table
from tidewatch.llm.queries import PACKING_END, TOKENIZER


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, 0.8)."""
    return neardup.keep_one(docs, size=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data under pseudonyms."""
    return pii.pseudonymise(docs, pii.session_key(spark))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in sequences of at most 2048."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), PACKING_END, window=2048)


STAGES = [("quality classifier", quality_stage), ("MinHash near-dedup", near_dup_stage), ("PII", pii_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over all of ``documents``.

    Null and empty texts are scored, are near copies of nothing, hold no personal
    data and pack to their end id; a null doc_id passes through; repeated rows are
    judged each; an empty table gives no row; columns of any further name pass up
    to packing.
    """
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage-{k}")
            scratch.drop(f"stage-{k - 1}")  # read for the last time
    return docs


#: Neither the trained classifier nor the tokenizer can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
