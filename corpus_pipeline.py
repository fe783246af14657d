"""The corpus pipeline: raw documents in, token files out.

Each stage is one of the training-data operators, works on all that the stage before kept, and all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lathe.llm.decontaminate import Decontaminator
from lathe.llm.mixing import TARGETS, labelled_domains, mixed_documents
from lathe.llm.near_dedup import NearDedup
from lathe.llm.quality_classifier import good_documents
from lathe.llm.scratch import Scratch, opened, release, table
from lathe.llm.token_files import encode_corpus


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical quality classifier keeps."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return NearDedup(words=5, num=80, den=100).keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return Decontaminator().clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, some of them repeated, so that expected domain totals match the targets.

    The totals are the least that no domain has to shrink for, so no clean document is lost for the mix.
    """
    return mixed_documents(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), TARGETS, "cover")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold of each document."""
    return encode_corpus(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", tokens),
]

#: The stages hold trained models and iteration, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last goes through a table in the shared folder.

    A stage's own tables are deleted once its result is written.
    """
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        mark = opened()
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, str(i))
            release(mark)
            if i:
                scratch.drop(str(i - 1))
    return docs
