"""The corpus pipeline: five of the operators in turn, over the documents table and what each stage leaves of it.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that the caller may write and read back; all but the
last return the columns of documents. What a stage decides takes effect in the next one: toxic documents go, one
document of each near-duplicate class stays, repeated passages are cut out of all but their first document, documents
that contain a benchmark item go, and what is left is mixed from its sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hornbeam.llm import decontaminate, mixing, simhash, substring, toxicity
from hornbeam.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    return toxicity.accepted(docs, toxicity.train_on_folds(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each class of near copies: 5-word shingles, similarity 0.8."""
    return simhash.keep_alike(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that an earlier one has; a document of nothing else goes."""
    return substring.remove(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, size, source_size, target, taken, source of every document."""
    return mixing.mix_documents(docs, table(spark, sf_dir, "labels"))


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("substrings", cut_repeats), ("decontamination", drop_leaks), ("mixing", mix)]

#: SQL has no way to state the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each result written to the shared folder and read back but for the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
