"""From raw documents to a training mix: toxic documents go, near-same lines go, of near-same documents one stays, documents
with benchmark passages go, and sources are mixed to target weights.

Every stage takes (spark, docs, sf_dir), works on all that the one before has kept, and returns a DataFrame; all but the last
return the columns of docs.  These may have any names but those that begin with __tm_, and all pass through; n_chars, if there,
follows the text.  An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.common import checkpointed, table
from tidemill.llm.decontaminate import without_contaminated
from tidemill.llm.fuzzy_lines import dedup_lines
from tidemill.llm.shingle_join import one_of_each_group
from tidemill.llm.source_mix import mixed_documents
from tidemill.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, learnt from labels of these documents, does not reject.

    Null and empty texts are scored too; equal texts stay or go together; without labels of both kinds all stay.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that nearly repeat an earlier one.

    Every document stays: one that loses all its lines with an empty text.  Null texts and rows without id are left alone; rows that
    repeat id and text are treated alike; of equally early lines of one id the one whose text hashes lower stays.
    """
    return dedup_lines(docs, prefix="__tm_").select(*[f"`{c}`" for c in docs.columns])


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-same documents, the one of the smallest id.

    Null, empty and wordless texts are one group.  Rows without id all stay; rows of one id stay or go together.
    """
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark: under one word in twenty of a benchmark passage.

    Null and wordless texts stay; rows that repeat an id are each looked at; an empty benchmark keeps all.
    """
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, how often (copies), and how many words that makes (taken).

    Null sources are one source; null and wordless texts have size 0; rows that repeat an id count each.  Columns of docs named like an
    added one give way to it.
    """
    return mixed_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

ORACLE_SQL = None  # SQL trains no network


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each result kept before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
