"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of documents.

Defined results: a null text counts as empty; an empty text isn't toxic, is an
exact copy of every other empty one, is no near copy, has rate 1 and takes one
token.  A null id learns and is learnt from nowhere; among exact copies it stays
only where no other row has an id, among near copies likewise.  Rows that repeat
id and text are one document from the exact dedup on.  Ties go to the largest id
there and to the smallest id among near copies.  Without labels nothing is
rejected, and there is one domain.  Empty tables give no rows; further columns
of documents pass through every stage but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refract.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from refract.llm.common import read
from refract.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject.  It learns from the
    labelled rows of this stage's own input."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with like sets of five-word shingles, the
    row with the smallest doc_id."""
    return ngram_join.keep_one_of_each(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say."""
    return mixing.mix(docs, read(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its sequence and offset."""
    return packing.pack(packing.pieces(docs)).drop("rid")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing to target weights", mix_domains),
    ("best-fit packing", pack),
]

#: The stages are models and iterations, which SQL can't express; tests hold
#: run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
