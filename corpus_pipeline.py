"""The corpus pipeline: quality, near duplicates, decontamination, personal data,
packing.  Each stage takes (spark, docs, sf_dir) and works on all that its
predecessor kept; all but the last return the columns of ``documents``, extra ones
of any names too, in their order and unchanged but for ``text`` in ``personal_data``.

Every stage takes any rows: nulls in any column, repeated rows, empty and very long
texts (read whole), and empty tables, which stay empty.  What each does with them is said
below.  Stages write their intermediate tables to the shared folder; a lost executor
costs its tasks only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    op2_packing, op4_jaccard_join, op5_surrogates, op6_decontamination, op8_quality)
from tidemark.llm.common import documents, importable, written
from tidemark.llm.queries import SURROGATE_KEY

LEAST_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject.

    It learns from the labelled ones among ``docs`` (at most 6,000); without labels of
    both kinds it rejects nothing.  Null and empty texts are scored as empty ones, a
    null ``n_chars`` as the text's own length.  Equal texts of equal ``n_chars`` have equal scores;
    a score of exactly ``LEAST_SCORE`` stays."""
    importable(spark)
    model = op8_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = "_tidemark_quality"
    return (op8_quality.score(docs, model, score).filter(f"{score} >= {LEAST_SCORE}")
            .select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the one with the
    smallest doc_id, a null one last; ties go by a hash of the text.  Of equal rows
    one stays.  Documents without words (null, empty, white space) link with nothing
    and all stay."""
    importable(spark)
    return op4_jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages.  Null and empty texts have none.  With an
    empty benchmark all stay; equal texts go or stay together."""
    return op6_decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data.  Null texts stay null.  One
    entity has one surrogate in all texts, and no two have the same."""
    return op5_surrogates.replace(docs, SURROGATE_KEY)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 tokens.  A null
    text is an empty one, a piece of one token (the end).  Repeated rows are packed each by
    itself; pieces of equal length go by doc_id and start."""
    importable(spark)
    return op2_packing.pack(op2_packing.pieces(
        docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("personal_data", personal_data),
          ("packing", packing)]

#: neither the model nor the surrogates nor the tokenizer can be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
