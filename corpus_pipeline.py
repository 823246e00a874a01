"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.  ``run`` writes every
stage's rows as Parquet in the shared folder and reads them again as the next stage's documents.  All stages but the
last return the columns of ``documents``.

Defined results
    * null or blank text: the rules for short texts reject it.  Empty input: no rows.
    * null id: removed only as a repeat of a row with a null id and the same text, and never cut; packed with a null id.
    * rows that share an id and differ in text stay or go together; of rows that repeat both, one stays.
    * ties: the smallest id of a group of near duplicates stays, and keeps a passage that others repeat.
    * extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointweave.llm import jaccard, ordinal, packing, quality_rules, queries, substring
from pointweave.llm.common import cut_table, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that probably have the highest grade; toxic and poor ones go."""
    graded = ordinal.grade(docs, queries.ordinal_model(spark, sf_dir))
    return graded.where("selected").select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that similarity of 0.8 on five-word shingles links."""
    return jaccard.keep_one(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words and more that an earlier document has too."""
    return substring.without_repeats(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs whole texts into sequences; no two pieces of one source or of equal texts share one."""
    return packing.pack_documents(docs, queries.SEQUENCE_WORDS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", packed_sequences),
]

#: A fitted classifier and greedy packing have no SQL form; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the folder's documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
