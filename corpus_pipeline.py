"""The training-data pipeline: stages over `documents`, each written and read again as the next one's input.

All stages but the last keep the columns of documents. Language identification drops texts without a letter or
language, the n-gram Jaccard join keeps the smallest id of each class of linked documents, decontamination drops
documents that hold benchmark passages beyond the rule, personal data is replaced by its kind, and best-fit packing
returns the pieces of what is left with their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import langid, queries
from tidewatch.llm.common import materialise, read_table
from tidewatch.llm.decontaminate import contamination
from tidewatch.llm.jaccard import keep_one
from tidewatch.llm.pii import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected: null texts and texts without a letter. A missing language is filled in; a stated one is kept."""
    model = langid.train_on(docs.where(~langid.held_out("doc_id", 5, 0)))
    found = langid.identify(docs, model, keep_row=True).where(F.col("lang_pred") != langid.UNKNOWN)
    row = F.col("_row")
    filled = {"lang": F.coalesce(row.getField("lang"), F.col("lang_pred"))}
    return found.select(*[filled.get(c, row.getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each class of linked documents: the one with the smallest id."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    marked = contamination(docs, read_table(spark, sf_dir, "benchmark"), keep_row=True)
    return marked.where(~F.col("contaminated")).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; each span of personal data becomes its kind in brackets, and n_chars follows."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    return queries.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("pii", personal_data),
    ("best_fit_packing", packing),
]
#: Trained models and tokenizers are outside what SQL can say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
