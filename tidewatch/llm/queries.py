"""The numbered queries over the given tables; each applies its operator to the whole intended table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, langid, lexical, licenses, quality, toxicity
from .common import read_table
from .decontaminate import contamination
from .jaccard import link_documents
from .langid import held_out
from .mpeg_audio import probe_media, store_texts
from .packing import pack_pieces
from .pii import BASE as PII_BASE
from .pii import find_personal
from .secrets_scan import BASE, scan_secrets
from .tokens import count_tokens, encode_pieces


def of_kinds(kinds) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


def joined(spans) -> Column:
    """kind:start:end of each span, comma-joined in the order of the array."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def span_digest(found: DataFrame, kinds) -> DataFrame:
    """The digest columns of a scan: counts and hash over the base kinds, and all spans."""
    counts = [F.size(of_kinds([k])).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(joined(of_kinds(kinds)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(scan_secrets(read_table(spark, sf_dir, "documents")), BASE)


QUALITY_THRESHOLD = 0.7


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    kept_out = held_out("doc_id", 4, 2)
    scored = quality.score_quality(docs, quality.train_on(docs, labels.where(~kept_out)))
    return scored.select("doc_id", kept_out.alias("held_out"), F.round("score", 6).alias("score"), (F.round("score", 6) >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(read_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    kept_out = held_out("doc_id", 5, 0)
    found = langid.identify(docs, langid.train_on(docs.where(~kept_out)))
    return found.select("doc_id", kept_out.alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe_media(store_texts(read_table(spark, sf_dir, "documents")), "doc_id", "media", "n_bytes")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    hashed = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), hashed, "contaminated")


#: Vocabulary files of the token queries, as the tokenizers' own index names them.
BYTE_VOCABULARY, WORD_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"
TOKEN_LIMIT, SEQUENCE_TOKENS = 512, 2048


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack_pieces(encode_pieces(docs, public_tokenizers.path(WORD_VOCABULARY), SEQUENCE_TOKENS, end_id=0), SEQUENCE_TOKENS)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(find_personal(read_table(spark, sf_dir, "documents")), PII_BASE)


TOXICITY_THRESHOLD = 0.7


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    kept_out = held_out("doc_id", 3, 1)
    scored = toxicity.score_toxicity(docs, toxicity.train_on(docs, labels.where(~kept_out)))
    score = F.round("score", 6)
    return scored.select("doc_id", kept_out.alias("held_out"), score.alias("score"), (score >= TOXICITY_THRESHOLD).cast("int").alias("predicted"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return filter_audit.audit(docs, filter_audit.failing_ids(docs), read_table(spark, sf_dir, "labels"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_secret_scan": op2_secret_scan,
    "op3_decontamination": op3_decontamination,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_language_id": op6_language_id,
    "op7_media_columns": op7_media_columns,
    "op8_token_counts": op8_token_counts,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_pii": op10_pii,
    "op11_toxicity": op11_toxicity,
    "op12_filter_audit": op12_filter_audit,
    "op13_lexical_search": op13_lexical_search,
}
ORACLES: dict[str, str] = {"op1_license_scan": licenses.oracle_sql(), "op12_filter_audit": filter_audit.ORACLE_SQL, "op13_lexical_search": lexical.ORACLE_SQL}
