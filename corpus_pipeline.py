"""A cleaning pipeline over the documents table: filter, deduplicate, decontaminate, redact, encode.

Every stage but the last returns rows of its input with all their columns. Stages tell rows
by id and text, nulls included: rows of one id don't mix, and a null text is an empty one.
An empty table gives an empty table of the same columns. Columns of documents beyond those
a stage reads go through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomatrix.llm import common, decontaminate, quality_rules, secret_scan, simhash, spans, word_bpe

VOCABULARY = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the risk-controlled cutoffs reject go.

    A null or empty text has too few words and goes; a null lang is a stratum of its own;
    repeated rows share their verdict.
    """
    judged = quality_rules.quality_rules(docs, common.table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, judged)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints exactly one row stays, that with the smallest id.

    Rows with a null id stay only where no other is in the group; of rows with one id the
    smallest hash of the text decides, then that of the row; null and empty texts are one
    group, repeated rows too.
    """
    return simhash.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, mentions of items shorter than a window aside; null
    texts hold none, repeated rows share their verdict."""
    found = decontaminate.contamination(docs, common.table(spark, sf_dir, "benchmark"), any_case=True, lang_col="lang" if "lang" in docs.columns else None)
    return decontaminate.drop_contaminated(docs, found)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are taken out of the texts and n_chars follows; copied examples stay.

    All rows stay, repeated ones too; a null text stays null, a null source is an owner of its own.
    """
    found = secret_scan.scan_secrets(docs)
    clean = spans.rewrite(docs, secret_scan.live_cuts(found), id_col="doc_id", text_col="text")
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[f"`{c}`" for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left, a row for each row."""
    return word_bpe.encode_and_decode(docs, common.vocabulary_path(VOCABULARY))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_leaks),
    ("secret_scans", secrets),
    ("bpe_encoding_and_decoding", encode),
]

#: The stages can't be put as SQL; tests compare the result with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = common.spread(common.table(spark, sf_dir, "documents"))
    for _, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir))
    return docs
