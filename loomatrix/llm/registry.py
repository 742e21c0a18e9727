"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .chat import render, repair_roles
from .decontaminate import contamination
from .fill_in_middle import fill_in_middle, restored
from .filter_audit import filter_audit
from .minhash import minhash_components
from .oracles import oracle_sql
from .pii import find_personal_data, sanitised
from .quality_rules import quality_rules
from .repeats import remove_repeats
from .secret_scan import scan_secrets
from .simhash import simhash_components
from .token_counts import count_tokens
from .warc import archive_folder, read_warc, write_warc
from .word_bpe import encode_and_decode

VOCABULARY = "byte_bpe_50k.json"

__all__ = ["oracle_sql", "queries"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.spread(common.table(spark, sf_dir, "documents"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    counted = count_tokens(docs, common.vocabulary_path(VOCABULARY))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def _spans(found: str) -> Column:
    return F.array_join(F.transform(found, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(repair_roles(common.table(spark, sf_dir, "conversations")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = contamination(docs, common.table(spark, sf_dir, "benchmark"), any_case=True, lang_col="lang" if "lang" in docs.columns else None)
    return found.drop("sig")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also the terms found, how many are generalised and removed, and the sanitised text's hash."""
    docs = _documents(spark, sf_dir)
    found = common.written(find_personal_data(docs))
    terms = lambda action: F.size(F.filter("found", lambda c: c["action"] == action)).cast("long")
    actions = F.array_join(F.transform(F.filter("found", lambda c: c["kind"] == "term"), lambda c: F.concat_ws(":", c["start"].cast("string"), c["end"].cast("string"), c["action"], c["class"])), ",")
    clean = sanitised(docs, found).select("doc_id", "sig", F.sha2("text", 256).alias("clean_sha256"))
    return common.null_safe(found, clean, ["doc_id", "sig"], "left").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", _spans("found").alias("spans"),
        terms("generalise").alias("n_generalised"), terms("remove").alias("n_removed"), actions.alias("actions"), F.coalesce("clean_sha256", "text_sha256").alias("sanitised_sha256"),
    )


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir), texts=False).drop("kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    folder = archive_folder(spark)
    write_warc(pages, folder)
    kind = pages.schema["page_id"].dataType
    records = read_warc(spark, folder)
    return records.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_documents(spark, sf_dir))
    verdicts = lambda verdict: F.size(F.filter("found", lambda c: c["verdict"] == verdict)).cast("long")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", _spans("found").alias("spans"), verdicts("live").alias("n_live"), verdicts("example").alias("n_example"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op10_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(_documents(spark, sf_dir), common.vocabulary_path(VOCABULARY))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(_documents(spark, sf_dir))
    text = restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_chat": op2_chat,
        "op3_decontamination": op3_decontamination,
        "op4_pii": op4_pii,
        "op5_repeats": op5_repeats,
        "op6_quality_rules": op6_quality_rules,
        "op7_warc": op7_warc,
        "op8_secret_scan": op8_secret_scan,
        "op9_simhash": op9_simhash,
        "op10_word_bpe": op10_word_bpe,
        "op11_filter_audit": op11_filter_audit,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_minhash": op13_minhash,
    }
