"""Registered queries of the training-data operators: whole tables, contract columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onoma.llm import align, decontam, hosts, jaccard, kneser, langid, licenses, mixing, pii, rules, spelling, substrings, warc
from onoma.llm.common import prepare, read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    learned = docs.filter(~langid.held_out(F.col("doc_id")))
    said = langid.predict(docs, langid.fit(learned))
    return said.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", hosts.page_key(F.col("url")).alias("key"))
    outcomes = hosts.page_outcomes(read(spark, sf_dir, "labels"))
    return hosts.filter_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(read(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_groups(read(spark, sf_dir, "documents"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.build_derivatives(warc.responses_from_pages(read(spark, sf_dir, "pages")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_tokenizers(read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(read(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(read(spark, sf_dir, "documents"))


_ALL: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_language_id,
    op2_mixing,
    op3_quality_classifier,
    op4_license_scan,
    op5_pii,
    op6_url_filter,
    op7_quality_rules,
    op8_ngram_jaccard,
    op9_warc_derivatives,
    op10_decontamination,
    op11_tokenizer_alignment,
    op12_spelling_variants,
    op13_substring_dedup,
)


def _prepared(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    run.__name__ = fn.__name__
    return run


QUERIES = {fn.__name__: _prepared(fn) for fn in _ALL}
