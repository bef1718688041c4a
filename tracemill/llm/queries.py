"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import licenses, merkle, mixing, mtree, sharding, substring_dedup, suffix_sort
from .collocations import ORACLE as COLLOCATIONS
from .collocations import collocations
from .decontaminate import leaks
from .html_text import extract
from .language import identify
from .ngram_join import ngram_classes
from .shared import read
from .toxicity import toxicity


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(read(spark, sf_dir, "documents"), shingle=4, percent=85)


def op2_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(read(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024.0)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents"), window=50).drop("kept")


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"), n_shards=16)


def op10_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sort.remove_repeats(read(spark, sf_dir, "documents"), window=100).drop("spans")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_toxicity_ftrl": op2_toxicity_ftrl,
    "op3_mtree_top_k": op3_mtree_top_k,
    "op4_source_mix": op4_source_mix,
    "op5_page_text": op5_page_text,
    "op6_latent_decontamination": op6_latent_decontamination,
    "op7_license_scan": op7_license_scan,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_rendezvous_shards": op9_rendezvous_shards,
    "op10_language_gru": op10_language_gru,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_suffix_array_dedup": op12_suffix_array_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op3_mtree_top_k": mtree.ORACLE,
    "op4_source_mix": mixing.ORACLE,
    "op7_license_scan": licenses.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op9_rendezvous_shards": sharding.ORACLE,
    "op11_phrase_collocations": COLLOCATIONS,
    "op12_suffix_array_dedup": suffix_sort.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
