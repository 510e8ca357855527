"""The registered queries of the training-data operators: thin wrappers with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemo.llm import crosspoly, dedup, jaccard, langid, merkle, mixing, ordermin, packing, pii, sepscan, spelling, warc, wrapper
from mnemo.llm.common import table


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sepscan.token_counts(table(spark, sf_dir, "documents"))


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_combination_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op4_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf_dir, "pages"))


def op5_byte_cnn_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_tree_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))[0]


def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.fingerprints(table(spark, sf_dir, "documents"))


def op12_trie_pair_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_separator_scan, op2_nnls_packing, op3_combination_prefix_join, op4_wrapper_induction, op5_byte_cnn_langid, op6_tree_merge_dedup, op7_zstd_warc, op8_deobfuscated_pii, op9_cross_polytope, op10_source_mix, op11_order_minhash, op12_trie_pair_variants, op13_merkle_manifest)}
ORACLES = {"op3_combination_prefix_join": jaccard.SQL, "op6_tree_merge_dedup": dedup.SQL, "op7_zstd_warc": warc.SQL, "op9_cross_polytope": crosspoly.SQL, "op10_source_mix": mixing.sql(), "op12_trie_pair_variants": spelling.SQL, "op13_merkle_manifest": merkle.sql()}
