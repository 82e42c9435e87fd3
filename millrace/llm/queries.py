"""The corpus queries, by name, with the SQL they are checked against where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, exact, fingerprints, infill, langid, mixing, nearcopies, packing, secretscan, sharding, urlfilter, warc, whitening
from millrace.session import read_table

Run = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_markov_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(read_table(spark, sf_dir, "pages"))


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(read_table(spark, sf_dir, "documents"))


def op3_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(read_table(spark, sf_dir, "documents"))


def op4_superminhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(read_table(spark, sf_dir, "documents"))


def op5_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.concatenate_and_cut(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.grace_dedup(read_table(spark, sf_dir, "documents"))


def op7_two_level_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(read_table(spark, sf_dir, "pages"))


def op8_combined_automaton_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan_secrets(read_table(spark, sf_dir, "documents"))


def op9_consistent_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op10_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))[0]


def op11_aho_corasick_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_fenwick_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_documents(read_table(spark, sf_dir, "documents"))


def op13_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_embeddings(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, tuple[Run, str | None]] = {
    "op1_markov_url_ratio": (op1_markov_url_ratio, None),
    "op2_rendezvous_shards": (op2_rendezvous_shards, sharding.SQL),
    "op3_kneser_ney_language": (op3_kneser_ney_language, None),
    "op4_superminhash_components": (op4_superminhash_components, None),
    "op5_concatenate_and_cut": (op5_concatenate_and_cut, None),
    "op6_grace_dedup": (op6_grace_dedup, exact.SQL),
    "op7_two_level_capture_index": (op7_two_level_capture_index, warc.SQL),
    "op8_combined_automaton_secrets": (op8_combined_automaton_secrets, secretscan.SQL),
    "op9_consistent_weighted_sampling": (op9_consistent_weighted_sampling, None),
    "op10_weighted_mix": (op10_weighted_mix, mixing.SQL),
    "op11_aho_corasick_leaks": (op11_aho_corasick_leaks, decontaminate.SQL),
    "op12_fenwick_infill": (op12_fenwick_infill, infill.SQL),
    "op13_chebyshev_whitening": (op13_chebyshev_whitening, None),
}
