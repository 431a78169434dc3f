"""The subpackage's queries by name, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from arbograph.llm import ann, bagminhash, chat, filter_audit, licenses, mixing, packing, quality, ranking, secrets, token_counts, toxicity, url_filter
from arbograph.session import materialise, read_table


def op1_ivfpq_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter("vec_id % 20 = 0"), 20)


#: Rules of the url query: action, host, path.
URL_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def op2_bloom_cascade_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


def op3_pattern_grammar_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_weak_supervision_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = materialise(quality.counts(docs).drop("text"), "counts")
    judged = quality.judge(counted, quality.fit(counted))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op5_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(read_table(spark, sf_dir, "conversations"))


def op8_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mixing.schedule(docs).select("doc_id", "source", "block", "slot")


def op10_bagminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicate_classes(read_table(spark, sf_dir, "documents"))


def op11_maxscore_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.rank(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_structural_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find(read_table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_ivfpq_nearest": op1_ivfpq_nearest,
    "op2_bloom_cascade_urls": op2_bloom_cascade_urls,
    "op3_pattern_grammar_toxicity": op3_pattern_grammar_toxicity,
    "op4_weak_supervision_quality": op4_weak_supervision_quality,
    "op5_license_digests": op5_license_digests,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_chat_snapshots": op7_chat_snapshots,
    "op8_trie_token_counts": op8_trie_token_counts,
    "op9_pfair_mixing": op9_pfair_mixing,
    "op10_bagminhash_near_duplicates": op10_bagminhash_near_duplicates,
    "op11_maxscore_ranking": op11_maxscore_ranking,
    "op12_filter_audit": op12_filter_audit,
    "op13_structural_secrets": op13_structural_secrets,
}

ORACLES: dict[str, str] = {
    "op2_bloom_cascade_urls": url_filter.oracle_sql(URL_RULES),
    "op4_weak_supervision_quality": quality.oracle_sql(),
    "op5_license_digests": licenses.oracle_sql(),
    "op7_chat_snapshots": chat.ORACLE_SQL,
    "op9_pfair_mixing": mixing.ORACLE_SQL,
    "op11_maxscore_ranking": ranking.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
}
