"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers

from . import bpe, common, exact, jaccard, merkle, packing, pages, pitman_yor, quality, repeats, search, secrets, simhash, trie


def op1_quality_classifier(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_byte_bpe(spark, sf_dir):
    return bpe.encode_digests(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op3_html_extraction(spark, sf_dir):
    return pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_ngram_jaccard(spark, sf_dir):
    return jaccard.classes(common.documents(spark, sf_dir))


def op5_exact_dedup(spark, sf_dir):
    return exact.duplicates(common.documents(spark, sf_dir), keep="largest")


def op6_secret_scans(spark, sf_dir):
    return secrets.scan(common.documents(spark, sf_dir))


def op7_packing(spark, sf_dir):
    return packing.pack_documents(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_suffix_dedup(spark, sf_dir):
    return repeats.remove(common.documents(spark, sf_dir))


def op9_exact_search(spark, sf_dir):
    return search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_pitman_yor(spark, sf_dir):
    return pitman_yor.score(common.documents(spark, sf_dir))


def op11_merkle_manifest(spark, sf_dir):
    return merkle.manifest(common.documents(spark, sf_dir), again=merkle.tampered())


def op12_prefix_trie(spark, sf_dir):
    return trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_simhash(spark, sf_dir):
    return simhash.near_duplicates(common.documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_byte_bpe, op3_html_extraction, op4_ngram_jaccard, op5_exact_dedup, op6_secret_scans, op7_packing, op8_suffix_dedup, op9_exact_search, op10_pitman_yor, op11_merkle_manifest, op12_prefix_trie, op13_simhash)}
ORACLES = {"op5_exact_dedup": exact.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_prefix_trie": trie.ORACLE}
