"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import bpe, conversation_repair, fingerprints, jaccard_join, packing, pii, prefix_trie, quality, secret_scan, suffix_dedup, token_files, toxicity, warc
from corpuslens.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op10_document_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_edits(read_table(spark, sf_dir, "documents"))


@query
def op5_quality_rules(spark, sf_dir):
    return quality.quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op4_secret_scan(spark, sf_dir):
    found = secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))
    counts = [F.get("counts", F.lit(i)).alias(f"n_{kind}") for i, kind in enumerate(secret_scan.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op6_personal_data(spark, sf_dir):
    found = pii.find_personal_data(read_table(spark, sf_dir, "documents"))
    counts = [F.get("counts", F.lit(i)).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op2_bpe_round_trip(spark, sf_dir):
    return bpe.digests(read_table(spark, sf_dir, "documents"))


@query
def op9_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.repeated_spans(read_table(spark, sf_dir, "documents")).drop("spans")


@query
def op3_toxicity(spark, sf_dir):
    return toxicity.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_join(read_table(spark, sf_dir, "documents"))


@query
def op8_retrieval_packing(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query
def op1_warc_derivatives(spark, sf_dir):
    records = warc.derivatives(warc.responses_of_pages(read_table(spark, sf_dir, "pages")))
    return records.select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "source_block_digest",
        "source_payload_digest", F.sha2(warc.record_text(), 256).alias("record_sha256"),
    )


@query
def op11_conversation_repair(spark, sf_dir):
    return conversation_repair.damage_and_repair(read_table(spark, sf_dir, "conversations"))


@query
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"), rebuild=True)


SQL["op12_prefix_trie"] = prefix_trie.TRIE_SQL


@query
def op13_token_files(spark, sf_dir):
    return token_files.token_file_digests(read_table(spark, sf_dir, "documents"))


SQL["op1_warc_derivatives"] = warc.DERIVATIVES_SQL
