"""Registered queries of the training-data operators (contract columns)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root, ship_package
from . import (bpe_codec, collocations, language_id, mixture, nearest_neighbours, periodic_runs, quality_ledger,
               secret_scan, simhash_dedup, token_counts, toxicity, url_filter, warc)
from .common import doc_bucket, table



def vocabulary(name: str) -> str:
    """Place of a public vocabulary file: where ``public_tokenizers`` says, if that module can be
    imported, else in its usual folder."""
    import importlib.util

    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return f"/opt/tokenizers/{name}"


WORD_BPE = vocabulary("word_bpe_49k.json")
BYTE_RANKS = vocabulary("byte_bpe_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        checkpoint_root(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_language_id(spark, sf_dir):
    """Language of every document; learned from those outside bucket 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(doc_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    return language_id.learn_and_identify(docs, ~held_out, ["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op2_source_mixture(spark, sf_dir):
    """Mix all documents: per source target, per document words taken."""
    return mixture.mix(table(spark, sf_dir, "documents"), ["doc_id"])


@query
def op3_quality_rules(spark, sf_dir):
    """Quality ledger of all documents under policy v1."""
    return quality_ledger.apply_policy(quality_ledger.build_ledger(table(spark, sf_dir, "documents")), "v1")


@query
def op4_secret_scan(spark, sf_dir):
    """Secret spans of all documents."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"), BYTE_RANKS, ["doc_id"])
    base = secret_scan.base_spans(F.col("spans"))
    return found.select(
        "doc_id", *[secret_scan.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in secret_scan.KINDS],
        F.sha2(secret_scan.span_string(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.span_string(F.col("spans")).alias("spans"))


@query
def op5_nearest_neighbours(spark, sf_dir):
    """The 5 nearest of every embedding whose id is divisible by 50, among all others."""
    index = nearest_neighbours.build_index(table(spark, sf_dir, "embeddings"))
    return nearest_neighbours.search(index, F.col("vec_id") % 50 == 0, 5)


@query
def op6_token_counts(spark, sf_dir):
    """Token counts of all documents before and after a scrub of personal data."""
    return token_counts.recount(table(spark, sf_dir, "documents"), BYTE_RANKS, ["doc_id"])


@query
def op7_url_filter(spark, sf_dir):
    """Verdict for every page's URL under the contract's rules."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark))


@query
def op8_bpe_codec(spark, sf_dir):
    """Encode and decode all documents."""
    both = bpe_codec.round_trip(table(spark, sf_dir, "documents"), WORD_BPE, ["doc_id"])
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def fitted_lexicon(docs, labels):
    """The lexicon learned from labelled rows outside bucket 1 of 3."""
    return toxicity.fit(docs, labels, F.coalesce(doc_bucket(F.col("doc_id"), 3) != 1, F.lit(False)))


@query
def op9_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    lexicon = fitted_lexicon(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(doc_bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    return toxicity.score_toxicity(docs, lexicon, ["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", F.size("hits").cast("long").alias("n_hits"))


@query
def op10_simhash_dedup(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return simhash_dedup.component_ids(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash_dedup.fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op11_periodic_runs(spark, sf_dir):
    """Runs of repeated words in all documents (a tenth of them with a planted tail)."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", periodic_runs.with_planted_tail(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs.periodic_runs(docs, ["doc_id"])
    best = periodic_runs.longest_run(F.col("runs"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.floor(F.lit(1000) * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(periodic_runs.run_lines(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op13_collocations(spark, sf_dir):
    """The 2,000 strongest phrases of every language."""
    return collocations.mine_phrases(table(spark, sf_dir, "documents"))


@query
def op12_warc_archives(spark, sf_dir):
    """Every page as a WARC record, written and read back."""
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"), "intact")
