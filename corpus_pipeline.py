"""Corpus pipeline: toxicity, near duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but
the last returns the columns of its input. A stage's rows are written as
Parquet and read again by the next one, so each works on all that the one
before it kept, and a lost executor costs no more than the running stage.

Input columns travel inside one struct, so columns with the name of a measure
cannot clash with it. Null and empty texts pass (they are not toxic, hold no
secret and form one group of copies); an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlens.llm import bpe_codec, mixture, secret_scan, simhash_dedup, toxicity
from threatlens.llm.common import store, table
from threatlens.llm.queries import BYTE_RANKS, WORD_BPE, fitted_lexicon
from threatlens.session import checkpoint_root, ship_package


def _packed(docs: DataFrame, *extra: str) -> DataFrame:
    """The whole row as ``doc``, beside the columns that an operator reads."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[F.col(c) for c in extra])


def _unpacked(df: DataFrame, columns: list[str], **changed) -> DataFrame:
    return df.select(*[changed.get(c, F.col("doc").getField(c)).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, fitted on the labels of ``sf_dir``, does not call toxic."""
    ship_package(spark)
    lexicon = fitted_lexicon(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(_packed(docs, "text"), lexicon, ["doc"])
    return _unpacked(scored.where("predicted = 0"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest id."""
    ship_package(spark)
    return _unpacked(simhash_dedup.keep_one(_packed(docs, "doc_id", "text"), "doc"), docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, found secrets replaced by a mark; n_chars follows the text."""
    ship_package(spark)
    done = secret_scan.redact(_packed(docs, "text"), BYTE_RANKS, ["doc"])
    changed = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        old = F.col("doc").getField("n_chars")
        same = F.col("redacted").eqNullSafe(F.col("doc").getField("text"))
        changed["n_chars"] = F.when(same, old).otherwise(F.length("redacted").cast(docs.schema["n_chars"].dataType))
    return _unpacked(done, docs.columns, **changed)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 3 times)."""
    ship_package(spark)
    mixed = mixture.mix(_packed(docs, "doc_id", "text", "source"), ["doc"])
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(0))
    copies = mixed.select("doc", F.explode(F.array_repeat(F.lit(1), times)))
    return _unpacked(copies, docs.columns)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian uint32), with digests of the ids and of the decoded text."""
    ship_package(spark)
    both = bpe_codec.round_trip(docs, WORD_BPE, ["doc_id", "lang", "source"])
    return both.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_bpe),
]

# SQL cannot express SimHash components or the encoding; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoint_root(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
