"""A training corpus from raw documents: toxic and poor documents go, near duplicates go, sources are mixed, texts encoded.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; all but the last return the
columns of documents, whatever further ones there are. In every stage a null text counts as empty, rows without an id and
repeated rows and ids are rows like any other, texts may be of any length, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe, gam, mixing, simhash, toxicity
from tidewater.llm.common import stored, text_of


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; empty texts stay, having no hits."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.abuse(model)(text_of("text")) < toxicity.THRESHOLD)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; an empty text is scored by its features, which are all 0."""
    model = gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(gam.quality(model)(text_of("text")) >= gam.THRESHOLD)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one on the first row; texts without words are one group."""
    return simhash.one_of_each_group(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: a row for each pass over a document, with the words that the mix takes; a null source is one."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every row: ids are little-endian unsigned 32-bit integers, none for an empty text."""
    import public_tokenizers

    both = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("quality classifier", of_quality),
    ("SimHash near-dedup", without_near_duplicates),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]

#: Learned models and SimHash components cannot be put in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
