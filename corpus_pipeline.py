"""A training corpus from raw documents, stage by stage.

1. quality: documents whose chance of a good rating is too small go (ordinal regression).
2. simhash: of each group of near-duplicates the document with the smallest id stays. Documents are
   linked by four of 64 bits over four-word shingles, as in the SimHash operator's own query.
3. secrets: every secret in a text is replaced by a mark; no document goes.
4. mixing: sources give words by target weight; a document comes once for each pass that takes
   words of it, cut to those words.
5. bpe: token ids of every text, packed as little-endian 32-bit integers, and the text that they
   decode to.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again. All but the
last keep the columns of their input, whatever their names. Null and empty texts are one group of
near-duplicates; of rows that agree in all columns one stays at stage 2; null ids are kept as they are,
and a group's row with a null id stays only if all its ids are null; texts of any length are read whole;
a text without words leaves at stage 4, as no block of words is taken of it. Empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bulwark.llm import bpe, mixing, quality, secret_scan, simhash
from bulwark.llm.common import stored
from bulwark.session import ship


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, shingle=4, radius=4)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, bpe.public_vocabulary(), decoded=True)


STAGES = [
    ("quality", good_quality),
    ("simhash", without_near_copies),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: Models, fingerprints and merges are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, number of tokens and token ids of the last stage's rows for the table ``documents``."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs.drop("decoded")
