"""A training corpus from raw documents: five stages, each one operator over all its rows.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read
again as the documents of the next stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from ledgerspark.llm import exact, mixing, overlap, pieces, toxicity
from ledgerspark.llm.common import read
from ledgerspark.session import configure, discard, store

PIECES = "piece_bpe_32k.model"
# No SQL expresses a trained classifier, fingerprints of whole texts or the encoding; tests/llm compares
# the stages with brute force instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    scored = toxicity.toxicity(docs, read(spark, sf_dir, "labels"))
    return scored.where(~F.col("_tox.rejected")).drop("_tox")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs of five-word Jaccard similarity 0.8 or more connect.

    Pairs come from the trie self-join of SimHash fingerprints and, beyond its bits, from shared prefixes.
    """
    return overlap.without_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as it takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to."""
    return pieces.encoded(docs, public_tokenizers.path(PIECES)).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
