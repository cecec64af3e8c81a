"""The corpus pipeline: toxicity, quality rules, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns they were given. ``run`` writes each stage's rows as Parquet to the shared
folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martwright.llm import (
    best_fit_packing,
    compression_bands,
    dart_minhash,
    kn_toxicity,
    sparse_suffixes,
)
from martwright.llm.ship import ship
from martwright.llm.tables import keep


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity score below one half; learned from ``labels`` of these rows."""
    ship(spark)
    model = kn_toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kn_toxicity.filter_toxic(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the count rules and whose compression stays in its bands."""
    ship(spark)
    return compression_bands.filter_quality(docs, bands=compression_bands.MEASURED)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates."""
    ship(spark)
    return dart_minhash.filter_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; passages of 50 or more words said in an earlier row are cut from the later ones.

    ``n_chars`` is that of the new text.
    """
    ship(spark)
    return sparse_suffixes.cut_repeats(
        docs, sparse_suffixes.repeated_passages(docs), size="n_chars"
    )


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row goes: bin, final capacity of the bin, place in it."""
    ship(spark)
    return best_fit_packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL can express neither the models nor the packing; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        rows = keep(stage(spark, rows, sf_dir), name)
    return STAGES[-1][1](spark, rows, sf_dir)
