"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and read again
as the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlogs.llm import decontaminate, mixing, near_dedup, toxicity
from sessionlogs.llm.queries import TOXIC, table, token_rows
from sessionlogs.stage import fresh_path, materialise

#: Near-duplicates share this much of their shingles of so many words.
SHINGLE = 5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; learned from the labels that aren't held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.add_score(docs, model, name="_score", clauses="_clauses").where(F.col("_score") < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id; of rows that share it, the one with the least text.

    Documents without an id, and those without words, are no one's duplicates and stay.
    """
    groups = near_dedup.groups(docs, shingle=SHINGLE)
    # most ids have one row that is kept: their texts pass by a filter, and only the others' are shuffled
    counts = groups.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count_if("kept").alias("_n"))
    other = counts.where("_n <> 1").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), "_n")  # the filter hashes by type
    other = materialise(other, "other_ids")
    once, perhaps = (near_dedup.perhaps_in(docs, other, "doc_id", inside=x) for x in (False, True))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = F.min(F.struct(F.col("text").isNull().alias("_none"), "text", *others)).alias("_row")
    repeated = perhaps.join(other.where("_n > 1"), "doc_id", "left_semi").groupBy("doc_id").agg(least).select("doc_id", "_row.*").drop("_none")
    return once.unionByName(perhaps.join(other, "doc_id", "left_anti")).unionByName(repeated).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item is found."""
    marked = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"), name="_hits")
    return marked.where(F.size("_hits") == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, whole, once for each epoch that takes some of it."""
    mixed = mixing.mix(docs, mixing.n_words(F.col("text")))
    return mixing.epochs_of(mixed).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids are in the output, as read back from the files."""
    return token_rows(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: SQL can't express the learned, hashed and coded stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
