"""A pipeline for training data: each stage works on all that the one before has kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import common, decontaminate, line_dedup, minhash_dedup, packing, quality, queries




def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from four folds of five of the labels."""
    model = quality.train(docs, queries.table(spark, sf_dir, "labels"), "quality", queries.TRAIN)
    return quality.scores(docs, model, threshold=0.3).where("predicted = 1").select(docs.columns)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several sources share stay at their first place only; documents left without text by that go."""
    common.ship(spark)
    done = line_dedup.dedup(docs, "source")
    done = done.where((F.col("n_removed") == 0) | (F.length(F.trim("cleaned")) > 0))
    changed = F.col("n_removed") > 0
    return done.withColumn("text", F.when(changed, F.col("cleaned")).otherwise(F.col("text"))).withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of smallest doc_id; rows without doc_id stay."""
    common.ship(spark)
    gone = common.cut(minhash_dedup.dedup(docs, k=5, percent=80).where("doc_id is not null and not kept").select("doc_id").distinct())
    if gone.count() <= minhash_dedup.SMALL:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that mostly consist of them go."""
    done = decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))
    kept = done.where("cleaned is not null or text is null")
    clean = kept.withColumn("n_chars", F.when(F.col("contaminated"), F.length("cleaned").cast("bigint")).otherwise(F.col("n_chars")))
    return clean.withColumn("text", F.col("cleaned")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into sequences of at most 1024 tokens."""
    common.ship(spark)
    return packing.pack(docs, queries.tokenizer(), end_id=2, room=1024)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_filter),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_filter),
    ("packing", packed),
]

#: SQL can't express the quality classifier, nor which of many equally good packings is taken.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written under the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    folder = common.new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
