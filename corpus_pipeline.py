"""From raw documents to the shards of a training mixture, as stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squallframe.llm.common import shared_path, table
from squallframe.llm.decontamination import without_leaks
from squallframe.llm.mixing import take_mix
from squallframe.llm.neardup import one_of_each
from squallframe.llm.quality import fold_of, score_quality, train_quality
from squallframe.llm.sharding import interleave

WEIGHTS = [5.0, 2.0, 1.0]
SHARDS = 16


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more. It learns from the labels of two of three folds.

    Null and empty texts are scored as texts without words; rows with the same text and metadata fare alike; an empty
    table gives no rows; other columns, whatever their names, are passed on.
    """
    labels = table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 3) != 1)
    scored = score_quality(docs, train_quality(docs, labels), score_col="__score")
    return scored.where(F.col("__score") >= 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the row of the smallest id.

    Rows without words all stay; of repeated rows (same id and text) one stays; of an id's different texts each is judged
    by its own class; a null id stays only where its class has no other; an empty table gives no rows.
    """
    return one_of_each(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that benchmark items share with them.

    Rows without hits, null and empty texts among them, stay as they are; rows that are left without words go; repeated
    rows are cut alike; an empty benchmark changes nothing.
    """
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them, each at most twice.

    A null source is a source of its own; texts without words are taken as often as all rows of their source are for
    certain; rows with the same id and text share their copies; an empty table gives no rows.
    """
    return take_mix(docs, WEIGHTS)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row of the mixture.

    Null texts have no bytes, a null source is a stratum of its own, repeated rows are separate rows, an empty table gives
    no rows; columns of the documents other than id and source aren't passed on.
    """
    return interleave(docs, SHARDS)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: SQL has no way to express the classifier, the sketches or the alignment.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, with a table in the shared folder after each but the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
