"""Proportional stratified interleaving of rows into shards (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from squallframe.llm.common import hash_unit, materialize, running_position, table


def shard_and_slot(position: Column, n: Column, n_shards: int) -> tuple[Column, Column]:
    """The run of equal numbers of rows that a position (from 0, of n) is in, and its place in that run, by whole numbers only."""
    div = lambda a, b: F.call_function("div", a.cast("long"), b)
    shard = div(position * n_shards, n)
    return shard.cast("int"), position - div(shard * n + (n_shards - 1), F.lit(n_shards))


def interleave(docs: DataFrame, n_shards: int, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source", seed: int = 17) -> DataFrame:
    """Cut rows into ``n_shards`` so that each shard has the mixture of strata of the whole.

    Rows are shuffled by a seeded hash and ranked within their stratum; sorted by (rank - 1/2) / rows of the
    stratum, each stratum is spread evenly over the order, which is cut into runs of equal numbers of rows.
    Returns id_col, stratum_col, size (UTF-8 bytes plus 1), text_crc32, shard and slot (from 0 in each shard).

    Edge cases: a null text has no bytes (size 1, CRC 0); a null stratum is a stratum of its own; null and
    repeated ids are shuffled by their texts; repeated rows are separate rows and may be in different shards; an empty table gives
    no rows; other columns are ignored, whatever their names. Shards beyond the number of rows stay empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("__id"),
        F.col(stratum_col).alias("__stratum"),
        F.concat(F.when(F.col(stratum_col).isNull(), "1").otherwise("0"), F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))).alias("__key"),
        (F.octet_length(text).cast("long") + 1).alias("__size"),
        F.crc32(text.cast("binary")).cast("long").alias("__crc"),
        hash_unit(seed, F.col(id_col), F.crc32(text.cast("binary"))).alias("__u"),
    )
    rows = materialize(rows)
    ties = ["__id", "__crc", "__size"]
    ranked = running_position(rows, ["__key"], "__u", ["__u", *ties])
    ranked = ranked.select("__id", "__stratum", "__key", "__size", "__crc", "__u", ((F.col("__rank") - 0.5) / F.col("__n")).alias("__f"))
    placed = running_position(materialize(ranked), [], "__f", ["__f", "__key", "__u", *ties])
    shard, slot = shard_and_slot(F.col("__rank") - 1, F.col("__n"), n_shards)
    return placed.select(
        F.col("__id").alias(id_col), F.col("__stratum").alias(stratum_col), F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"), shard.alias("shard"), slot.alias("slot"),
    )


def op3_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(table(spark, sf_dir, "documents"), 16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
