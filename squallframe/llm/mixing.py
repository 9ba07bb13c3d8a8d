"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from squallframe.llm.common import WORD, hash_unit, materialize, row_hash, running_position, table

#: Parts into which each source's rows are dealt where its target is joined to them.
SALTS = 256
#: Steps of sizes: so many for each factor of e.
STEPS = 32.0


def source_targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """Targets of sources from (__key, source_size): ``share`` of all words by weight, none above cap times its size.

    Weights repeat over the sources in the order of __key. The excess of capped sources goes to the others by
    weight until none is above: a source is capped exactly if filling all at its level would use up the total.
    """
    in_order = Window.orderBy("__key")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__place") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("__place", F.row_number().over(in_order) - 1).withColumn("__w", w)
    rows = rows.withColumn("__room", cap * F.col("source_size")).withColumn("__level", F.col("__room") / F.col("__w"))
    everything = Window.partitionBy()
    rows = rows.withColumn("__want", share * F.sum("source_size").over(everything))
    lower = Window.orderBy("__level", "__key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__used", F.coalesce(F.sum("__room").over(lower), F.lit(0.0)))
    rows = rows.withColumn("__left", F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(lower), F.lit(0.0)))
    rows = rows.withColumn("__capped", F.col("__used") + F.col("__level") * F.col("__left") <= F.col("__want"))
    spare = F.col("__want") - F.coalesce(F.sum(F.when(F.col("__capped"), F.col("__room"))).over(everything), F.lit(0.0))
    open_w = F.sum(F.when(~F.col("__capped"), F.col("__w"))).over(everything)
    return rows.select("__key", "source_size", F.when(F.col("__capped"), F.col("__room")).otherwise(F.col("__w") * spare / open_w).alias("target"))


def inclusion_levels(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(__key, __lambda): a row of size z is included with probability min(1, lambda * z), z in steps of about 3 %.

    Words expected from that are what is left of the source's target after the certain copies. Steps with a probability of
    1 are taken out first: lambda is that of the largest step that, with all smaller ones, isn't certain.
    """
    sums = rows.where("__size > 0").groupBy("__key", "__step").agg(F.sum("__size").alias("__words")).join(targets.select("__key", "__rest"), "__key")
    larger = Window.partitionBy("__key").orderBy(F.desc("__step")).rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy("__key").orderBy("__step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    z = F.exp(F.col("__step") / STEPS)
    level = (F.col("__rest") - F.coalesce(F.sum("__words").over(larger), F.lit(0))) / F.sum(z * F.col("__words")).over(smaller)
    tried = sums.withColumn("__lambda", level).withColumn("__z", z).where(F.col("__lambda") * F.col("__z") <= 1 + 1e-12)
    return tried.groupBy("__key").agg(F.max_by("__lambda", "__step").alias("__lambda"))


def pareto_mix(docs: DataFrame, weights: list[float], *, share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 29) -> DataFrame:
    """How often the mix takes each row, so that sources come near their targets.

    A source's ratio of target to size is the number of copies that each of its rows is due. The whole part of it
    is certain. For the rest, a row's inclusion is in proportion to its size, those that come to 1 being certain too; rows
    are ranked by the odds of a uniform number over the odds of inclusion (Pareto order sampling) and the sample ends where
    its words are nearest what is left of the target.
    Returns id_col, source_col, text_hash (xxhash64 of the text), size, source_size, target, copies, taken and inclusion.

    Edge cases: a null or blank text has size 0 and is taken with its certain copies only; a null source is a
    source of its own, last in order; ties and repeated rows are ranked by id, hash and size and are separate rows;
    an empty table, or one without words, gives targets of 0; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("__id"),
        F.col(source_col).alias("__source"),
        F.concat(F.when(F.col(source_col).isNull(), "1").otherwise("0"), F.coalesce(F.col(source_col).cast("string"), F.lit(""))).alias("__key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("__size"),
        F.xxhash64(text).alias("__hash"),
        hash_unit(seed, F.col(id_col), F.crc32(text.cast("binary"))).alias("__u"),
    )
    rows = materialize(rows.withColumn("__step", F.floor(F.log(F.greatest("__size", F.lit(1))) * STEPS)))
    targets = source_targets(rows.groupBy("__key").agg(F.sum("__size").alias("source_size")), weights, share, cap)
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("__due", due).withColumn("__certain", F.floor("__due"))
    targets = materialize(targets.withColumn("__rest", F.col("target") - F.col("__certain") * F.col("source_size")))
    targets = targets.join(inclusion_levels(rows, targets), "__key", "left")
    # every source's row is there once for each salt, so that a hot source's rows are dealt to all tasks
    salted = targets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__salt", F.least(F.floor(F.col("__u") * SALTS).cast("int"), F.lit(SALTS - 1))).join(salted, ["__key", "__salt"])
    inclusion = F.least(F.lit(1.0), F.col("__lambda") * F.exp(F.col("__step") / STEPS))
    rows = rows.withColumn("__pi", F.when((F.col("__size") > 0) & (F.col("__rest") > 0), F.coalesce(inclusion, F.lit(0.0))).otherwise(0.0))
    odds = F.col("__u") / (1 - F.col("__u"))
    ranking = odds * (1 - F.col("__pi")) / F.col("__pi")
    # Q / (1 + Q) keeps the order of Q and is in [0, 1], 0 for certain rows (in the order of their numbers)
    rows = rows.withColumn("__q", F.when(F.col("__pi") > 0, 1 - 1 / (1 + ranking)).otherwise(F.lit(1.0)))
    # certain rows all have the first place in this order and rows never taken the last one: they are spread by their numbers
    place = F.when(F.col("__q") == 0, F.col("__u")).when(F.col("__q") < 1, 1 + F.col("__q")).otherwise(2 + F.col("__u")) / 3
    rows = rows.withColumn("__place", F.when(F.col("__rest") > 0, place).otherwise(F.col("__u")))
    ranked = running_position(materialize(rows), ["__key"], "__place", ["__q", "__u", "__id", "__hash", "__size"], "__size")
    sampled = (F.col("__pi") > 0) & (F.col("__cum") - F.col("__size") / 2.0 <= F.col("__rest"))
    copies = (F.col("__certain") + F.when(sampled, 1).otherwise(0)).cast("int")
    return ranked.select(
        F.col("__id").alias(id_col), F.col("__source").alias(source_col), F.col("__hash").alias("text_hash"), F.col("__size").alias("size"),
        "source_size", "target", copies.alias("copies"), (copies * F.col("__size")).cast("long").alias("taken"), F.col("__pi").alias("inclusion"),
    )


def take_mix(docs: DataFrame, weights: list[float], *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of the mix: each row as often as ``pareto_mix`` takes it, with the columns of ``docs``.

    Rows with the same id and text are interchangeable: their copies are added up and dealt to that of them with the
    smallest hash of all its columns (but those of map type).

    Edge cases: nulls, empty texts and ties as in ``pareto_mix``; columns of ``docs`` may have any names.
    """
    key, text_hash = F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    taken = pareto_mix(docs, weights, id_col=id_col, text_col=text_col, **options)
    taken = taken.groupBy(key.alias("__tkey"), F.col("text_hash").alias("__thash")).agg(F.sum("copies").cast("int").alias("__copies")).where("__copies > 0")
    rows = docs.withColumns({"__key": key, "__hash": text_hash, "__all": row_hash(docs)})
    rows = rows.join(taken, (F.col("__key") == F.col("__tkey")) & (F.col("__hash") == F.col("__thash")))
    first = F.row_number().over(Window.partitionBy("__key", "__hash").orderBy("__all"))
    rows = rows.withColumn("__n", first).where("__n = 1")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pareto_mix(table(spark, sf_dir, "documents"), [5.0, 2.0, 1.0])
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
