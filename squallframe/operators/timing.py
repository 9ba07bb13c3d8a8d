"""Sliding and session windows of observations, and as-of picks of the nearest forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from squallframe.operators.observing import query
from squallframe.sources.observations import observations


@query("ST15_sliding_counts", "SELECT blob, CAST(sim_s // 300 * 300 - 300 * i AS BIGINT) AS start_s, count(*) AS n FROM obs, range(0, 12) r(i) WHERE kind = 'lightning' GROUP BY 1, 2")
def sliding_counts(spark, sf_dir):
    """Strikes of an hour, every five minutes: counted by five minutes first, so that only those counts are spread out."""
    five = observations(spark, sf_dir, "lightning").groupBy("blob", "frame_s").agg(F.count(F.lit(1)).alias("c"))
    spread = five.select("blob", "c", F.explode(F.sequence(F.col("frame_s") - 3300, F.col("frame_s"), F.lit(300))).alias("start_s"))
    return spread.groupBy("blob", "start_s").agg(F.sum("c").alias("n"))


@query("J13_forecast_as_of", ", f AS (SELECT blob, event_id, sim_s, intensity FROM obs WHERE kind = 'radar'), q AS (SELECT f.*, m, row_number() OVER (PARTITION BY blob, m ORDER BY abs(sim_s - (36000 + m * 60)), event_id) AS k FROM f, (VALUES (30), (60), (120)) v(m)) SELECT blob, m AS minutes, intensity FROM q WHERE k = 1")
def forecast_as_of(spark, sf_dir):
    """The level nearest to 30, 60 and 120 minutes ahead; the least is kept in the map tasks, so nothing is sorted."""
    r = observations(spark, sf_dir, "radar").select("blob", "event_id", "sim_s", "intensity", F.explode(F.array(F.lit(30), F.lit(60), F.lit(120))).alias("minutes"))
    best = F.min(F.struct(F.abs(F.col("sim_s") - (36_000 + F.col("minutes") * 60)).alias("off"), "event_id", "intensity")).alias("b")
    return r.groupBy("blob", "minutes").agg(best).select("blob", "minutes", "b.intensity")


@query("U9_A11_scope_counts", "SELECT regexp_replace(k, '^[^@]*@', '') AS scope, count(*) AS n FROM (SELECT source || '@' || blob || ',' || kind AS k FROM obs) GROUP BY 1 ORDER BY n DESC, scope LIMIT 30")
def scope_counts(spark, sf_dir):
    key = F.concat(F.col("source"), F.lit("@"), F.col("blob"), F.lit(","), F.col("kind"))
    counts = observations(spark, sf_dir).groupBy(F.regexp_replace(key, "^[^@]*@", "").alias("scope")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "scope").limit(30)
