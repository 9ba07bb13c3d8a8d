"""URL verdicts: host and path rules, else trust and distrust propagated over the host graph (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from squallframe.llm.common import ascii_lower, materialize, table

#: Rules as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Rules are sent to all tasks as literals; more than this are refused.
MAX_RULES = 4096


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ? or #); both empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct of rule and verdict, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be sent to the tasks")
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    table_ = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for v, h, p in longest_first])
    fits = F.filter(table_, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    best = F.get(fits, F.lit(0))
    return F.when(best.isNotNull(), F.struct(F.concat(best["host"], best["path"]).alias("rule"), best["verdict"].alias("verdict")))


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """Links between different hosts: __src, __dst and their number, from absolute and scheme-relative hrefs."""
    targets = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"), 1)
    links = pages.where(F.col(host) != "").select(F.col(host).alias("__src"), F.explode(targets).alias("__dst")).withColumn("__dst", ascii_lower(F.col("__dst")))
    return links.where("__src <> __dst").groupBy("__src", "__dst").agg(F.count(F.lit(1)).alias("__links"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-3, max_rounds: int = 500) -> DataFrame:
    """Personalised PageRank of trust along edges and of distrust against them: __host, __trust and __distrust.

    seeds: __host, __trust, __distrust (each summing to 1 or 0). Ranks are the sum of what each round passes on: the damped
    part of what the round before has passed to a host, by its share of links; hosts without links pass on nothing. The
    rounds end when all later ones together pass on less than the tolerance (of 1 each for trust and distrust), which is
    so after about log(tolerance) / log(damping) rounds at the latest; ``max_rounds`` without that is an error.
    """
    out_of = edges.groupBy("__src").agg(F.sum("__links").alias("__out"))
    into = edges.groupBy("__dst").agg(F.sum("__links").alias("__in"))
    forward = edges.join(out_of, "__src").select(F.col("__src").alias("__from"), F.col("__dst").alias("__to"), (F.col("__links") / F.col("__out")).alias("__a"), F.lit(0.0).alias("__b"))
    backward = edges.join(into, "__dst").select(F.col("__dst").alias("__from"), F.col("__src").alias("__to"), F.lit(0.0).alias("__a"), (F.col("__links") / F.col("__in")).alias("__b"))
    flows = materialize(forward.unionByName(backward).groupBy("__from", "__to").agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b")))
    ranks = passed = seeds.select("__host", (F.col("__trust") * (1 - damping)).alias("__trust"), (F.col("__distrust") * (1 - damping)).alias("__distrust"))
    for k in range(max_rounds):
        passed = passed.join(flows, F.col("__host") == F.col("__from")).groupBy(F.col("__to").alias("__host")).agg(F.sum(damping * F.col("__trust") * F.col("__a")).alias("__trust"), F.sum(damping * F.col("__distrust") * F.col("__b")).alias("__distrust"))
        passed = materialize(passed.where("__trust > 0 or __distrust > 0"))
        ranks = ranks.unionByName(passed).groupBy("__host").agg(F.sum("__trust").alias("__trust"), F.sum("__distrust").alias("__distrust"))
        if k % 4 == 3:
            ranks = materialize(ranks)
        left = passed.agg(F.greatest(F.coalesce(F.sum("__trust"), F.lit(0.0)), F.coalesce(F.sum("__distrust"), F.lit(0.0))).alias("left")).first().left
        if left * damping / (1 - damping) < tolerance:
            return ranks
    raise RuntimeError(f"ranks are still passed on after {max_rounds} rounds")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = 0.85, tolerance: float = 1e-3) -> DataFrame:
    """Verdict of each page: its longest fitting rule's, else its host's by propagation.

    Pages that rules allow or block make their hosts seeds of trust or distrust, by numbers of pages. A host
    is blocked if its distrust is more than its trust, so hosts that neither reaches are allowed.
    Returns id_col, host, path, rule, verdict, trust and distrust.

    Edge cases: a null url, or one without ://, has an empty host and path, no rule and the verdict allow; a null
    or empty html has no links; repeated rows are judged alike; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    host, path = url_parts(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("__id"), host.alias("__host"), path.alias("__path"), F.col(html_col).alias("__html"))
    judged = judged.withColumn("__rule", fitting_rule(F.col("__host"), F.col("__path"), rules))
    counts = judged.where("__host <> ''").groupBy("__host").agg(F.count_if(F.col("__rule.verdict") == "allow").alias("__a"), F.count_if(F.col("__rule.verdict") == "block").alias("__b"))
    sums = counts.agg(F.sum("__a").alias("__sa"), F.sum("__b").alias("__sb"))
    share = lambda x, s: F.when(F.col(s) > 0, F.col(x) / F.col(s)).otherwise(0.0)
    seeds = materialize(counts.crossJoin(F.broadcast(sums)).select("__host", share("__a", "__sa").alias("__trust"), share("__b", "__sb").alias("__distrust")))
    edges = materialize(host_edges(judged, "__host", "__html"))
    ranks = propagate(seeds, edges, damping, tolerance)
    ranks = ranks.select(F.col("__host").alias("__h"), "__trust", "__distrust")
    out = judged.drop("__html").join(ranks, F.col("__host") == F.col("__h"), "left")
    trust, distrust = F.coalesce("__trust", F.lit(0.0)), F.coalesce("__distrust", F.lit(0.0))
    by_host = F.when(distrust > trust, "block").otherwise("allow")
    return out.select(
        F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), by_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"),
    )


def op5_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)
