"""How the sources of a language differ in their terms: shards of counts by language and term, each worked through by DuckDB."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from squallframe.llm.common import materialize, table, tidied

#: Different (language, source, term) that a map task counts before it hands its counts on.
HELD_TERMS = 250_000
#: Memory of DuckDB in a task; it has no folder to spill to, as a shard's different terms are meant to fit.
SHARD_MEMORY = "900MB"
SCALE, PRIOR = 1_000_000_000, 2

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
#: Bytes that aren't in terms become spaces, A-Z becomes a-z; bytes of characters beyond ASCII stay.
TO_TERMS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

KEPT_SQL = """
SELECT lang, source, term, n, CAST(row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS BIGINT) AS one
FROM (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, sum(docs) AS docs FROM shard GROUP BY ALL)
QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {min_docs}
"""

#: p of the group, q of the language, zero: p of a term that the group lacks.
PLACED_SQL = f"""
CREATE TABLE placed AS SELECT lang, source, term,
    CAST(1 + CAST({SCALE} AS HUGEINT) * (n + {PRIOR}) // (total + {PRIOR} * kept) AS BIGINT) AS p,
    CAST(1 + CAST({SCALE} AS HUGEINT) * {PRIOR} // (total + {PRIOR} * kept) AS BIGINT) AS zero,
    CAST(1 + CAST({SCALE} AS HUGEINT) * (sum(n) OVER (PARTITION BY lang, term) + {PRIOR}) // (lang_total + {PRIOR} * kept) AS BIGINT) AS q
FROM shard
"""
MACRO_SQL = "CREATE MACRO apart(p, q) AS ((p - q) * (p - q)) // (p + q)"
#: Of each two sources, what their common terms add to the sums made of one source's terms alone; then how often each p occurs;
#: then a shard's best terms of each group.
PARTIAL_SQL = """
SELECT 'both' AS part, a.lang AS lang, a.source AS source, b.source AS item,
    CAST(sum(apart(a.p, b.p) - apart(a.p, b.zero) - apart(a.zero, b.p) + apart(a.zero, b.zero)) AS BIGINT) AS value, CAST(0 AS BIGINT) AS p
FROM placed a JOIN placed b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY a.lang, a.source, b.source
UNION ALL
SELECT 'single', lang, source, '', count(*), p FROM placed GROUP BY lang, source, p
UNION ALL
SELECT 'term', lang, source, term, apart(p, q), p FROM placed WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY apart(p, q) DESC, term) <= {top}
"""


def count_terms(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs) of the rows that a task holds at a time: occurrences and documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, with_it) in seen.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([source] * len(n)), terms, pa.array(list(n.values()), pa.int64()), pa.array([with_it[t] for t in n], pa.int64())], schema=COUNTS)
            seen.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n, with_it = seen[lang, source]
                held -= len(n)
                terms = text.encode().translate(TO_TERMS).split()
                n.update(terms)
                with_it.update(set(terms))
                held += len(n)
                if held >= HELD_TERMS:
                    yield from rows()
                    held = 0
        yield from rows()

    empty = F.lit("")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), empty) for c in (lang_col, source_col, text_col)))
    return rows.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")


def over_shards(rows: DataFrame, statements: list[str], result: str, schema: str) -> DataFrame:
    """Run SQL over each shard of the rows, which are dealt by language and term; ``shard`` names its rows in the SQL."""
    types = pa.schema([(f.name, pa.int64() if f.dataType.simpleString() == "bigint" else pa.string()) for f in rows.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "memory_limit": SHARD_MEMORY, "temp_directory": ""}) as con:
            con.register("shard", pa.RecordBatchReader.from_batches(types, (pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(b.columns, types.types, strict=True)], schema=types) for b in batches)))
            for statement in statements:
                con.execute(statement)
            yield from con.sql(result).to_arrow_reader(20_000)

    return rows.repartition("lang", "term").mapInArrow(lambda batches: tidied(run(batches)), schema)


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, top: int = 10) -> DataFrame:
    """How far each source of a language is from its other sources (part ``pair``) and its ``top`` terms against the language (part ``term``).

    Terms are runs of letters A-Z, lower-cased, and of characters beyond ASCII; a language keeps those in at least ``min_docs`` of its
    documents. Map tasks count terms, shards by language and term sum them and make partial sums of pairs in SQL, Spark
    merges sums and rankings. A pair's sum over all terms is that of terms that neither has, plus what each one's own terms add
    against the other's value of absent terms (counted by p, as few different p occur), plus what common terms add to that; so
    no term is written out for sources that lack it. All numbers are whole. Returns lang, source, part, item, value, rank.

    Edge cases: nulls are empty texts, languages and sources; groups without terms are compared too; where no term is kept,
    values of pairs are 0; ties in value go by the item's bytes; repeated rows count each; a very long text is held whole, with its
    words, by one task; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    kept = materialize(over_shards(count_terms(docs, text_col, lang_col, source_col), [], KEPT_SQL.format(min_docs=min_docs), "lang string, source string, term string, n bigint, one bigint"))
    empty = F.lit("")
    groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source")).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("one").alias("ones"))
    langs = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("ones").alias("kept"))
    totals = groups.join(sums.drop("ones"), ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "lang_total", "kept"])
    zero = F.when(F.col("kept") > 0, 1 + F.call_function("div", F.lit(SCALE * PRIOR), F.col("total") + PRIOR * F.col("kept")))
    totals = materialize(totals.withColumn("zero", zero))

    partial_schema = "part string, lang string, source string, item string, value bigint, p bigint"
    rows = kept.select("lang", "source", "term", "n").join(totals.select("lang", "source", "total", "lang_total", "kept"), ["lang", "source"])
    rows = rows.select("lang", "source", "term", "n", "total", "lang_total", "kept")
    parts = materialize(over_shards(rows, [MACRO_SQL, PLACED_SQL], PARTIAL_SQL.format(top=top), partial_schema))

    other = totals.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"))
    absent = totals.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("kept") * apart(F.col("zero"), F.col("item_zero")), F.lit(0)).alias("value"))
    # each p of a source against the others: rows of a language are salted, as one language may have most of them
    salts = 16
    single = parts.where("part = 'single'").groupBy("lang", "source", "p").agg(F.sum("value").alias("terms")).withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(salts)))
    single = single.join(totals.select("lang", "source", "zero"), ["lang", "source"])
    salted = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    extra = F.sum(F.col("terms") * (apart(F.col("p"), F.col("item_zero")) - apart(F.col("zero"), F.col("item_zero")))).alias("value")
    alone = single.join(salted, ["lang", "salt"]).where("source <> item").groupBy("lang", "source", "item").agg(extra)
    both = parts.where("part = 'both'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = absent.union(alone).union(turned(alone)).union(both).union(turned(both)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))
    terms = parts.where("part = 'term'").select("lang", "source", "part", "item", "value", place.alias("rank")).where(F.col("rank") <= top)
    return pairs.union(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT row, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
grouped AS (SELECT *, CAST(1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p FROM cells),
whole AS (SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT g.lang, g.source, 'term' AS part, g.term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM grouped g JOIN whole w ON g.lang = w.lang AND g.term = w.term WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
