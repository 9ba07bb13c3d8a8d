"""Personal data by fixed forms, and what the words around it give away elsewhere (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from squallframe.llm.common import ascii_lower, materialize, table

KINDS = ["email", "ip", "card", "phone"]
LOCAL = r"[A-Za-z0-9._%+-]"
#: The fixed forms. Possessive repeats and the looks behind keep the matches and their order, but never go back into a run: a match
#: that fails from the start of a run of its first characters fails from any later place of it too. After a match (\G) a new one may start anywhere.
FORMS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters without which a form can't occur, looked for first.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: What may be an identifier in the right surroundings: disguised or bare addresses, numbers, groups of hexadecimal digits. Lengths are
#: those of identifiers, so no match looks far.
OPEN, CLOSE = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
LOOSE = {
    "address": rf"(?<!{LOCAL}){LOCAL}{{1,64}}(?:(?:@|{OPEN}[aA][tT]{CLOSE})[A-Za-z0-9-]{{1,63}}(?:(?:\.|{OPEN}[dD][oO][tT]{CLOSE})[A-Za-z0-9-]{{1,63}}){{0,8}}|\s[aA][tT]\s[A-Za-z0-9-]{{1,63}}\s[dD][oO][tT]\s[A-Za-z0-9-]{{1,63}})",
    "number": r"(?<![A-Za-z0-9])\(?[0-9][0-9\x20().-]{5,28}[0-9](?![A-Za-z0-9])",
    "groups": r"(?<![A-Za-z0-9:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![A-Za-z0-9:])",
}
LEFT_CHARS, RIGHT_CHARS, BLOCK = 64, 32, 256
SALTS = 32


def running_sums(steps: Column) -> Column:
    """Sums up to and with each element, block by block, as an array that grows is copied at each step."""
    last = lambda a: F.element_at(a, -1)
    grown = lambda start: lambda acc, x: F.concat(acc, F.array(last(acc) + x))  # noqa: E731, ARG005
    blocks = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(steps) - 1, F.lit(BLOCK)).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, BLOCK))
    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda acc, v: acc + v))
    starts = F.aggregate(totals, F.array(F.lit(0)), grown(0))
    inner = F.zip_with(blocks, F.slice(starts, 1, F.size(starts) - 1), lambda x, s: F.slice(F.aggregate(x, F.array(s), grown(s)), 2, BLOCK))
    return F.when(F.size(steps) > 0, F.flatten(inner)).otherwise(F.array().cast("array<int>"))


def with_matches(rows: DataFrame, text: str, pattern: str, out: str, needs: str | None = None) -> DataFrame:
    """Add an array of the pattern's matches: start and end in characters, value, and the text to the left and right up to the next matches."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    rows = rows.withColumn("__m", F.when(F.contains(text, F.lit(needs)), found).otherwise(none) if needs else found)
    rows = rows.withColumn("__g", F.when(F.size("__m") > 0, F.split(text, pattern, -1)).otherwise(none))
    rows = rows.withColumn("__s", F.zip_with(F.slice("__g", 1, F.size("__m")), "__m", lambda g, m: F.char_length(g) + F.char_length(m)))
    rows = rows.withColumn("__e", running_sums(F.col("__s")))
    sides = F.arrays_zip(F.col("__m").alias("m"), F.col("__e").alias("e"), F.slice("__g", 1, F.size("__m")).alias("l"), F.slice("__g", 2, F.greatest(F.size("__m"), F.lit(1))).alias("r"))
    span = lambda x: F.struct((x["e"] - F.char_length(x["m"])).alias("start"), x["e"].alias("end"), x["m"].alias("value"), F.right(x["l"], F.lit(LEFT_CHARS)).alias("left"), F.left(x["r"], F.lit(RIGHT_CHARS)).alias("right"))
    return rows.withColumn(out, F.transform(sides, span)).drop("__m", "__g", "__s", "__e")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a number's check digit is right (a string of digits)."""
    doubled = lambda v, i: F.when(i % 2 == 1, v).when(v > 4, v * 2 - 9).otherwise(v * 2)
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda acc, i: acc + doubled(F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int"), i)) % 10 == 0


def has_form(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        number = F.translate(value, " -", "")
        return F.when(F.length(number).between(16, 19), luhn(number)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def of_form(kind: str):
    return lambda s: has_form(kind, s["value"])


def may_be(loose: str, value: Column) -> Column:
    """The kinds that a loose match may be of."""
    n = F.length(digits(value))
    if loose == "address":
        return F.array(F.lit("email"))
    if loose == "groups":
        return F.array(F.lit("ip"))
    return F.array_compact(F.array(F.when(n.between(13, 19), "card"), F.when(n.between(7, 15), "phone")))


def contexts(left: Column, right: Column) -> Column:
    """Lexical patterns: the two words before, and the word before with the word behind; A-Z as a-z, digits as 0, ``^`` where a word is missing."""
    plain = lambda c: F.regexp_replace(ascii_lower(c), "[0-9]", "0")
    word = lambda c, pattern: F.when(F.regexp_extract(c, pattern, 1) == "", "^").otherwise(F.regexp_extract(c, pattern, 1))
    before, behind = plain(left), plain(right)
    last, second, next_ = word(before, r"(\S+)\s*$"), word(before, r"(\S+)\s+\S+\s*$"), word(behind, r"^\s*(\S+)")
    both = F.array(F.concat_ws(" ", second, last, F.lit("_")), F.concat_ws(" ", last, F.lit("_"), next_))
    return F.filter(both, lambda p: ~p.startswith("^ "))


def instance_of(kind: Column, value: Column) -> Column:
    """One name for all spellings of an identifier."""
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), digits(value)).otherwise(ascii_lower(value)))


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Join where one key may have a large part of ``many``: its rows go by a second column over SALTS tasks; ``few`` has a key once."""
    salted = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS))).join(salted, [*keys, "__salt"]).drop("__salt")


def trusted_patterns(edges: DataFrame, rounds: int, support: float, confidence: float) -> DataFrame:
    """(kind, pattern, trust) of patterns whose instances are mostly believed.

    edges: distinct (kind, pattern, instance, seed). Seeds are believed wholly; each round, a pattern is trusted by the sum of belief
    in its instances over their number plus one, and an unseen instance is believed unless all its trusted patterns are wrong
    (the product of what each lacks in trust). The last round's patterns with at least ``support`` believed instances and ``confidence`` stay.
    """
    belief = edges.withColumn("belief", F.col("seed").cast("double"))
    for k in range(rounds):
        trust = belief.groupBy("kind", "pattern").agg(F.sum("belief").alias("believed"), F.count(F.lit(1)).alias("n"))
        trust = trust.withColumn("trust", F.col("believed") / (F.col("n") + 1)).where((F.col("believed") >= support) & (F.col("trust") >= confidence)).select("kind", "pattern", "trust")
        trust = materialize(trust)
        if k == rounds - 1:
            break
        doubt = salted_join(edges.where("NOT seed"), trust, ["kind", "pattern"], "instance").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("trust"))))).alias("new"))
        unseen = salted_join(edges.where("NOT seed"), doubt, ["instance"], "pattern").select("kind", "pattern", "instance", "seed", F.col("new").alias("belief"))
        rest = edges.where("seed").withColumn("belief", F.lit(1.0))
        unknown = edges.where("NOT seed").withColumn("belief", F.lit(0.0))
        belief = materialize(rest.unionByName(unseen).unionByName(unknown).groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"), F.max("belief").alias("belief")))
    return trust


def find_identifiers(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 4, support: float = 3.0, confidence: float = 0.6) -> DataFrame:
    """Spans of personal data: id_col, ``base`` (of the fixed forms) and ``added``, arrays of (kind, start, end) with ends exclusive, in characters.

    Spans of fixed forms are seeds. The words around them are patterns; the loose matches that stand in the same surroundings are
    instances that may be unseen identifiers. Patterns and instances are scored in turn (``trusted_patterns``) and a loose match is
    added, as a kind that its form allows, if a pattern around it is trusted at the end: with the defaults, one with at least three believed
    different instances and three fifths of all. Base spans always stay; a loose match that overlaps one is never added.

    Edge cases: null and empty texts have no spans; null and repeated ids are kept row by row; repeated texts count once for
    patterns, as instances are distinct; kinds that tie go by name; a very long text is searched in one task, its matches in blocks, without going back into
    runs; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for kind, pattern in FORMS.items():
        rows = with_matches(rows, "text", pattern, kind, NEEDS[kind])
        rows = rows.withColumn(kind, F.filter(kind, of_form(kind)))
    for loose, pattern in LOOSE.items():
        rows = with_matches(rows, "text", pattern, loose)
    numbered = {k: i for i, k in enumerate(KINDS)}
    brief = lambda k: lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    seed = lambda k: lambda s: F.struct(F.lit(True).alias("seed"), F.array(F.lit(k)).alias("kinds"), *(s[c].alias(c) for c in ("start", "end", "value")), contexts(s["left"], s["right"]).alias("patterns"))
    free = lambda k: lambda s: F.struct(F.lit(False).alias("seed"), may_be(k, s["value"]).alias("kinds"), *(s[c].alias(c) for c in ("start", "end", "value")), contexts(s["left"], s["right"]).alias("patterns"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "id", F.concat(*(F.transform(k, brief(k)) for k in KINDS)).alias("base"),
        F.concat(*(F.transform(k, seed(k)) for k in KINDS), *(F.transform(k, free(k)) for k in LOOSE)).alias("matches"),
    )
    rows = materialize(rows)

    # a loose match must not overlap a base span: of those before it, the farthest end; of those behind, the nearest start
    matches = rows.select("row", F.inline("matches")).where("size(kinds) > 0")
    order = F.struct("start", F.expr("NOT seed"))
    ahead = Window.partitionBy("row").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(order.desc()).rowsBetween(Window.unboundedPreceding, -1)
    matches = matches.withColumn("__far", F.max(F.when(F.col("seed"), F.col("end"))).over(ahead)).withColumn("__near", F.min(F.when(F.col("seed"), F.col("start"))).over(behind))
    matches = matches.where("seed OR (coalesce(__far, 0) <= start AND coalesce(__near, end) >= end)")
    places = matches.select("row", "seed", "start", "end", "value", F.explode("kinds").alias("kind"), "patterns")
    places = places.select("row", "seed", "start", "end", "kind", instance_of(F.col("kind"), F.col("value")).alias("instance"), F.explode("patterns").alias("pattern"))
    places = materialize(places)
    edges = materialize(places.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed")))
    trust = trusted_patterns(edges, rounds, support, confidence)

    best = F.max(F.struct("trust", "kind")).alias("b")
    added = salted_join(places.where("NOT seed"), trust, ["kind", "pattern"], "row").groupBy("row", "start", "end").agg(best)
    added = added.groupBy("row").agg(F.collect_list(F.struct(F.col("b.kind").alias("kind"), "start", "end")).alias("added"))
    in_place = lambda a: F.transform(F.array_sort(F.transform(a, lambda s: F.struct(F.create_map(*[F.lit(v) for p in numbered.items() for v in p])[s["kind"]].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = rows.select("row", "id", "base").join(added, "row", "left")
    nothing = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return out.select(F.col("id").alias(id_col), "base", F.coalesce(in_place(F.col("added")), nothing).alias("added"), in_place(F.concat("base", F.coalesce("added", nothing))).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op12_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_identifiers(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size("added").cast("long").alias("n_added"))
