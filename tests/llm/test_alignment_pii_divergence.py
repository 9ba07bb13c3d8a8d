"""Operators 11 to 13 against plain versions."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from squallframe.llm.alignment import BYTE_BPE, TOKENIZERS, align, aligner, link_counts
from squallframe.llm.divergence import DIVERGENCE_SQL, divergence
from squallframe.llm.pii import KINDS, find_identifiers, written

TEXTS = [
    None, "", " ", "a", "Hello world, hello  world", "don't <|endoftext|> <s> </s> <unk> <0x41> ▁x", "naïve façade — 漢字かな 😀👍🏽", "tab\tand\nnew\r\nline \x00 nul",
    " leading and trailing ", "ﬁ ligature ½ ²   non-breaking", "x" * 3000, "word " * 400, "\n \t" * 5000, "Hello world, hello  world",
]


def plain_alignment(text):
    """Token spans by hand; None for texts without tokens."""
    both = aligner(TOKENIZERS)
    if not text:
        return None
    data = f" {text}".encode()
    sides = []
    for pieces, ids in ((both.a.pieces, both.a.other.encode(f" {text}", add_special_tokens=False).ids), (both.b.pieces, both.b.model.encode(text))):
        at, spans = 0, []
        for i in ids:
            spans.append((at, at + len(pieces[i]), i))
            at += len(pieces[i])
        if b"".join(pieces[i] for i in ids) != data:
            return None
        sides.append(spans)
    a, b = sides
    links = [(x, y) for s, e, x in a for t, f, y in b if s < f and t < e] if len(a) * len(b) < 3_000_000 else None
    groups, start = [], 0
    for end in sorted({e for _, e, _ in a} & {e for _, e, _ in b}):
        groups.append("|".join(",".join(str(i) for s, e, i in side if start <= s and e <= end) for side in sides))
        start = end
    return a, b, groups, links


def test_alignment_equals_spans_by_hand(spark):
    texts = [t for t in TEXTS if t is None or len(t) < 4000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, chunk string")
    rows = {r["doc_id"]: r for r in link_counts(docs).collect()}
    known = [plain_alignment(t) for t in texts]
    counts = Counter(link for k in known if k for link in k[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    assert len(rows) == len(texts)
    for i, k in enumerate(known):
        expected = (0, 0, 0, 0, 0, 0, "")
        if k:
            a, b, groups, links = k
            expected = (len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest())
        r = rows[i]
        assert tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) == expected, texts[i]


def test_both_libraries_agree():
    both = aligner(TOKENIZERS)
    rng = random.Random(5)
    letters = "aZ é ñ漢か😀٣Ⅷ½'’sdtm  \t\n\r ​.,;!?0123"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 80)))
        assert both.a.fast.encode_ordinary(text) == both.a.other.encode(text, add_special_tokens=False).ids
    spaces = "a" + "\n \t" * 300_000 + "b"
    assert both.a.encode(spaces) == both.a.other.encode(spaces, add_special_tokens=False).ids


def test_products_are_all_pairs_of_a_group(spark):
    docs = spark.createDataFrame([(1, "unbelievable antidisestablishmentarianism 漢字"), (2, "")], "doc_id long, text string")
    links = {r["doc_id"]: r for r in align(docs).collect()}
    products = {r["doc_id"]: r for r in align(docs, products=True).collect()}
    triples = lambda r: list(zip(r["link_group"], r["link_a"], r["link_b"], strict=True))
    assert triples(links[2]) == triples(products[2]) == []
    assert set(triples(links[1])) <= set(triples(products[1]))
    for g in set(links[1]["link_group"]):
        a, b = ({t[k] for t in triples(links[1]) if t[0] == g} for k in (1, 2))
        assert sorted(t[1:] for t in triples(products[1]) if t[0] == g) == sorted((x, y) for x in a for y in b)
    both = aligner(TOKENIZERS)
    assert [both.a.pieces[i] for i in links[1]["a_ids"]][0].startswith(b" ") and BYTE_BPE in both.a.path
    assert np.array_equal(both.a_sizes, [len(p) for p in both.a.pieces])


def test_alignment_of_an_empty_table_and_odd_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert link_counts(empty).collect() == []
    odd = spark.createDataFrame([(None, "same text"), (3, "same text"), (3, "same text")], "doc_id long, text string")
    rows = link_counts(odd).collect()
    assert len(rows) == 3 and len({tuple(r)[1:] for r in rows}) == 1 and rows[0]["count_sum"] == 3 * rows[0]["n_links"]


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            number = re.sub("[^0-9]", "", m.group())
            good = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda n=number: 16 <= len(n) <= 19 and luhn(n), "phone": lambda n=number: 8 <= len(n) <= 15}
            if good[kind]():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_equal_plain_search(spark):
    rng = random.Random(3)
    parts = ["a@b.co", "a@b.c_d@e.f", "x%y@z", "@", "1.2.3.4", "256.1.1.1", "000255.0.0.00", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "5", "+1 (743) 555-3824", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "é", "漢", "😀", " ", "\n", ".", "-", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(400)]
    texts += [None, "", "1" * 50_000 + " a@b.co", "a" * 50_000 + "@b.co", "9.9.9.9 " * 3000, "1.2." * 20_000, "+1 " + "2 " * 20_000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, base int")
    rows = {r["doc_id"]: r for r in find_identifiers(docs).select("doc_id", written(F.col("base")).alias("base"), written(F.col("spans")).alias("spans")).collect()}
    for i, t in enumerate(texts):
        assert rows[i]["base"] == ",".join(plain_spans(t)), t[:80] if t else t
        assert set(plain_spans(t)) <= set(rows[i]["spans"].split(","))


def test_patterns_around_seeds_find_unseen_identifiers(spark):
    rng = random.Random(1)
    filler = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(12))
    texts = [f"{filler()} call me at +1 (555) 01{i}-99{i} {filler()}" for i in range(10, 20)]
    texts += [f"{filler()} write to office u{i}@mail.example.org today {filler()}" for i in range(8)]
    unseen = ["call me at (555) 987-6543 soon", "call me at 555.987.1111 now", "write to office bob [at] example [dot] org today"]
    clean = [f"{filler()} model 555-987-{i}000 {filler()}" for i in range(1, 9)] + ["they call it 1234567890", "at 12:30:45 we met"]
    docs = spark.createDataFrame(list(enumerate(texts + [f"{filler()} {u} {filler()}" for u in unseen] + clean)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in find_identifiers(docs).collect()}
    all_texts = dict(docs.collect())
    for i in range(len(texts), len(texts) + 3):
        (span,) = rows[i]["added"]
        value = all_texts[i][span["start"] : span["end"]]
        assert value in unseen[i - len(texts)] and span["kind"] == ("email" if "[at]" in value else "phone")
    assert all(not r["added"] for i, r in rows.items() if not len(texts) <= i < len(texts) + 3)


def test_identifiers_of_an_empty_table(spark):
    assert find_identifiers(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert KINDS == list(FORMS)


@pytest.mark.parametrize("n", [0, 40, 400])
def test_divergence_equals_sql(spark, n):
    rng = random.Random(n)
    words = ["Alpha", "beta", "gamma", "Ärger", "naïve", "x1y", "it's", "漢字", "z"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, None if i % 17 == 0 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))), rng.choice(["en", "de", "fr", None, ""]) if i % 3 else "en", rng.choice(["a", "b", "c", None, "ä"]), i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term long")
    names = ["lang", "source", "part", "item", "value", "rank"]
    ours = sorted(tuple(r[c] for c in names) for r in divergence(docs).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, term BIGINT)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert ours == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({DIVERGENCE_SQL})").fetchall())
    assert n == 0 or {r[2] for r in ours} == ({"pair", "term"} if n > 100 else {r[2] for r in ours})
