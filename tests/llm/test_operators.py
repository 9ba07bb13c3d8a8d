"""Each operator on one small table of edge cases: nulls, empty, blank and long texts, repeated rows, clashing columns."""

import gzip
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from squallframe.llm import components, decontamination, html, jpeg, lm, mixing, neardup, quality, queries, sharding, urls, warc

WORDS = [f"wort{k}" for k in range(300)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, media string, __rank string, score string, spans string"


def _text(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n))


def _changed(text: str, at: list[int]) -> str:
    words = text.split()
    for k in at:
        words[k] = "anders"
    return " ".join(words)


BASE = _text(1, 120)
TEXTS = {
    1: BASE, 2: BASE, 3: _changed(BASE, [60]), 4: _text(2, 100), 5: None, 6: "", 7: " \n\t", 8: "Ärger", 9: _text(3, 30_000),
    10: _text(4, 40) + " " + _text(90, 12) + " " + _text(5, 40), 11: "a b c", 12: "x! Y? ÿ z",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None, f"s{k % 3}" if k != 4 else None, None if t is None else len(t), *["x"] * 5) for k, t in TEXTS.items()]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", None, "s1", 5, *["x"] * 5)], DOCS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_near_duplicates(docs, empty):
    found = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert [found[k].class_id for k in (1, 2, 3, 4, 8)] == [1, 1, 1, 4, 8] and found[3].exact_id == 3
    assert [found[k].class_id for k in (5, 6, 7)] == [5, 6, 7]
    kept = Counter(r.doc_id for r in neardup.one_of_each(docs).collect())
    assert kept == Counter([1, 4, 5, 6, 7, 8, 9, 10, 11, 12, None])
    assert neardup.near_duplicates(empty).count() == 0


def _edited(draw: random.Random, words: list[str], edits: int) -> list[str]:
    out = list(words)
    for _ in range(edits):
        at, kind = draw.randrange(len(out)), draw.randrange(3)
        out[at : at + (kind < 2)] = [] if kind == 0 and len(out) > 1 else [f"x{draw.randrange(10_000)}"]
    return out


def test_candidates_of_short_texts_by_length():
    draw, hashes = random.Random(7), neardup.WordHashes()
    found, seen = Counter(), Counter()
    for n in range(1, 42):
        for _ in range(60):
            words = [f"w{draw.randrange(draw.choice([3, 50, 5000]))}" for _ in range(n)]
            a, b = (hashes.of(" ".join(w)) for w in (words, _edited(draw, words, draw.randint(0, n // 5))))
            if min(len(a), len(b)) <= neardup.SHORT and neardup.similar(a.view(np.int64), b.view(np.int64), 0.8):
                seen[n] += 1
                turned = (int.from_bytes(neardup.word_bits(a)) ^ int.from_bytes(neardup.word_bits(b))).bit_count()
                assert turned + abs(len(a) - len(b)) <= 2 * neardup.most_edits(max(len(a), len(b)), 0.8)
                found[n] += len(np.intersect1d(neardup.bucket_keys(a, 0.8), neardup.bucket_keys(b, 0.8))) > 0
    assert found == seen and sum(seen.values()) > 1500


def test_near_duplicates_that_share_few_or_no_sketches(spark):
    draw, hashes, texts = random.Random(8), neardup.WordHashes(), []
    for n in [5, 8, 9, 10, 12, 20, 33, 34, 41] * 4:  # pairs of short texts
        words = [f"w{draw.randrange(5000)}" for _ in range(n)]
        texts.append((words, _edited(draw, words, n // 5)))
    while len(texts) < 44:  # and pairs of longer ones that share one to three sketches
        words = [f"w{draw.randrange(5000)}" for _ in range(120)]
        other = _edited(draw, words, 22)
        if 1 <= np.sum(neardup.order_sketches(hashes.of(" ".join(words))) == neardup.order_sketches(hashes.of(" ".join(other)))) <= 3:
            texts.append((words, other))
    texts = [(a, b) for a, b in texts if min(len(a), len(b)) <= neardup.SHORT or len(a) == 120]
    pairs = [(a, b) for a, b in texts if neardup.similar(hashes.of(" ".join(a)).view(np.int64), hashes.of(" ".join(b)).view(np.int64), 0.8)]
    rows = [(2 * k + j, " ".join(t)) for k, pair in enumerate(pairs) for j, t in enumerate(pair)]
    classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 30 and classes == {k: k - k % 2 for k, _ in rows}


def _spread(draw: random.Random, words: list[str], share: float) -> list[str]:
    """Words changed, dropped or added (in turn) at places as far apart as their number allows."""
    out, gap = [], 1 / share
    places = {round(gap * k) for k in range(1, int(len(words) * share) + 1)}
    for at, word in enumerate(words, 1):
        kind = draw.randrange(3) if at in places else 3
        out += {0: [f"x{at}"], 1: [], 2: [word, f"x{at}"], 3: [word]}[kind]
    return out


def test_recall_of_candidates_by_edits_against_all_pairs():
    draw, hashes = random.Random(9), neardup.WordHashes()
    for n in (50, 100, 400, 1500):
        for share in (0.02, 0.05, 0.1, 0.15, 0.2):
            found = seen = 0
            while seen < 40:
                words = [f"w{draw.randrange(5000)}" for _ in range(n)]
                a, b = hashes.of(" ".join(words)), hashes.of(" ".join(_spread(draw, words, share)))
                if neardup.similar(a.view(np.int64), b.view(np.int64), 0.8):
                    seen += 1
                    found += len(np.intersect1d(neardup.bucket_keys(a, 0.8), neardup.bucket_keys(b, 0.8))) > 0
            assert found >= 0.9 * seen, (n, share, found)


def test_classes_equal_those_of_all_pairs(spark):
    """Crowded buckets: texts of one passage and words of their own, of which some are similar; repeated and null ids."""
    draw, hashes = random.Random(10), neardup.WordHashes()
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join([*passage, *(f"o{draw.randrange(5000)}" for _ in range(draw.randrange(2, 50)))]) for _ in range(120)]
    texts += [" ".join(_spread(draw, t.split(), 0.08)) for t in texts[:30]] + texts[:5]
    words = [hashes.of(t).view(np.int64) for t in texts]
    parent = list(range(len(texts)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if neardup.similar(words[i], words[j], 0.8):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    rows = list(enumerate(texts))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.class_id for r in found} == {k: top(k) for k, _ in rows}
    odd = [(7, _text(20, 50), "a"), (7, _text(21, 50), "b"), (None, _text(20, 50), "c"), (None, _text(22, 50), "d"), (None, _text(22, 50), "e"), (9, _text(21, 50), "f"), (None, None, "g"), (None, None, "g")]
    kept = [(r.doc_id, r.text) for r in neardup.one_of_each(spark.createDataFrame(odd, "doc_id long, text string, other string")).collect()]
    assert Counter(kept) == Counter([odd[0][:2], odd[1][:2], odd[3][:2], (None, None), (None, None)])


def test_language_model_scores_by_brute_force_and_partitions(spark):
    draw = random.Random(12)
    texts = [" ".join(f"v{int(draw.paretovariate(0.7)) % 900}" for _ in range(draw.randrange(0, 80))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = docs.where("doc_id % 3 > 0").repartition(3)
    model, rare = lm.train(seen, bits_per_entry=4096, max_frequent=100)
    found = {r.doc_id: r for r in lm.score_texts(docs, model, rare).collect()}
    words, pairs = Counter(), Counter()
    for k, t in enumerate(texts):
        if k % 3:
            tokens = ["", *t.split(), ""]
            words.update(tokens[1:])
            pairs.update(zip(tokens[:-1], tokens[1:], strict=True))
    n = sum(words.values())
    stands = lambda c: 0.5 if c == 0 else 1.0 if c == 1 else 2 ** (int(math.log2(c)) + 0.5)
    often = sum(c for c in pairs.values() if c > 1) / n
    for k, t in enumerate(texts):
        tokens, score = ["", *t.split(), ""], 0.0
        for a, b in zip(tokens[:-1], tokens[1:], strict=True):
            single = (stands(words[b]) + 0.5) / (n + 0.5 * (len(words) + 1))
            weight = often * stands(words[a]) / (stands(words[a]) + lm.PRIOR)
            share = min(1.0, stands(pairs[a, b]) / stands(words[a])) if pairs[a, b] else 0.0
            score += math.log10(weight * share + (1 - weight) * single)
        base = sum(math.log10((words[b] + 0.5) / (n + 0.5 * (len(words) + 1))) for b in tokens[1:])
        assert found[k].score == pytest.approx(score, abs=1e-9) and found[k].base_score == pytest.approx(base, abs=1e-9), k
    runs = []
    for parts in (1, 16):
        model, rare = lm.train(seen.repartition(parts), part_bytes=1024, max_filter_bytes=1 << 13)
        runs.append({r.doc_id: r.score for r in lm.score_texts(docs.repartition(parts), model, rare).collect()})
    assert runs[0] == pytest.approx(runs[1], abs=1e-9)


def test_trust_equals_brute_force_pagerank(spark):
    draw = random.Random(3)
    hosts = [f"h{k}" for k in range(12)]
    links = Counter((draw.choice(hosts), draw.choice(hosts)) for _ in range(40))
    edges = [(a, b, n) for (a, b), n in links.items() if a != b]
    seeds = [(h, 0.5 * (k < 2), 1.0 * (k == 5)) for k, h in enumerate(hosts)]
    found = urls.propagate(spark.createDataFrame(seeds, "__host string, __trust double, __distrust double"), spark.createDataFrame(edges, "__src string, __dst string, __links long"), tolerance=1e-9)
    number = {h: k for k, h in enumerate(hosts)}
    flow = np.zeros((12, 12))
    for a, b, n in edges:
        flow[number[a], number[b]] += n
    ways = [flow / np.maximum(flow.sum(axis=1, keepdims=True), 1), flow.T / np.maximum(flow.T.sum(axis=1, keepdims=True), 1)]
    start = np.array([s[1:] for s in seeds], float)
    want = [np.linalg.solve(np.eye(12) - 0.85 * w.T, 0.15 * start[:, k]) for k, w in enumerate(ways)]
    got = {r["__host"]: (r["__trust"], r["__distrust"]) for r in found.collect()}
    for h, k in number.items():
        assert got[h] == pytest.approx((want[0][k], want[1][k]), abs=1e-7)


def test_pareto_inclusion_grows_with_size(spark):
    draw = random.Random(4)
    rows = [(k, " ".join(["w"] * draw.choice([1, 3, 10, 40])), "s") for k in range(3000)]
    found = mixing.pareto_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), [1.0], share=0.3).collect()
    total, taken = sum(r.size for r in found), sum(r.taken for r in found)
    assert abs(taken - 0.3 * total) <= 40 and sum(r.inclusion * r.size for r in found) == pytest.approx(0.3 * total, rel=0.01)
    for size in (3, 10, 40):
        of = [r for r in found if r.size == size]
        assert sum(r.copies for r in of) / len(of) == pytest.approx(of[0].inclusion, abs=0.05)
    assert len({round(r.inclusion / r.size, 3) for r in found if r.inclusion < 1}) <= 2


def test_arc_file_of_another_writer():
    http = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\nabc"
    described = b"1 0 Crawler\nURL IP-address Archive-date Content-type Archive-length\n"
    data = b"filedesc://a.arc 10.0.0.1 19990102030405 text/plain %d\n%s\n" % (len(described), described)
    data += b"http://a/x y 10.0.0.2 19990102030406 text/html %d\n%s\n" % (len(http), http)
    data += b"dns:a 10.0.0.3 19990102 text/dns 5\nn 1 A\n"
    got = [warc.as_warc(*r) for r in warc.parse_arc(data)]
    assert [(r[0], r[2], r[3], r[5]) for r in got] == [
        ("warcinfo", "filedesc://a.arc", None, "1999-01-02T03:04:05Z"), ("response", "http://a/x y", "10.0.0.2", "1999-01-02T03:04:06Z"), ("resource", "dns:a", "10.0.0.3", "1999-01-02T00:00:00Z"),
    ]
    assert got[1][7] == b"abc" and b"ARC 1 of Crawler" in got[0][7]
    first = {"page_id": 1, "uri": "http://other/", "date": "1998-01-01T00:00:00Z", "origin": "filedesc://b.arc:7"}
    (fields, block), = warc.parse_warc(warc.warc_value(*got[1], first))
    assert fields["warc-refers-to"] == warc.record_id("response", 1, "http://other/", "1998-01-01T00:00:00Z", "filedesc://b.arc:7") and fields["warc-refers-to-target-uri"] == "http://other/"
    assert fields["warc-ip-address"] == "10.0.0.2" and block == http[:-3]


def test_archive_of_other_bytes_than_utf8(spark, tmp_path):
    """Latin-1 text, an image, a revisit without a declared length; each record is a gzip member, long ones too."""
    image = bytes(range(256)) * 70_000
    bodies = {1: "caf\xe9".encode("latin-1"), 2: image, 3: b"", 4: "caf\xe9".encode("latin-1"), 5: b"\r\n\r\n\x00\x1f\x8b"}
    described = b"1 0 Crawler\nURL IP-address Archive-date Content-type Archive-length\n"
    data = b"filedesc://a.arc 10.0.0.1 19990102030405 text/plain %d\n%s\n" % (len(described), described)
    for k, body in bodies.items():
        http = b"HTTP/1.0 200 OK\r\nX-Page-Id: %d\r\n\r\n%s" % (k, body)
        data += b"http://a/same 10.0.0.2 19990102030406 text/html %d\n%s\n" % (len(http), http)
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc/a.arc").write_bytes(data)
    warc.write_warc(warc.read_arc(spark, f"{tmp_path}/arc"), f"{tmp_path}/warc")
    got = {r.page_id: r for r in warc.resolved(warc.read_warc(spark, f"{tmp_path}/warc")).collect()}
    assert {k: (r.payload_bytes, r.payload_digest) for k, r in got.items()} == {k: (len(b), warc.digest32(b)) for k, b in bodies.items()}
    assert (got[4].record_type, got[4].refers_to) == ("revisit", 1) and len({r.record_id for r in got.values()}) == 5
    files = [f.read_bytes() for f in (tmp_path / "warc").glob("part-*")]
    for content in files:
        for offset, part in warc.members(content):
            assert gzip.decompress(content)[:5] == b"WARC/" and zlib.decompressobj(31).decompress(content[offset:]) == part
            assert not part or len(list(warc.parse_warc(part))) == 1


def test_identifiers_of_repeated_rows_differ(spark):
    rows = [(1, "http://h/", "a"), (1, "http://h/", "a"), (None, "http://h/", "b"), (None, "http://h/", "b"), (2, None, "a"), (2, None, "c")]
    got = warc.convert_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    assert len({r.record_id for r in got}) == 6 and sorted(r.uri or "" for r in got) == ["", "", *["http://h/"] * 4]


def test_revisits_name_records_that_exist(spark):
    pages = spark.createDataFrame([(k, f"http://h{k}/", "same" if k % 2 else f"own {k}") for k in range(1, 20)], "page_id long, url string, html string")
    got = warc.convert_pages(pages.repartition(3)).collect()
    ids = {r.record_id: r for r in got}
    revisits = [r for r in got if r.record_type == "revisit"]
    assert len(revisits) == 9 and all(r.refers_to == 1 and ids[r.refers_to_id].page_id == 1 for r in revisits)
    assert len({r.date for r in got}) == 19


@pytest.mark.parametrize("name", ["content has-sidebar", "elementor-widget-container", "entry-content social-share", "page-header", "article-form", "sidebar"])
def test_names_do_not_drop_most_of_a_page(name):
    article = "<p>" + " ".join(["This is a sentence of the article."] * 40) + "</p>"
    page = f'<body><div class="menu"><a href="/">home</a></div><div class="{name}">{article}<div class="related">Read this too</div></div></body>'
    assert html.main_text(page) == " ".join(["This is a sentence of the article."] * 40)
    other = f'<body><div class="content">{article}</div><div class="{name}"><p>{"Some other words here. " * 5}</p></div></body>'
    assert html.main_text(other) == " ".join(["This is a sentence of the article."] * 40)


def test_leaks_equal_their_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
    want = con.execute(queries.ORACLES["op8_fm_leaks"]).fetchall()
    got = queries.QUERIES["op8_fm_leaks"](spark, data).select(*(c[0] for c in con.description)).collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_alignment_equals_dynamic_programming():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    draw = random.Random(7)
    for _ in range(200):
        a = [draw.randrange(5) for _ in range(draw.randrange(1, 30))]
        b = [x for x in a if draw.random() > 0.1] + [draw.randrange(5) for _ in range(draw.randrange(3))]
        for most in (0, 2, 9):
            d = distance(a, b)
            assert neardup.edits_within(np.array(a), np.array(b), most) == (d if d <= most else None)


@pytest.mark.parametrize("masked", [0, 4096])
def test_alignment_by_bits_equals_that_by_diagonals(monkeypatch, masked):
    monkeypatch.setattr(neardup, "MASKED", masked)
    draw, seen = random.Random(11), Counter()
    for _ in range(300):
        kinds, share = draw.choice([2, 20, 1000]), draw.choice([0.02, 0.1, 0.3])
        a = [draw.randrange(kinds) for _ in range(draw.randrange(1, 700))]
        b = [draw.randrange(kinds) if draw.random() < share / 2 else x for x in a if draw.random() > share / 2]
        a, b = (a, b) if draw.random() < 0.5 else (b, a)
        band = draw.choice([1, 5, 40, 130])
        if a and b and abs(len(a) - len(b)) <= band:
            want = neardup._by_diagonals(np.array(a), np.array(b), band)
            assert neardup._by_bits(a, b, band) == want
            seen[want is None] += 1
    assert min(seen.values()) > 20


def test_long_texts_are_aligned_in_little_time():
    """Edits of a tenth of 20,000 words: 2.3 CPU seconds row by row, 0.06 by bits on the same machine."""
    draw = random.Random(12)
    a = [draw.randrange(30_000) if draw.random() < 0.7 else draw.randrange(20) for _ in range(20_000)]
    b = [draw.randrange(30_000) if draw.random() < 0.1 else x for x in a]
    began = time.process_time()
    assert 1500 < neardup.edits_within(np.array(a), np.array(b), 4000) < 2500
    assert time.process_time() - began < 1


def test_components_of_a_chain(spark):
    links = spark.range(1, 40).select((F.col("id") * 7 % 41).alias("a"), ((F.col("id") + 1) * 7 % 41).alias("b"))
    assert {r.component for r in components.components(links, "a", "b").collect()} == {1}
    assert components.components(links.where("false"), "a", "b").count() == 0


def test_main_text():
    page = (
        "<html><head><title>no</title><style>p{}</style></head><body class='has-sidebar'><header>Site</header><nav><a href=/>x</a></nav><div id=cookie-notice>Cookies!</div>"
        "<div class='content'><article><h1>Head&amp;line</h1><p>First <b>part</b>ly\n text &lt;1&gt;.<p>Second&nbsp;one, <a href=/y>linked</a>.<script>var x='</p>'</script><form>Send</form>"
        "<ul class='related'><li>Other</li></ul></article></div><aside>Side</aside><section class=comments><p>A reader says so</p></section><footer>(c)</footer>"
    )
    assert html.main_text(page) == "Head&line First partly text <1>. Second one, linked."
    assert [html.main_text(x) for x in (None, "", "<", "<p", "plain", "<!-- x")] == ["", "", "<", "", "plain", ""]


def _paragraphs(n: int, times: int = 4) -> list[str]:
    return [" ".join([f"Sentence {k} says a thing about the weather."] * times) for k in range(n)]


NAV, FOOT = "<nav><a href=/>Home</a> <a href=/x>X</a></nav>", "<footer>Copyright</footer>"
BODY = "".join(f"<p>{x}</p>" for x in _paragraphs(30))
COMMENTS = [f"<b>user{k}</b><p>I think {x}</p>" for k, x in enumerate(_paragraphs(60, 3))]
ARTICLE = ["The title", "By A. Writer", *_paragraphs(30), "The end."]


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        *((f"{NAV}<{tag} class=post><h1>The title</h1><div class=byline>By A. Writer</div><div class=body>{BODY}</div><p>The end.</p></{tag}>{FOOT}", ARTICLE) for tag in ("div", "section", "article", "main")),
        (f"{NAV}<div id=page><div id=content><h1>The title</h1><span>By A. Writer</span><div class=body>{BODY}</div><p>The end.</p></div><div class=sidebar><h2>More</h2></div></div>{FOOT}", ARTICLE),
        (f"{NAV}<div class=text><h1>Short</h1><p>One paragraph.</p></div><div class=comments><h3>60 comments</h3>{''.join(f'<div class=comment>{c}</div>' for c in COMMENTS)}</div>{FOOT}", ["Short", "One paragraph."]),
        (f"{NAV}<div class=entry><h1>Short</h1>{''.join(f'<p>{x}</p>' for x in _paragraphs(3))}</div><ol class=comment-list>{''.join(f'<li class="comment depth-{k % 3}" id=comment-{k}>{c}</li>' for k, c in enumerate(COMMENTS[:10]))}</ol>{FOOT}", ["Short", *_paragraphs(3)]),
        (f"{NAV}{''.join(f'<section class=entry-share><p>{x}</p></section>' for x in _paragraphs(3, 8))}{FOOT}", _paragraphs(3, 8)),
        (f"{NAV}<div class='post has-comments'><div class=txt>{BODY}</div></div>{FOOT}", _paragraphs(30)),
    ],
)
def test_main_text_has_all_blocks_of_the_article_and_no_others(page, blocks):
    assert html.main_text(f"<html><body>{page}</body></html>") == " ".join(blocks)


def test_main_text_of_a_table(spark):
    pages = spark.createDataFrame([(1, None, None, "a"), (None, "u", "<p>x  y</p>", "b")], "page_id long, url string, html string, text string")
    assert {tuple(r) for r in html.extract_main_text(pages).collect()} == {(1, None, "", 0), (None, "u", "x y", 3)}


def test_shards_match_the_mixture(spark, docs, empty):
    rows = sharding.interleave(docs, 5).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(n)) for k, n in sizes.items())
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows}[8] == (7, zlib.crc32("Ärger".encode()))
    assert sharding.interleave(empty, 5).count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    per = sharding.interleave(many, 8).groupBy("shard", "source").count().collect()
    assert all(abs(r["count"] - (125 if r.source == "a" else 375)) <= 1 for r in per)


def test_mix_comes_near_its_targets(docs, empty):
    rows = mixing.pareto_mix(docs, [5.0, 2.0, 1.0]).collect()
    total = sum(r["size"] for r in rows)
    targets = {r.source: r.target for r in rows}
    assert math.isclose(sum(targets.values()), 1.5 * total)
    for source in targets:
        own = [r for r in rows if r.source == source]
        assert sum(r["size"] for r in own) == own[0].source_size and own[0].target <= 2 * own[0].source_size
        assert all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 2 for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own) / 2 + 1
    assert mixing.take_mix(docs, [5.0, 2.0, 1.0]).count() == sum(r.copies for r in rows)
    assert mixing.pareto_mix(empty, [1.0]).count() == 0


def test_language_model(spark, docs, empty):
    model, rare = lm.train(docs, max_frequent=50)
    rows = lm.score_texts(docs, model, rare).collect()
    tokens = {k: [w for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))] + ["\n"] for k, t in [*TEXTS.items(), (None, "no id")]}
    counts = Counter(w for t in tokens.values() for w in t) + Counter(tokens[4])
    n, v = sum(counts.values()), len(counts)
    assert (model.tokens, model.types) == (n, v)
    for r in rows:
        own = tokens[r.doc_id]
        assert r.n_tokens == len(own) == r.n_known and math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
    model, rare = lm.train(empty)
    assert [r.n_known for r in lm.score_texts(docs, model, rare).collect()] == [0] * docs.count()


def test_language_model_keeps_all_counts_in_blocks(docs):
    whole, rare = lm.train(docs, part_bytes=4096)
    blocked, _ = lm.train(docs, part_bytes=4096, max_filter_bytes=16384)
    counts = Counter(w for r in docs.where("text is not null").collect() for w in r.text.encode().lower().split())
    keys = np.array([lm.xxhash.xxh3_64_intdigest(w) for w in counts], np.uint64)
    levels = lm.level_of(np.array(list(counts.values()))) + 1
    for model in (whole, blocked):
        found = model.bloom.levels(keys)
        assert (found >= levels).all() and (found == levels).mean() > 0.8
    assert len(whole.bloom.blocks) == 1 < len(blocked.bloom.blocks) and max(b.value.nbytes for b in blocked.bloom.blocks) <= 16384
    scores = [{r.doc_id: r.score for r in lm.score_texts(docs, m, rare).collect()} for m in (whole, blocked)]
    assert scores[0] == pytest.approx(scores[1]) and len(scores[0]) == len(TEXTS) + 1


def test_bloom_filter_is_never_too_low():
    bloom = lm.LogBloom(4, 4000)
    keys = lm.mix(np.arange(1, 20_001, dtype=np.uint64))
    counts = np.arange(20_000) % 200 + 2
    bloom.enter(keys, lm.level_of(counts))
    found = bloom.levels(keys)
    assert (found >= lm.level_of(counts)).all() and (found == lm.level_of(counts)).mean() > 0.9


def test_urls(spark):
    link = '<a href="http://other.org/x">o</a><a href=/in>i</a>'
    rows = [(1, "http://A.Com/x?q", link), (2, "http://x.example.com/en/1", None), (3, "http://www.example.com/en/", ""), (4, "http://b.net/fr/", '<a href="https://third.org">t</a>'), (5, "http://other.org/", ""), (6, None, None), (7, "nothing", ""), (8, "http://bad.org/", '<a href="http://b.net/fr/">b</a>'), (9, "http://com", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), urls.RULES).collect()}
    assert got == {
        1: ("a.com", "/x", "com/", "allow"), 2: ("x.example.com", "/en/1", "example.com/en/", "block"), 3: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        4: ("b.net", "/fr/", "net/fr/", "block"), 5: ("other.org", "/", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("bad.org", "/", None, "block"), 9: ("com", "", None, "allow"),
    }


def test_archives(spark):
    bodies = {1: "x\r\n\r\ny", 2: None, 3: "x\r\n\r\ny", 4: "", 5: "WARC/1.0\r\n\n ü"}
    rows = [(k, None if k == 4 else f"http://h/{k} b", b) for k, b in bodies.items()] + [(None, "u", "x\r\n\r\ny")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.convert_pages(pages).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("revisit", 2), 5: ("response", None), None: ("response", None)}
    assert all((got[k].payload_bytes, got[k].payload_digest) == (len((b or "").encode()), warc.digest32((b or "").encode())) for k, b in bodies.items())
    assert warc.convert_pages(pages.where("false")).count() == 0


def test_leaks_equal_brute_force(spark, docs, empty):
    items = [(1, _text(90, 12)), (2, "a B, c"), (3, None), (4, "!!"), (5, _text(2, 100)), (5, _text(2, 100))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for options in ({}, {"shard_words": 50}, {"block_pairs": 7}):
        for r in decontamination.find_leaks(docs, bench, **options).where("doc_id is not null").collect():
            own, hit, found = words(TEXTS[r.doc_id]), set(), set()
            for item, text in items:
                w = words(text)
                for k in range(max(1, len(w) - 9) if w else 0):
                    p = w[k : k + 10]
                    for at in range(len(own) - len(p) + 1):
                        if own[at : at + len(p)] == p:
                            hit.update(range(at, at + len(p)))
                            found.add(str(item))
            assert (r.n_words, sum(s.end - s.first for s in r.spans), r["items"]) == (len(own), len(hit), sorted(found))
    cut = {r.doc_id: r.text for r in decontamination.without_leaks(docs, bench).collect()}
    assert cut[10].split() == (_text(4, 40) + " " + _text(5, 40)).split() and cut[1] == BASE and 4 not in cut and 11 not in cut
    assert decontamination.find_leaks(empty, bench).count() == 0 and decontamination.find_leaks(docs, bench.where("false")).where("size(spans) > 0").count() == 0


def test_quality_on_held_out_rows(spark):
    docs = spark.createDataFrame([(k, _text(k, 60) if k % 2 else " | ".join(["ZZ!!"] * 40) + _text(k, 20), None) for k in range(200)], "doc_id long, text string, n_chars long")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    fitted = quality.train_quality(docs, labels.where("doc_id < 100"), steps=200)
    rows = quality.score_quality(docs, fitted).where("doc_id >= 100").collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in rows) >= 98
    odd = spark.createDataFrame([(1, None, None), (2, "", -1)], "doc_id long, text string, n_chars long")
    assert all(0 <= r.score <= 1 for r in quality.score_quality(odd, quality.train_quality(docs, labels.where("false"))).collect())
    x, value = np.array([1, 5, 9]), np.array([0.5, 2.0, 1.0])
    w, v = np.arange(12.0), np.random.default_rng(0).normal(size=(12, 3))
    pairs = sum(v[x[i]] @ v[x[j]] * value[i] * value[j] for i in range(3) for j in range(i))
    assert math.isclose(quality.machine_scores(0.3, w, v, x, value, np.array([0]))[0], 0.3 + w[x] @ value + pairs)


def test_media_round_trip(docs, empty):
    for r in jpeg.text_media(docs).where("doc_id is not null").collect():
        raw = (TEXTS[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        media = jpeg.encode_payload(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
    assert jpeg.text_media(empty).count() == 0


def test_general_scans_agree_with_even_ones():
    samples = np.random.default_rng(2).integers(0, 256, 576 * 2).astype(np.uint8)
    image, _ = jpeg.parse_markers(jpeg.encode_image(samples), 0)
    assert (jpeg._levels_general(image).ravel() + 128 == samples).all()
    with pytest.raises(ValueError):
        jpeg.media_features(b"not an image")


def test_shards_are_cut_by_whole_numbers(spark):
    """Around all borders of large tables, where a division with few decimals goes wrong."""
    for n, k in ((100_000_000, 16), (1_000_000_007, 16), (3_000_000_000_019, 7), (5, 16), (1, 3)):
        at = sorted({p for j in range(k + 1) for p in range(n * j // k - 3, n * j // k + 4) if 0 <= p < n})
        rows = spark.createDataFrame([(p,) for p in at], "p long")
        shard, slot = sharding.shard_and_slot(F.col("p"), F.lit(n), k)
        got = {r.p: (r.shard, r.slot) for r in rows.select("p", shard.alias("shard"), slot.alias("slot")).collect()}
        assert got == {p: (p * k // n, p - -(-(p * k // n) * n // k)) for p in at}
