"""The stages of the pipeline on small tables with nulls, empty texts, copies, benchmark passages and repeated rows."""

import random

import pytest

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)


def _text(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(f"wort{draw.randrange(400)}" for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    passage = _text(900, 20)
    good = [(k, _text(k, 60), f"s{k % 3}") for k in range(60)] + [(100, _text(1, 60), "s1"), (101, _text(2, 60) + " more", "s2"), (102, f"{_text(300, 30)} {passage} {_text(301, 30)}", "s0")]
    bad = [(k, " | ".join(["ZZ!!"] * 40) + _text(k, 5), "s1") for k in range(200, 260)]
    odd = [(300, None, None), (301, "", "s1"), (None, _text(77, 60), None), (7, _text(7, 60), "s1")]
    docs = spark.createDataFrame([(k, t, None, s, None if t is None else len(t), "x") for k, t, s in good + bad + odd], "doc_id long, text string, lang string, source string, n_chars long, shard string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k < 200), 0) for k, *_ in good + bad], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("b1", passage)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_all_stages(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    ids = {r.doc_id for r in rows}
    assert len(ids) > 40 and ids <= {*range(60), 102, 300, 301, None}
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) and max(r.shard for r in rows) < corpus_pipeline.SHARDS


@pytest.mark.parametrize("name", list(STAGES))
def test_a_stage_keeps_columns_and_takes_empty_tables(spark, tables, name):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = STAGES[name](spark, docs.where("false"), tables)
    assert out.count() == 0
    if name != "sharding":
        assert out.columns == docs.columns


def test_passages_are_cut_and_ids_told_apart(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    cut = {r.doc_id: r.text for r in STAGES["decontamination"](spark, docs, tables).collect()}
    assert cut[102].split() == (_text(300, 30) + " " + _text(301, 30)).split() and cut[300] is None and cut[301] == ""
    kept = [r.doc_id for r in STAGES["near_duplicates"](spark, docs.where("doc_id < 120 or doc_id >= 300 or doc_id is null"), tables).collect()]
    assert sorted(k for k in kept if k is not None) == [*range(60), 102, 300, 301] and kept.count(None) == 1
