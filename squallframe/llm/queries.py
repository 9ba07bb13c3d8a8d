"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from squallframe.llm.alignment import op11_token_alignment
from squallframe.llm.decontamination import op8_fm_leaks
from squallframe.llm.divergence import DIVERGENCE_SQL, op13_source_divergence
from squallframe.llm.html import op2_main_text
from squallframe.llm.jpeg import op10_jpeg_media
from squallframe.llm.lm import op4_bloom_lm
from squallframe.llm.mixing import op7_pareto_mix
from squallframe.llm.neardup import op1_order_minhash
from squallframe.llm.pii import op12_contextual_pii
from squallframe.llm.quality import op9_quality
from squallframe.llm.sharding import op3_interleaved_shards
from squallframe.llm.urls import op5_url_trust
from squallframe.llm.warc import op6_arc_to_warc

QUERIES = {
    "op1_order_minhash": op1_order_minhash,
    "op2_main_text": op2_main_text,
    "op3_interleaved_shards": op3_interleaved_shards,
    "op4_bloom_lm": op4_bloom_lm,
    "op5_url_trust": op5_url_trust,
    "op6_arc_to_warc": op6_arc_to_warc,
    "op7_pareto_mix": op7_pareto_mix,
    "op8_fm_leaks": op8_fm_leaks,
    "op9_quality": op9_quality,
    "op10_jpeg_media": op10_jpeg_media,
    "op11_token_alignment": op11_token_alignment,
    "op12_contextual_pii": op12_contextual_pii,
    "op13_source_divergence": op13_source_divergence,
}

WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: Windows are compared as strings here, position by position.
LEAKS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL} AS w FROM benchmark),
item_windows AS (
    SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS win
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
    SELECT row, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win
    FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN lengths ON len(w) >= n)
),
hits AS (SELECT DISTINCT row, n, k, item FROM doc_windows JOIN item_windows USING (n, win)),
positions AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(k, k + n)) AS p FROM hits) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN positions USING (row) LEFT JOIN items USING (row)
"""

#: The others can't be written in SQL: signatures with alignment, DOM trees, CRC-32, filters, ranks to a fixed point, archives,
#: a model fitted by gradient steps, images, tokenizers.
ORACLES: dict[str, str] = {"op8_fm_leaks": LEAKS_SQL, "op13_source_divergence": DIVERGENCE_SQL}
