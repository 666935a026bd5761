"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, html, langid, mixing, packing, quality, quotes, simhash, topk, urls


def queries():
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_langid": langid.op2_langid,
        "op3_quotes": quotes.op3_quotes,
        "op4_topk": topk.op4_topk,
        "op5_quality": quality.op5_quality,
        "op6_ann": ann.op6_ann,
        "op7_urls": urls.op7_urls,
        "op8_simhash": simhash.op8_simhash,
        "op9_html": html.op9_html,
        "op10_packing": packing.op10_packing,
    }


#: Integer inner products of every query with every other vector.
OP4_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v)),
placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 5
"""


def oracle_sql():
    return {"op4_topk": OP4_SQL, "op7_urls": urls.OP7_SQL}
