"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from gleanworks.llm import centroids
from gleanworks.llm.alignment import op12_alignment
from gleanworks.llm.bytebpe import op13_bytes
from gleanworks.llm.centroids import op11_centroids
from gleanworks.llm.langid import op1_language_id
from gleanworks.llm.licenses import op9_licenses
from gleanworks.llm.media import op4_media
from gleanworks.llm.mixing import op8_mixing
from gleanworks.llm.neardup import op10_near_duplicates
from gleanworks.llm.packing import op6_packing
from gleanworks.llm.sharding import op2_sharding
from gleanworks.llm.toxicity import op7_toxicity
from gleanworks.llm.vectorjoin import op3_vector_join
from gleanworks.llm.wrappers import op5_html

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_sharding": op2_sharding,
    "op3_vector_join": op3_vector_join,
    "op4_media": op4_media,
    "op5_html": op5_html,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_licenses": op9_licenses,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_centroids": op11_centroids,
    "op12_alignment": op12_alignment,
    "op13_bytes": op13_bytes,
}
ORACLES: dict[str, str] = {
    "op3_vector_join": """
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.n, l.b FROM reach AS r JOIN links AS l ON l.a = r.m),
component AS (SELECT n AS vec_id, min(m) AS component_id FROM reach GROUP BY n),
counts AS (SELECT a AS vec_id, count(DISTINCT b) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
FROM embeddings LEFT JOIN component USING (vec_id) LEFT JOIN counts USING (vec_id)""",
    "op10_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM rows AS a JOIN rows AS b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(n, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.n, l.b FROM reach AS r JOIN links AS l ON l.a = r.m),
component AS (SELECT n AS doc_id, min(m) AS component_id FROM reach GROUP BY n)
SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles, component_id, coalesce(doc_id = component_id, true) AS kept FROM s LEFT JOIN component USING (doc_id)""",
    "op11_centroids": centroids.SQL,
}
