"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conversations import op13_conversation_repair
from .decontaminate import op4_decontamination
from .html_text import op9_html_text
from .lexical_search import op12_lexical_search
from .license_scan import op1_license_scan
from .mixing import op6_source_mix
from .quality import op7_quality_rules
from .secret_scan import op2_secret_scan
from .simhash import op10_simhash
from .token_count import op3_token_counts
from .toxicity import op5_toxicity
from .vector_search import op11_vector_search
from .warc import op8_warc_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (
        op1_license_scan, op2_secret_scan, op3_token_counts, op4_decontamination,
        op5_toxicity, op6_source_mix, op7_quality_rules,
        op8_warc_round_trip, op9_html_text, op10_simhash,
        op11_vector_search, op12_lexical_search, op13_conversation_repair)}

ORACLES: dict[str, str] = {
    "op8_warc_round_trip": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (html)""",
    "op11_vector_search": """WITH v AS (
  SELECT row_number() OVER () AS line, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.line, q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
  FROM v q JOIN v c ON q.line <> c.line WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY line ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank,
  vec_id, score FROM s QUALIFY rank <= 5""",
    "op12_lexical_search": """WITH w AS (
  SELECT line, doc_id, unnest(words) AS term FROM (SELECT row_number() OVER () AS line, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents)),
d AS (SELECT line, doc_id, count(*) AS n FROM w GROUP BY ALL),
t AS (SELECT count(*) AS docs, sum(n)::HUGEINT AS words FROM d),
q AS (SELECT DISTINCT item, item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)),
p AS (SELECT line, doc_id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, t GROUP BY term, docs),
s AS (SELECT item, item_id, line, doc_id, sum(weight * (1000000000 * tf // (1000 * tf + 8 * (10 + 90 * n * docs // words))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term) JOIN d USING (line, doc_id), t GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank,
  doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
}
