"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from formspark.llm.jaccard import op9_jaccard
from formspark.llm.langid import op6_langid
from formspark.llm.mixing import op1_mixing
from formspark.llm.packing import op7_packing
from formspark.llm.quality import op5_quality
from formspark.llm.repeats import op10_repeats
from formspark.llm.sharding import op4_sharding
from formspark.llm.vectors import op2_neardup, op3_neighbours
from formspark.llm.warc import op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_neardup": op2_neardup,
        "op3_neighbours": op3_neighbours,
        "op4_sharding": op4_sharding,
        "op5_quality": op5_quality,
        "op6_langid": op6_langid,
        "op7_packing": op7_packing,
        "op8_warc": op8_warc,
        "op9_jaccard": op9_jaccard,
        "op10_repeats": op10_repeats,
    }


#: SQL that gives a query's rows; the others are held against brute force in tests/llm.
ORACLE: dict[str, str] = {
    "op2_neardup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
            AND list_cosine_similarity(a.e, b.e) >= 0.9
        ), r(node, seen) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen
        ), c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
    """,
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
        d AS (SELECT *, sha1(html) AS hex FROM p)
        SELECT page_id, octet_length(encode(html)) AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + list_sum(list_transform(range(0, 5),
                lambda j: (((strpos('0123456789abcdef', substr(hex, (1 + (i * 5 + j) // 4)::INT, 1)) - 1) >> (3 - (i * 5 + j) % 4)::INT) & 1) << (4 - j)::INT)))::INT, 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM d
    """,
    "op9_jaccard": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), g AS (
            SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        s AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM s JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
        r(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
        c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id
        FROM documents d JOIN c ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
