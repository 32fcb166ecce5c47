"""DuckDB SQL of the corpus queries that SQL can express."""

ORACLE = {
    # Which records the known damage touches, with the offsets both copies give them.
    "op3_merkle_fixity": """
        WITH rec AS (
            SELECT coalesce(page_id // 1000, -1) AS file, page_id,
                   strlen('WARC/1.1') + 2 + strlen('WARC-Type: resource') + 2
                   + strlen('WARC-Target-URI: ') + strlen(coalesce(url, '')) + 2
                   + strlen('WARC-Record-ID: <urn:page:>') + strlen(coalesce(page_id::VARCHAR, ''))
                   + 2 + strlen('Content-Length: ') + strlen(strlen(coalesce(html, ''))::VARCHAR)
                   + 4 + strlen(coalesce(html, '')) + 4 AS n_bytes
            FROM pages),
        placed AS (
            SELECT file, page_id,
                   row_number() OVER (PARTITION BY file ORDER BY page_id) - 1 AS seq,
                   coalesce(sum(n_bytes) OVER (PARTITION BY file ORDER BY page_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
            FROM rec)
        SELECT file, seq, page_id AS first_id,
               CASE WHEN page_id % 1000 <> 999 THEN page_id END AS second_id,
               begins AS first_offset,
               CASE WHEN page_id % 1000 <> 999 THEN begins END AS second_offset,
               CASE WHEN page_id % 1000 = 999 THEN 'missing' ELSE 'changed' END AS fault
        FROM placed WHERE page_id % 97 = 13 OR page_id % 1000 = 999
    """,
    # Every 200-byte string of every text, by its digest; runs of covered bytes; the rest.
    "op2_repeated_passages": """
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b
            FROM documents),
        strings AS (
            SELECT r, i, md5(b[i + 1:i + 200]) AS s
            FROM (SELECT r, b, unnest(range(0, octet_length(b) - 199)) AS i FROM docs)),
        again AS (
            SELECT r, i FROM strings
            WHERE s IN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1)),
        marked AS (
            SELECT r, i, coalesce(i > lag(i) OVER w + 200, true)::INTEGER AS opens
            FROM again WINDOW w AS (PARTITION BY r ORDER BY i)),
        numbered AS (
            SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS run FROM marked),
        runs AS (
            SELECT r, min(i) AS begins, max(i) + 200 AS ends FROM numbered GROUP BY r, run),
        gaps AS (
            SELECT r, begins, ends,
                   coalesce(lag(ends) OVER (PARTITION BY r ORDER BY begins), 0) AS kept_from
            FROM runs),
        cut AS (
            SELECT r, count(*) AS n_spans, sum(ends - begins)::BIGINT AS n_removed,
                   max(ends) AS last_end,
                   string_agg(hex(b[kept_from + 1:begins]), '' ORDER BY begins) AS kept
            FROM gaps JOIN docs USING (r) GROUP BY r)
        SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
               coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, '') || hex(b[coalesce(last_end, 0) + 1:octet_length(b)])))
                   AS kept_sha256
        FROM docs LEFT JOIN cut USING (r)
    """,
    # All pairs that share a shingle, and the closure of their links.
    "op5_setsketch_near_duplicates": r"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sets AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i
                  FROM docs WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        links AS (
            SELECT p.x, p.y
            FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
                  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
                  GROUP BY a.doc_id, b.doc_id) p
            JOIN sizes sx ON sx.doc_id = p.x JOIN sizes sy ON sy.doc_id = p.y
            WHERE 100 * shared >= 80 * (sx.n + sy.n - shared)),
        reach(x, y) AS (
            SELECT doc_id, doc_id FROM docs
            UNION
            SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
        least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id,
               doc_id = component_id AS kept
        FROM docs LEFT JOIN sizes USING (doc_id) JOIN least ON least.x = doc_id
    """,
    # All pairs of vectors of one length, and the closure of their links.
    "op7_pq_near_vectors": """
        WITH RECURSIVE whole AS (
            SELECT vec_id, embedding::DOUBLE[] AS e
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
              AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS x, b.vec_id AS y
            FROM whole a JOIN whole b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        reach(x, y) AS (
            SELECT vec_id, vec_id FROM embeddings
            UNION
            SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
        least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
        degrees AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id,
               vec_id = component_id AS kept
        FROM embeddings JOIN least ON least.x = vec_id LEFT JOIN degrees ON degrees.x = vec_id
    """,
    # Positives and negatives by all inner products of the anchors.
    "op11_cover_tree_negatives": """
        WITH rows AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        pairs AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike,
                   list_inner_product(a.x, b.x)::BIGINT AS score
            FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score
            FROM pairs WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT p.anchor_id, p.positive_id,
               row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
                   ORDER BY n.score DESC, n.other_id)::INTEGER AS rank,
               n.other_id AS negative_id, p.positive_score, n.score AS negative_score
        FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.alike
         AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
        QUALIFY rank <= 10
    """,
}
