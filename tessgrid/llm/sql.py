"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

_BLANK = r"[\x20\x09-\x0D]"
_MARKS = r"^[ \t]*(?:>[ \t]*)+"

_THREADS = rf"""
, lines AS (
    SELECT conv_id, turn, unnest(string_split_regex(text, '\r\n|\r|\n')) AS line FROM told
), parsed AS (
    SELECT conv_id, turn, line,
           length(regexp_replace(regexp_extract(line, '{_MARKS}'), '[^>]', '', 'g')) AS level,
           lower(regexp_replace(trim(regexp_replace(line, '{_MARKS}', ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_BLANK}+', ' ', 'g')) AS norm
    FROM lines
), own AS (
    SELECT conv_id, norm, min(turn) AS source_turn FROM parsed WHERE level = 0 AND norm <> '' GROUP BY ALL
), links AS (
    SELECT q.conv_id, q.turn, q.level, o.source_turn, count(*) AS n
    FROM parsed q JOIN own o ON q.conv_id = o.conv_id AND q.norm = o.norm AND o.source_turn < q.turn
    WHERE q.level > 0 AND q.norm <> '' GROUP BY ALL
), parent AS (
    SELECT conv_id, turn, source_turn AS parent_turn FROM links
    QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, source_turn DESC) = 1
), threads AS (
    SELECT conv_id, turn, turn AS root_turn, CAST(turn AS VARCHAR) AS path, 0 AS depth,
           CAST(NULL AS BIGINT) AS parent_turn
    FROM told WHERE NOT EXISTS (SELECT 1 FROM parent p WHERE p.conv_id = told.conv_id AND p.turn = told.turn)
    UNION ALL
    SELECT p.conv_id, p.turn, t.root_turn, t.path || '.' || p.turn, t.depth + 1, p.parent_turn
    FROM parent p JOIN threads t ON p.conv_id = t.conv_id AND p.parent_turn = t.turn
)
SELECT m.conv_id, m.turn, m.role,
       trim(array_to_string(list_filter(string_split_regex(m.text, '\r\n|\r|\n'), lambda x: NOT regexp_matches(x, '{_MARKS}')), chr(10)), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS reply,
       len(list_filter(string_split_regex(m.text, '\r\n|\r|\n'), lambda x: regexp_matches(x, '{_MARKS}'))) AS n_quoted,
       coalesce((SELECT max(level) FROM parsed p WHERE p.conv_id = m.conv_id AND p.turn = m.turn), 0) AS quote_depth,
       t.parent_turn, t.root_turn, t.depth, t.path
FROM told m JOIN threads t USING (conv_id, turn)
"""

ORACLES = {
    "op1_exact_dedup": rf"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_points,
           regexp_replace(coalesce(text, ''), '{_BLANK}', '', 'g') AS norm
    FROM documents
), g AS (
    SELECT norm, arg_min(doc_id, struct_pack(a := -n_points, b := doc_id)) AS keep_id, count(*) AS group_size
    FROM d GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
""",
    "op4_quotation_linking": f"WITH RECURSIVE told AS (SELECT conv_id, turn, role, text FROM conversations){_THREADS}",
    "quoted_conversations": f"""
WITH RECURSIVE told AS (
    SELECT m.conv_id, m.turn, m.role,
           concat_ws(chr(10), '> > ' || string_split(b.text, chr(10))[1],
                     '> ' || string_split(a.text, chr(10))[1], m.text) AS text
    FROM conversations m
    LEFT JOIN conversations a ON a.conv_id = m.conv_id AND a.turn = m.turn - 1
    LEFT JOIN conversations b ON b.conv_id = m.conv_id AND b.turn = m.turn - 2
){_THREADS}""",
    "op7_pivot_topk": """
WITH d AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
    FROM d AS q JOIN d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
""",
    "op8_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
    FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM shared JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y
    WHERE 100 * k >= 80 * (p.n + q.n - k)
), edges AS (
    SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
    SELECT x AS doc_id, x AS other FROM edges UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other
), least_of AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_of c USING (doc_id)
""",
    "op9_mixing": rf"""
WITH d AS (
    SELECT doc_id, source,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10) AS BIGINT) AS h
    FROM documents
), s AS (
    SELECT source, sum(size) AS source_size,
           [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
    FROM d GROUP BY source
), capped AS (
    SELECT *, (CAST(150 * sum(source_size) OVER () AS DOUBLE) / 100
               - coalesce(sum(2 * source_size) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (up ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
           CAST(2 * source_size AS DOUBLE) / weight AS bound
    FROM s WINDOW up AS (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source NULLS LAST)
), targets AS (
    SELECT source, source_size,
           least(CAST(2 * source_size AS DOUBLE),
                 coalesce(max(level) FILTER (WHERE level <= bound) OVER () * weight, 2 * source_size)) AS target
    FROM capped
), plan AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
    FROM targets
), running AS (
    SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto
    FROM (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h)
), ends AS (
    SELECT p.source, p.source_size, p.target, p.whole,
           min_by(r.h + CASE WHEN (p.target - p.whole * p.source_size - (r.upto - r.words)) * 2 > r.words
                             THEN 1 ELSE 0 END, r.h) AS below
    FROM plan p LEFT JOIN running r ON r.source IS NOT DISTINCT FROM p.source
         AND r.upto > p.target - p.whole * p.source_size
    GROUP BY ALL
)
SELECT d.doc_id, d.size, CAST(e.source_size AS BIGINT) AS source_size, e.target,
       CAST(d.size * (e.whole + CASE WHEN d.h < e.below THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN ends e ON d.source IS NOT DISTINCT FROM e.source
""",
    "op11_bwt_dedup": """
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id, 9223372036854775807) AS id,
           hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
    SELECT row, id, i, substr(h, 2 * i + 1, 100) AS s
    FROM (SELECT row, id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)
), gone AS (
    SELECT row, i FROM (SELECT row, id, i, min(id) OVER (PARTITION BY s) AS first FROM w) WHERE first < id
), runs AS (
    SELECT row, i, sum(new) OVER (PARTITION BY row ORDER BY i) AS run
    FROM (SELECT row, i, CASE WHEN i - lag(i) OVER (PARTITION BY row ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM gone)
), spans AS (
    SELECT row, run, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY row, run
), pieces AS (
    SELECT row, a, substr(d.h, 2 * coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) + 1,
                          2 * (a - coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0))) AS part, b
    FROM spans JOIN d USING (row)
), kept AS (
    SELECT row, string_agg(part, '' ORDER BY a) AS head, max(b) AS last, count(*) AS n_spans FROM pieces GROUP BY row
), removed AS (
    SELECT row, sum(b - a) AS n_removed FROM spans GROUP BY row
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN kept USING (row) LEFT JOIN removed USING (row)
""",
    "op12_prefix_trie": r"""
WITH t AS (
    SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT c, id, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, id) AS i FROM t
), convs AS (
    SELECT c, c - c % 20 AS base, list_reduce(list_concat([4294967295], flatten(list_transform(
               string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS crc
    FROM (SELECT DISTINCT c FROM t)
), heads AS (
    SELECT c, base, xor(crc, 4294967295) % 4 AS h FROM convs
), made AS (
    SELECT h.c, o.i, o.id, o.words FROM heads h JOIN own o ON o.c = h.base AND o.i <= h.h
    UNION ALL
    SELECT h.c, 1000000000 + o.i, o.id, o.words FROM heads h JOIN own o ON o.c = h.c AND o.i > h.h
), seq AS (
    SELECT c, id, words, row_number() OVER (PARTITION BY c ORDER BY i) AS depth FROM made
), prefixes AS (
    SELECT c, depth, words, md5(string_agg(id, ',') OVER (PARTITION BY c ORDER BY depth)) AS node FROM seq
    UNION ALL
    SELECT c, 0, 0, '' FROM heads
), lengths AS (
    SELECT c, max(depth) AS len FROM prefixes GROUP BY c
), nodes AS (
    SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, min(words) AS words,
           string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len = depth) AS ends
    FROM prefixes JOIN lengths USING (c) GROUP BY node, depth
), linked AS (
    SELECT n.*, p.node AS parent FROM nodes n
    LEFT JOIN prefixes p ON p.c = n.conv_id AND p.depth = n.depth - 1
), kids AS (
    SELECT parent AS node, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY parent
), below AS (
    SELECT p.node, sum((u.n_convs - 1) * u.words) AS saved, count(*) FILTER (WHERE k.node IS NULL) AS leaves
    FROM nodes u LEFT JOIN kids k ON k.node = u.node
    JOIN prefixes p ON p.c = u.conv_id AND p.depth <= u.depth GROUP BY p.node
)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
       b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM linked n LEFT JOIN nodes q ON q.node = n.parent LEFT JOIN kids k ON k.node = n.node JOIN below b ON b.node = n.node
""",
    "op13_phrases": r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), totals AS (
    SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang
), grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: list_slice(ws, i, i + k - 1))) AS g
    FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)
), often AS (
    SELECT lang, k, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
    SELECT lang, k, g, f, unnest(range(1, k)) AS j FROM often WHERE k > 1
), scores AS (
    SELECT c.lang, c.k, c.g, c.f AS a, j, x.f AS l, y.f AS r,
           CAST((CAST(2000000 AS HUGEINT) * c.f) // (x.f + y.f) AS BIGINT) AS score
    FROM cuts c JOIN often x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, j)
    JOIN often y ON y.lang = c.lang AND y.g = list_slice(c.g, j + 1, c.k)
), worst AS (
    SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1
), inside AS (
    SELECT lang, f, unnest(list_transform(flatten(list_transform(range(2, k), lambda m:
               list_transform(range(1, k - m + 2), lambda i: [i, i + m - 1]))), lambda e: list_slice(g, e[1], e[2]))) AS g
    FROM often WHERE k > 2
), covered AS (
    SELECT lang, g, max(f) AS most FROM inside GROUP BY ALL
), kept AS (
    SELECT w.*, array_to_string(w.g, ' ') AS phrase FROM worst w LEFT JOIN covered c ON c.lang = w.lang AND c.g = w.g
    WHERE c.most IS NULL OR 100 * c.most < 80 * w.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
""",
}
