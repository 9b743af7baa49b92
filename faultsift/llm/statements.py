"""DuckDB statements for the queries that SQL can express on whole tables."""

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

# The patterns of faultsift.llm.secrets, spelled for SQL strings.
_VALUE = r"""["'']?\x20*[:=]\x20*["'']?"""
_PATTERNS = {
    "assign": rf"(?i)(password|passwd|secret|token|api_?key){_VALUE}([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]{16,}",
    "login": rf"(?i)(?:username|user|login|client_id|account){_VALUE}[A-Za-z0-9@._-]{{3,}}",
    "endpoint": r"""(?:https?|ftp|ssh|jdbc:[a-z]+|mongodb|postgres|mysql|redis|amqp)://[^\s"''<>|]+"""}
_HITS = " UNION ALL ".join(f"""
    SELECT rid, '{kind}' AS kind, i, hits[i] AS hit,
           (list_sum(list_transform(gaps[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::INTEGER AS a
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT rid, regexp_extract_all(s, '{regex}', 0) AS hits, string_split_regex(s, '{regex}') AS gaps FROM t)
        WHERE len(hits) > 0)""" for kind, regex in _PATTERNS.items())
_NEAR = "o.rid = p.rid AND o.a <= p.b + 160 AND o.b >= p.a - 160"
_ROLES = {role: f"EXISTS (SELECT 1 FROM part o WHERE {_NEAR} AND o.kind IN ({kinds}))" for role, kinds in {
    "secret": "'assign', 'hex', 'weak_secret'", "who": "'access', 'weak_access', 'login'",
    "endpoint": "'endpoint'"}.items()}

STATEMENTS = {
    "op4_secrets": f"""
        WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS s FROM documents),
        found AS ({_HITS}),
        part AS (
            SELECT rid, a, a + length(hit) AS b, CASE
                WHEN kind = 'assign' AND size >= 12 THEN 'assign' WHEN kind = 'assign' AND size >= 6 THEN 'weak_secret'
                WHEN kind = 'access' AND length(hit) >= 18 THEN 'access' WHEN kind = 'access' THEN 'weak_access'
                WHEN kind <> 'assign' THEN kind END AS kind
            FROM (SELECT *, length(regexp_extract(hit, '{_PATTERNS["assign"]}', 2)) AS size FROM found)),
        base AS (SELECT * FROM part WHERE kind IN ('assign', 'access', 'hex')),
        linked AS (
            SELECT * FROM part p
            WHERE kind IN ('weak_secret', 'weak_access', 'login', 'endpoint')
              AND NOT EXISTS (SELECT 1 FROM base o WHERE o.rid = p.rid AND o.a <= p.a AND p.b <= o.b)
              AND CASE WHEN kind = 'weak_secret' THEN {_ROLES["who"]} OR {_ROLES["endpoint"]}
                       WHEN kind = 'endpoint' THEN {_ROLES["secret"]} AND {_ROLES["who"]} ELSE {_ROLES["secret"]} END),
        told AS (
            SELECT *, kind || ':' || a || ':' || b AS said, list_position(
                ['assign', 'access', 'hex', 'weak_secret', 'weak_access', 'login', 'endpoint'], kind) AS turn
            FROM (FROM base UNION ALL FROM linked)),
        docs AS (
            SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                   count(*) FILTER (kind = 'hex') AS n_hex, string_agg(said, ',' ORDER BY a, turn) AS spans,
                   string_agg(said, ',' ORDER BY a, turn) FILTER (turn <= 3) AS base
            FROM told GROUP BY rid)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM t LEFT JOIN docs USING (rid)""",
    "op3_top_k": """
        WITH kept AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        scored AS (
            SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
               vec_id, score
        FROM scored QUALIFY rank <= 10""",
    "op5_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        win AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS key
            FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
        part AS (
            SELECT rid, k, n, array_to_string(w[k:k + n - 1], ' ') AS key
            FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
        hit AS (SELECT DISTINCT rid, k, n, item_id FROM part JOIN win USING (key, n)),
        words AS (
            SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM hit) GROUP BY rid),
        items AS (
            SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit) GROUP BY rid)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
               coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)""",
    "op6_url_filters": r"""
        WITH cut AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0, 's'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
            FROM cut),
        fits AS (
            SELECT *, CASE
                WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
            FROM parts)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM fits""",
    # For pages that mark their article, as all given ones do: its blocks, read off the tags.
    "op11_main_text": r"""
        WITH art AS (SELECT page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS body FROM pages),
        blocks AS (
            SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1)>'), lambda b: trim(regexp_replace(
                regexp_replace(replace(replace(replace(replace(regexp_replace(replace(b, '<br>', ' '),
                    '<[^>]*>', '', 'g'), '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'),
                    '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts
            FROM art)
        SELECT page_id, url, array_to_string(list_filter(parts, lambda b: b <> ''), chr(10)) AS text,
               length(array_to_string(list_filter(parts, lambda b: b <> ''), chr(10))) AS n_chars
        FROM blocks""",
    "op13_lexical_search": r"""
        WITH t AS (
            SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        totals AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM t),
        tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM t) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        asked AS (
            SELECT DISTINCT iid, item_id, unnest(w) AS term FROM (
                SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(coalesce(text, ''),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL)),
        scored AS (
            SELECT iid, item_id, doc_id, rid, sum(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT
                * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * n_docs) // n_terms))))::BIGINT AS score
            FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN t USING (rid), totals
            WHERE doc_id IS NOT NULL GROUP BY iid, item_id, doc_id, rid)
        SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 10""",
}
