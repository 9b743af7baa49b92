"""DuckDB statements that answer each registered query by other means.

Common table expressions are kept by name; a statement pulls in the ones it mentions.
"""

from __future__ import annotations

import re

from faultsift.functions.frames import JAVA_VENDOR_PREFIXES  # fixed values only

CTE: dict[str, str] = {}
STATEMENTS: dict[str, str] = {}

JAVA = r"^\s*at\s+(?:([\w.$]+)/)?([\w.$]+)\.([\w$<>]+)\(([^)]*)\)\s*$"
V8 = r"^\s*at\s+(?:(.*?)\s+\((.*)\)|(.*?))\s*$"
VENDOR = "^(" + "|".join(p.replace(".", "\\.") for p in JAVA_VENDOR_PREFIXES) + ")"


def blank(c: str) -> str:
    return f"({c} IS NULL OR NOT regexp_matches({c}, '\\S'))"


def stripped(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def normalized(c: str) -> str:
    rules = [
        (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
         "<uuid>"),
        (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b",
         "<timestamp>"),
        (r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b", "<ip>"),
        (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "<email>"),
        (r"\b[a-zA-Z][a-zA-Z0-9+.-]*://\S+", "<url>"),
        (r"(?:[A-Za-z]:)?[\\/](?:[\w.-]+[\\/]){2,}[\w.-]*", "<path>"),
        (r"\b0x[0-9a-fA-F]+\b", "<hex>"),
        (r"\b[0-9a-fA-F]{8,}\b", "<hex>"),
        (r"\b\d[\d_,]*(?:\.\d+)?\b", "<num>"),
    ]
    out = stripped(c)
    for pattern, tag in rules:
        out = f"regexp_replace({out}, '{pattern}', '{tag}', 'g')"
    collapsed = f"regexp_replace({out}, '\\s+', ' ', 'g')"
    return f"coalesce({stripped(collapsed)}, '')"


def build(final: str) -> str:
    """Prefix a statement with the expressions it needs, in dependency order."""
    ordered: list[str] = []

    def need(sql: str) -> None:
        for name in CTE:
            if name not in ordered and re.search(rf"\b{name}\b", sql):
                if CTE[name] is not sql:
                    need(CTE[name])
                    if name not in ordered:
                        ordered.append(name)

    need(final)
    if not ordered:
        return final
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in ordered)
    lead = "WITH RECURSIVE" if "emit_" in ctes else "WITH"
    if final.startswith("WITH "):
        return f"{lead} {ctes},\n{final[5:]}"
    return f"{lead} {ctes}\n{final}"


# == the error feed ================================================================================
CTE["c_base"] = """
SELECT event_id AS r, user_id AS u, event_type, ts,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       CAST(round(value * 100) AS BIGINT) AS cents, md5(CAST(event_id AS VARCHAR)) AS d,
       CASE WHEN k < 35 THEN 'checkout' WHEN k < 55 THEN 'node' WHEN k < 65 THEN 'vendor'
            WHEN k < 72 THEN 'minified' WHEN k < 78 THEN 'mislabelled' WHEN k < 95 THEN 'plain'
            ELSE 'nested' END AS family,
       substr(d,1,8) || '-' || substr(d,9,4) || '-' || substr(d,13,4) || '-' || substr(d,17,4)
         || '-' || substr(d,21,12) AS uid,
       r % 500 + 1 AS ln, k % 4 AS v
FROM events"""

CTE["c_traced"] = r"""
SELECT *,
  CASE family
  WHEN 'checkout' THEN 'java.lang.IllegalStateException: cart is empty' || chr(10) || chr(9)
    || 'at com.acme.checkout.CartService.total(CartService.java:' || ln || ')' || chr(10) || chr(9)
    || 'at com.acme.checkout.Cart$Line.lambda$sum$' || (u % 10) || '(Cart.java:88)' || chr(10)
    || chr(9) || 'at java.base/java.lang.reflect.Method.invoke(Method.java:580)' || chr(10)
    || chr(9) || 'at org.springframework.web.Handler.invoke(Handler.java:255)' || chr(10)
    || 'Caused by: java.lang.NullPointerException: total' || chr(10)
    || chr(9) || 'at com.acme.checkout.Price.of(Price.java:' || ln || ')' || chr(10)
    || chr(9) || '... 46 common frames omitted'
  WHEN 'vendor' THEN 'org.postgresql.util.PSQLException: connection refused' || chr(10) || chr(9)
    || 'at org.postgresql.Driver.connect(Driver.java:' || ln || ')' || chr(10) || chr(9)
    || 'at com.zaxxer.hikari.pool.HikariPool.<init>(Unknown Source)'
  WHEN 'minified' THEN 'Error: x' || chr(10) || '    at a (https://cdn.example.com/bundle.min.js:1:'
    || ln || ')' || chr(10) || '    at b (https://cdn.example.com/bundle.min.js:1:77)'
  WHEN 'nested' THEN 'com.acme.ledger.PostingException: unbalanced' || chr(10) || chr(9)
    || 'at com.acme.ledger.Book$Entry.post(Book.java:' || ln || ')' || chr(10) || chr(9)
    || 'at com.acme.ledger.Batch.run(Loader' || v || '.java:9)' || chr(10) || chr(9)
    || 'at com.acme.ledger.Main.main(Main.java)'
  WHEN 'plain' THEN NULL
  ELSE 'TypeError: Cannot read properties of undefined' || chr(10)
    || '    at Session.load' || (k % 2) || ' (/app/' || u || '/src/services/user.js:' || ln || ':18)'
    || chr(10) || '    at async handler (file:///srv/dist/routes/cart.mjs:12:22)' || chr(10)
    || '    at new Checkout (C:\work\lib\checkout.ts:7:1)' || chr(10)
    || '    at Layer.handle [as handle_request] (/app/node_modules/express/lib/router/layer.js:95:5)'
    || chr(10) || '    at async Promise.all (index 0)' || chr(10) || '    at /app/index' || v
    || '.js:3:9' || chr(10)
    || '    at processTicksAndRejections (node:internal/process/task_queues:95:5)'
  END AS trace
FROM c_base"""

CTE["c_feed"] = r"""
SELECT CASE WHEN r % 211 <> 0 THEN uid END AS event_id,
  CASE WHEN event_type = 'signup' AND day(ts) % 10 = 0 THEN ts - INTERVAL 1 DAY
       WHEN k % 10 = 0 THEN date_trunc('day', ts) + INTERVAL 13 HOUR + (ts - date_trunc('hour', ts))
       ELSE ts END + INTERVAL 5 MINUTE * copy AS received_at,
  copy AS seq,
  CASE WHEN r % 101 = 7 THEN '' WHEN k < 35 THEN 'checkout-api' ELSE event_type || '-svc' END
    AS service,
  CASE WHEN r % 103 = 9 THEN repeat('x', 21) WHEN event_type = 'error' THEN 'error'
       WHEN r % 3 = 0 THEN 'warning' ELSE 'info' END AS level,
  CASE WHEN r % 97 = 5 THEN '   ' WHEN r % 109 = 11 THEN repeat('m', 4001)
    ELSE CASE r % 8
      WHEN 0 THEN 'order ' || uid || ' not found'
      WHEN 1 THEN 'connection to 10.0.' || k || '.' || (u % 256) || ':5432 refused'
      WHEN 2 THEN 'user user' || u || '@example.com is unknown'
      WHEN 3 THEN 'GET https://api.example.com/v2/carts/' || r || ' failed'
      WHEN 4 THEN 'retry ' || k || ' of 5 after ' || cents || ' ms'
      WHEN 5 THEN 'expected at ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
      WHEN 6 THEN 'object at 0x' || substr(d, 1, 8) || ' checksum ' || d || ' mismatch'
      ELSE 'cannot read /var/lib/app/' || k || '/cache.db   twice' || chr(10) || chr(9) || 'again'
    END END AS message,
  CASE WHEN family = 'mislabelled' THEN 'java' WHEN r % 4 = 0 THEN NULL WHEN r % 4 = 1 THEN 'python'
       WHEN family IN ('checkout', 'vendor', 'nested')
         THEN CASE WHEN r % 50 = 2 THEN ' Scala ' ELSE 'java' END
       WHEN family IN ('node', 'minified') THEN 'TypeScript' END AS platform,
  CASE WHEN r % 7 = 0 THEN NULL WHEN r % 7 = 1 THEN ' '
    ELSE CASE family WHEN 'checkout' THEN 'java.lang.IllegalStateException'
      WHEN 'node' THEN 'TypeError' WHEN 'mislabelled' THEN 'TypeError'
      WHEN 'vendor' THEN 'org.postgresql.util.PSQLException$$Lambda$14/0x' || substr(d, 1, 6)
      WHEN 'minified' THEN 'Error'
      WHEN 'nested' THEN 'com.acme.ledger.PostingException$' || (u % 9)
      ELSE CASE WHEN r % 3 <> 0 THEN 'com.acme.Plain.' END END END AS exception_type,
  CASE WHEN r % 7 = 2 AND family NOT IN ('node', 'mislabelled') THEN NULL ELSE trace END
    AS stacktrace,
  CASE WHEN r % 7 = 0 THEN NULL WHEN r % 7 = 1 THEN ' '
       WHEN r % 6 <> 0 THEN '1.' || day(ts) || '.0' END AS release,
  CASE WHEN r % 7 = 0 THEN '{"k":' || k || ',"exceptionType":"com.acme.Legacy$1","release":"0.9.'
         || (k % 3) || '"}'
       WHEN r % 7 = 1 THEN '{"k":' || k || ',"exceptionType":["x"],"release":' || k || '}'
       WHEN r % 7 = 2 AND trace IS NOT NULL AND family NOT IN ('node', 'mislabelled')
         THEN '{"k":' || k || ',"stacktrace":["'
           || replace(replace(trace, chr(9), '    '), chr(10), '","') || '", 3, null]}'
       ELSE '{"k":' || k || '}' END AS payload
FROM c_traced, (VALUES (0), (1)) AS c(copy) WHERE copy = 0 OR r % 10 = 3"""

_RULES = [("service", "service", 100, True), ("level", "level", 20, True),
          ("message", "message", 4000, True), ("platform", "platform", 50, False),
          ("exceptionType", "exception_type", 500, False),
          ("stacktrace", "stacktrace", 20000, False), ("release", "release", 100, False)]
_CHECKS = ", ".join(
    part for field, c, n, must in _RULES for part in
    ([f"CASE WHEN {blank(c)} THEN '{field} must not be blank' END"] if must else [])
    + [f"CASE WHEN length({c}) > {n} THEN '{field} size must be between 0 and {n}' END"])

CTE["c_checked"] = f"""
SELECT * REPLACE (coalesce(event_id, sha256(
    coalesce(service, '') || chr(1) || coalesce(level, '') || chr(1) || coalesce(message, '')
    || chr(1) || coalesce(stacktrace, '') || chr(1) || coalesce(payload, '') || chr(1)
    || CAST(epoch_us(received_at) AS VARCHAR))) AS event_id),
  list_min([{_CHECKS}]) AS error
FROM c_feed"""


def _legacy(c: str, field: str) -> str:
    return (f"CASE WHEN NOT {blank(c)} THEN {c} "
            f"WHEN json_type(payload, '$.{field}') = 'VARCHAR' "
            f"THEN json_extract_string(payload, '$.{field}') END")


def _resolved(source: str) -> str:
    return f"""
SELECT * REPLACE ({_legacy('exception_type', 'exceptionType')} AS exception_type,
  {_legacy('release', 'release')} AS release,
  CASE WHEN NOT {blank('stacktrace')} THEN stacktrace
       WHEN json_type(payload, '$.stacktrace') = 'VARCHAR'
         THEN json_extract_string(payload, '$.stacktrace')
       WHEN json_type(payload, '$.stacktrace') = 'ARRAY'
         THEN array_to_string(list_transform(json_extract(payload, '$.stacktrace[*]'),
           lambda e: CASE WHEN json_type(e) = 'NULL' THEN 'null'
                     ELSE json_extract_string(e, '$') END), chr(10)) END AS stacktrace)
FROM {source}"""


CTE["c_resolved_feed"] = _resolved("c_checked")
CTE["c_winners"] = """
SELECT * FROM c_checked WHERE error IS NULL
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY received_at, seq) = 1"""
CTE["c_unique"] = _resolved("c_winners")

# == fingerprints ====================================================================================
CTE["c_confident"] = rf"""
SELECT *,
  CASE WHEN {blank('stacktrace')} THEN 0 ELSE least(100,
    (CASE WHEN contains(stacktrace, '.java:') THEN 50 ELSE 0 END)
    + (CASE WHEN contains(stacktrace, 'Caused by:') THEN 20 ELSE 0 END)
    + (CASE WHEN contains(stacktrace, 'more') OR contains(stacktrace, 'common frames omitted')
       THEN 10 ELSE 0 END)
    + (CASE WHEN regexp_matches(coalesce(list_filter(
         string_split_regex(stacktrace, '\r\n|\n|\r'),
         lambda l: starts_with({stripped('l')}, 'at '))[1], ''), '{JAVA}') THEN 30 ELSE 0 END))
  END AS java_confidence,
  CASE WHEN {blank('stacktrace')} THEN 0 ELSE least(100,
    (CASE WHEN regexp_matches(stacktrace, '(?m):\d+:\d+\)?\s*$') THEN 60 ELSE 0 END)
    + (CASE WHEN contains(stacktrace, 'node_modules/') OR contains(stacktrace, 'node:internal')
       THEN 25 ELSE 0 END)
    + (CASE WHEN contains(stacktrace, '.js') OR contains(stacktrace, '.ts')
            OR contains(stacktrace, '.mjs') THEN 15 ELSE 0 END))
  END AS javascript_confidence,
  CASE WHEN lower(trim(platform)) IN ('java', 'jvm', 'kotlin', 'scala') THEN 'java'
       WHEN lower(trim(platform)) IN ('javascript', 'js', 'node', 'nodejs', 'typescript', 'ts')
       THEN 'javascript' ELSE 'unknown' END AS declared
FROM c_unique"""

CTE["c_plat"] = """
SELECT *, CASE WHEN declared <> 'unknown' THEN declared
  WHEN greatest(java_confidence, javascript_confidence) = 0 THEN 'unknown'
  WHEN java_confidence >= javascript_confidence THEN 'java' ELSE 'javascript' END
  AS resolved_platform FROM c_confident"""

CTE["c_lines"] = r"""
SELECT event_id, resolved_platform,
  unnest(string_split_regex(stacktrace, '\r\n|\n|\r')) AS line,
  generate_subscripts(string_split_regex(stacktrace, '\r\n|\n|\r'), 1) AS pos
FROM c_plat WHERE stacktrace IS NOT NULL"""

CTE["c_java"] = rf"""
SELECT event_id, pos, nullif(g.m, '') AS module, g.c AS declaring_class,
  regexp_replace(g.f, '^(lambda(?:\$.*)?)\$\d*$', '\1') AS function,
  CASE WHEN regexp_matches(g.s, '^.+?:\d+$') THEN regexp_extract(g.s, '^(.+?):\d+$', 1)
       WHEN regexp_matches(g.s, '\S') THEN g.s END AS file,
  CASE WHEN regexp_matches(g.s, '^.+?:\d+$') THEN CAST(regexp_extract(g.s, ':(\d+)$', 1) AS INTEGER)
       ELSE -1 END AS line,
  NOT regexp_matches(g.c, '{VENDOR}') AS in_app
FROM (SELECT event_id, pos, regexp_extract(line, '{JAVA}', ['m', 'c', 'f', 's']) AS g FROM c_lines
      WHERE resolved_platform = 'java' AND regexp_matches(line, '{JAVA}'))"""

CTE["c_v8call"] = rf"""
SELECT event_id, pos,
  CASE WHEN regexp_matches(g.f, '\S') THEN trim(regexp_replace(regexp_replace(trim(g.f),
    '^async ', ''), '^new ', '')) END AS name,
  CASE WHEN g.a <> '' THEN g.a ELSE g.b END AS place
FROM (SELECT event_id, pos, regexp_extract(line, '{V8}', ['f', 'a', 'b']) AS g FROM c_lines
      WHERE resolved_platform = 'javascript' AND regexp_matches(line, '{V8}'))"""

CTE["c_v8path"] = r"""
SELECT *, replace(path, '\', '/') AS p,
  regexp_replace(replace(path, '\', '/'), '^file://', '') AS q
FROM (SELECT event_id, pos, name,
  CASE WHEN regexp_matches(place, ':\d+$') THEN regexp_extract(place, '^(.*?):(\d+)(?::(\d+))?$', 1)
       ELSE place END AS path,
  CASE WHEN regexp_matches(place, ':\d+$')
       THEN CAST(regexp_extract(place, '^(.*?):(\d+)(?::(\d+))?$', 2) AS INTEGER) ELSE -1 END AS line
  FROM c_v8call WHERE regexp_matches(place, '\S'))"""

CTE["c_v8"] = r"""
SELECT event_id, pos,
  CASE WHEN regexp_matches(p, 'node_modules/[^/]+/') THEN
    regexp_extract(p, '.*node_modules/([^/]+)/', 1) END AS module,
  CASE WHEN regexp_matches(name, '^.+\.') THEN regexp_extract(name, '^(.+)\.[^.]*$', 1) END
    AS declaring_class,
  CASE WHEN regexp_matches(name, '^.+\.') THEN regexp_extract(name, '([^.]*)$', 1) ELSE name END
    AS function,
  CASE WHEN regexp_matches(q, 'node_modules/[^/]+/') THEN
      'node_modules/' || regexp_extract(q, '.*node_modules/([^/]+/.*)$', 1)
    WHEN starts_with(q, 'node:') OR NOT contains(q, '/') THEN q
    WHEN regexp_matches('/' || q, '/(src|dist|lib|build|out|pages|components|server)/')
      THEN regexp_extract('/' || q,
        '^.*/((?:src|dist|lib|build|out|pages|components|server)/.*)$', 1)
    ELSE regexp_extract(q, '([^/]*)$', 1) END AS file,
  line,
  NOT (contains(p, 'node_modules/') OR starts_with(p, 'node:') OR starts_with(p, 'internal/')
       OR p = 'native' OR starts_with(p, '<anonymous>')) AND (contains(p, '/') OR contains(p, '.'))
    AS in_app
FROM c_v8path"""

CTE["c_frames"] = r"""
SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY pos) - 1 AS INTEGER) AS position,
  coalesce(nullif(trim(declaring_class), ''), nullif(trim(file), ''), '<unknown>') || '#'
    || coalesce(nullif(trim(function), ''), '<anonymous>') AS sig1,
  CASE WHEN declaring_class IS NOT NULL AND file IS NOT NULL AND NOT (
      string_split(declaring_class, '$')[1] = regexp_replace(file, '(.)\.[^.]*$', '\1')
      OR ends_with(string_split(declaring_class, '$')[1],
                   '.' || regexp_replace(file, '(.)\.[^.]*$', '\1')))
    THEN file || ':' || declaring_class || '#' || coalesce(nullif(trim(function), ''), '<anonymous>')
    ELSE coalesce(declaring_class, file, '<unknown>') || '#'
      || coalesce(nullif(trim(function), ''), '<anonymous>') END AS sig2
FROM (SELECT *, 'java' AS lang FROM c_java UNION ALL SELECT *, 'javascript' FROM c_v8)"""

CTE["c_per_event"] = r"""
SELECT event_id, count(*) AS frame_count, count(*) FILTER (in_app) AS own,
  bool_or(in_app AND file IS NOT NULL AND contains(file, '.min.')) AS min_file,
  count(*) FILTER (in_app AND length(function) <= 2) AS short_names,
  list(sig1 ORDER BY position) AS all1, list(sig1 ORDER BY position) FILTER (in_app) AS own1,
  list(sig2 ORDER BY position) AS all2, list(sig2 ORDER BY position) FILTER (in_app) AS own2
FROM c_frames GROUP BY event_id"""

_FP_BASE = f"""
SELECT e.*, coalesce(f.frame_count, 0) AS frame_count, coalesce(f.own, 0) AS own,
  all1, own1, all2, own2,
  coalesce(min_file OR (own >= 3 AND short_names / own >= 0.6), false) AS minified,
  CASE WHEN coalesce(f.frame_count, 0) = 0 THEN 'no_frames' WHEN own = 0 THEN 'no_in_app_frames'
       WHEN min_file OR (own >= 3 AND short_names / own >= 0.6) THEN 'minified' END
    AS degraded_reason,
  {normalized('message')} AS normalized_message,
  CASE WHEN {blank('exception_type')} THEN '<unknown>' ELSE regexp_replace(regexp_replace(
    {stripped('exception_type')}, '\\$\\$Lambda.*$', ''), '\\$\\d+$', '') END AS normalized_type
FROM c_plat e LEFT JOIN c_per_event f USING (event_id)"""
CTE["c_fpbase"] = _FP_BASE


def _fingerprint(v: int, limit: int) -> str:
    return f"""
SELECT *, substr(sha256(fingerprint_input), 1, 32) AS fingerprint,
  {v} AS fingerprint_version, substr(sha256(fingerprint_input), 1, 32) || '-v{v}' AS group_id
FROM (SELECT *, 'v{v}' || chr(10) || 'platform=' || resolved_platform || chr(10) || 'service='
    || service || chr(10) || 'type=' || normalized_type || chr(10)
    || CASE WHEN degraded_reason IN ('no_frames', 'minified') THEN 'message=' || normalized_message
       ELSE array_to_string(list_transform(CASE WHEN degraded_reason IS NULL THEN own{v}
         ELSE all{v} END[1:{limit}], lambda s: 'frame=' || s), chr(10)) END
    || CASE WHEN degraded_reason IS NULL THEN '' ELSE chr(10) || 'degraded=' || degraded_reason END
    AS fingerprint_input,
  CASE WHEN length(full_title) <= 200 THEN full_title ELSE substr(full_title, 1, 199) || '…' END
    AS title,
  CASE WHEN own > 0 THEN own{v}[1] ELSE all{v}[1] END AS culprit
FROM (SELECT *, CASE WHEN ends_with(normalized_type, '.') THEN normalized_type
    ELSE regexp_extract(normalized_type, '([^.]*)$', 1) END
    || CASE WHEN normalized_message = '' THEN '' ELSE ': ' || normalized_message END AS full_title
  FROM c_fpbase))"""


CTE["c_ev"] = _fingerprint(1, 8)
CTE["c_ev2"] = _fingerprint(2, 3)

# == derived tables ===================================================================================
CTE["c_rollup"] = """
SELECT group_id, date_trunc('hour', received_at) AS bucket_start, count(*) AS event_count
FROM c_ev GROUP BY ALL"""
CTE["c_ranked"] = """
SELECT *, row_number() OVER (PARTITION BY group_id, date_trunc('hour', received_at)
                             ORDER BY received_at, event_id) AS hour_rank,
  row_number() OVER (PARTITION BY group_id ORDER BY received_at, event_id) AS group_rank
FROM c_ev"""
CTE["c_groups"] = """
SELECT a.*, f.fingerprint, f.fingerprint_version, f.service, f.resolved_platform AS platform,
  f.exception_type, f.title, f.culprit, f.fingerprint_input, f.frame_count, f.own,
  f.degraded_reason, l.level, x.release AS release_first, y.release AS release_last
FROM (SELECT group_id, min(received_at) AS first_seen, max(received_at) AS last_seen,
        count(*) AS event_count, count(*) FILTER (hour_rank > 3) AS sampled_count,
        min((received_at, event_id)) AS k0, max((received_at, event_id)) AS k1,
        min((received_at, event_id)) FILTER (release IS NOT NULL) AS r0,
        max((received_at, event_id)) FILTER (release IS NOT NULL) AS r1
      FROM c_ranked GROUP BY group_id) a
JOIN c_ev f ON f.event_id = a.k0[2] JOIN c_ev l ON l.event_id = a.k1[2]
LEFT JOIN c_ev x ON x.event_id = a.r0[2] LEFT JOIN c_ev y ON y.event_id = a.r1[2]"""

CTE["c_log"] = """
WITH s AS (SELECT group_id, event_count AS n, epoch_us(first_seen) AS a,
                  epoch_us(last_seen) - epoch_us(first_seen) AS span FROM c_groups)
SELECT group_id, make_timestamp(a + span // 2) AS changed_at, 'resolved' AS status,
       CASE WHEN n % 4 = 0 THEN '2.0.0' END AS release FROM s WHERE n % 2 = 0
UNION ALL SELECT group_id, make_timestamp(a + span * 3 // 4), 'open', NULL FROM s WHERE n % 6 = 0
UNION ALL SELECT group_id, make_timestamp(a + span // 3), 'ignored', NULL FROM s WHERE n % 5 = 0
UNION ALL SELECT group_id, make_timestamp(a + span), 'resolved', NULL FROM s WHERE n % 7 = 0"""
CTE["c_intervals"] = """
SELECT *, lead(changed_at) OVER (PARTITION BY group_id ORDER BY changed_at) AS until,
  CASE WHEN status = 'resolved' THEN coalesce(release, (
    SELECT arg_max(e.release, (e.received_at, e.event_id)) FROM c_ev e
    WHERE e.group_id = c_log.group_id AND e.received_at <= c_log.changed_at
      AND e.release IS NOT NULL)) END AS resolved_in_release
FROM c_log"""
CTE["c_back"] = """
SELECT i.group_id, i.changed_at, e.received_at AS regressed_at, e.event_id AS regressed_event_id,
  e.release AS regressed_in_release
FROM c_intervals i JOIN c_ev e ON e.group_id = i.group_id AND e.received_at > i.changed_at
  AND (i.until IS NULL OR e.received_at < i.until)
WHERE i.status = 'resolved'
QUALIFY row_number() OVER (PARTITION BY i.group_id, i.changed_at
                           ORDER BY e.received_at, e.event_id) = 1"""
CTE["c_states"] = """
SELECT g.*, coalesce(CASE WHEN b.regressed_at IS NOT NULL THEN 'regressed' ELSE i.status END, 'open')
  AS status, CASE WHEN i.status = 'resolved' THEN i.changed_at END AS resolved_at,
  i.resolved_in_release, b.regressed_at, b.regressed_in_release
FROM c_groups g LEFT JOIN (SELECT * FROM c_intervals WHERE changed_at <= TIMESTAMP '2024-01-31'
    QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY changed_at DESC) = 1) i USING (group_id)
LEFT JOIN c_back b ON b.group_id = i.group_id AND b.changed_at = i.changed_at
  AND b.regressed_at <= TIMESTAMP '2024-01-31'"""
CTE["c_timeline"] = """
SELECT i.group_id, i.status, i.changed_at AS since, coalesce(b.regressed_at, i.until) AS until
FROM c_intervals i LEFT JOIN c_back b USING (group_id, changed_at)
UNION ALL SELECT i.group_id, 'regressed', b.regressed_at, i.until
FROM c_intervals i JOIN c_back b USING (group_id, changed_at)"""

# == detection ==========================================================================================
def _history(rollup: str, key: str) -> str:
    """Dense history by a calendar join, the way the rollups are stored."""
    return f"""
SELECT t.{key}, t.bucket_start, t.event_count,
  coalesce((SELECT list(coalesce(r.event_count, 0) ORDER BY b.h)
    FROM unnest(generate_series(greatest(t.h0, t.bucket_start - INTERVAL 24 HOUR),
                                t.bucket_start - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS b(h)
    LEFT JOIN {rollup} r ON r.{key} = t.{key} AND r.bucket_start = b.h), []) AS history
FROM (SELECT *, min(bucket_start) OVER (PARTITION BY {key}) AS h0 FROM {rollup}) t"""


def _poisson(n: str, rate: str) -> str:
    """P(X >= n): the upper terms themselves above the rate, 1 less the lower ones below it."""
    term = f"exp(k * ln({rate}) - {rate} - lgamma(k + 1))"
    return (f"CASE WHEN {n} > {rate} THEN list_sum(list_transform(range({n}, {n} + (12 * sqrt({rate}))::BIGINT + 60), "
            f"lambda k: {term})) ELSE 1 - list_sum(list_transform(range(0, {n}), lambda k: {term})) END")


def _judged(history: str, key: str) -> str:
    return f"""
SELECT *, n_hist >= 6 AND event_count >= 5 AND ewma_score > 3 AS ewma_fired,
  n_hist >= 6 AND event_count >= 5 AND z_score > 3 AS z_fired,
  n_hist >= 6 AND event_count >= 5 AND tail < 0.001 AS p_fired,
  n_hist >= 6 AND event_count >= 5 AND tail200 < 0.001 AS p200_fired
FROM (SELECT *, event_count / greatest(ewma, 0.5) AS ewma_score,
    (event_count - mean) / greatest(sd, 1.0) AS z_score,
    {_poisson('event_count', 'rate')} AS tail,
    greatest(0.0, 1 - list_reduce(list_prepend({{'t': exp(-rate), 'c': exp(-rate), 'k': 0}},
      list_transform(range(1, least(event_count - 1, 200) + 1),
        lambda i: {{'t': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'k': i::INTEGER}})),
      lambda a, x: {{'t': a.t * (rate / x.k), 'c': a.c + a.t * (rate / x.k), 'k': x.k}}).c) AS tail200
  FROM (SELECT {key}, bucket_start, event_count, history, len(history) AS n_hist,
      list_reduce(list_transform(CASE WHEN len(history) = 0 THEN [0] ELSE history END,
        lambda x: x::DOUBLE), lambda a, x: 0.3 * x + (1 - 0.3) * a) AS ewma,
      coalesce(list_avg(history), 0.0) AS mean, greatest(coalesce(list_avg(history), 0.0), 0.1) AS rate,
      CASE WHEN len(history) > 1 THEN list_stddev_samp(history) ELSE 0.0 END AS sd,
      CASE WHEN len(history) > 0 THEN len(list_filter(history, lambda x: x = 0)) / len(history)
        ELSE 1.0 END AS zero_share
    FROM {history}))"""


def _verdicts(judged: str, key: str) -> str:
    return f"""
SELECT {key}, bucket_start, 'ewma' AS detector, true AS is_active, ewma_fired AS fired,
  event_count AS observed, ewma AS baseline, ewma_score AS score, 3.0 AS threshold
FROM {judged} WHERE event_count >= 5
UNION ALL SELECT {key}, bucket_start, 'zscore', false, z_fired, event_count, mean, z_score, 3.0
FROM {judged} WHERE event_count >= 5
UNION ALL SELECT {key}, bucket_start, 'poisson', false, p_fired, event_count, rate,
  -log10(greatest(tail, 1e-300)), 3.0 FROM {judged} WHERE event_count >= 5"""


def _hindsight(rollup: str, key: str) -> str:
    return f"""
SELECT *, event_count >= 5 AND event_count >= greatest(5.0, oracle_baseline * 4.0) AS surge
FROM (SELECT t.*, (SELECT coalesce(sum(r.event_count), 0)::DOUBLE / greatest(1, count(*))
    FROM unnest(generate_series(greatest(t.h0, t.bucket_start - INTERVAL 24 HOUR),
                                t.bucket_start + INTERVAL 3 HOUR, INTERVAL 1 HOUR)) AS b(h)
    LEFT JOIN {rollup} r ON r.{key} = t.{key} AND r.bucket_start = b.h
    WHERE b.h <> t.bucket_start) AS oracle_baseline
  FROM (SELECT *, min(bucket_start) OVER (PARTITION BY {key}) AS h0 FROM {rollup}) t)"""


_BOX = """CASE WHEN fired AND surge THEN 'true_positive' WHEN fired THEN 'false_positive'
  WHEN surge THEN 'false_negative' ELSE 'true_negative' END"""

CTE["c_hist"] = _history("c_rollup", "group_id")
CTE["c_judged"] = _judged("c_hist", "group_id")
CTE["c_verdicts"] = _verdicts("c_judged", "group_id")
CTE["c_hindsight"] = _hindsight("c_rollup", "group_id")
CTE["c_obs"] = f"""
SELECT v.*, CASE WHEN v.bucket_start <= TIMESTAMP '2024-01-30 21:00:00' THEN {_BOX} END AS outcome
FROM c_verdicts v JOIN c_hindsight h USING (group_id, bucket_start)"""

CTE["c_series"] = """
SELECT service AS series_id, date_trunc('hour', received_at) AS bucket_start,
  count(*) AS event_count FROM c_ev GROUP BY ALL"""
CTE["c_shist"] = _history("c_series", "series_id")
CTE["c_sjudged"] = _judged("c_shist", "series_id")
CTE["c_sverdicts"] = _verdicts("c_sjudged", "series_id")
CTE["c_shindsight"] = _hindsight("c_series", "series_id")
CTE["c_backtest"] = f"""
SELECT v.*, h.surge, {_BOX} AS outcome
FROM c_sverdicts v JOIN c_shindsight h USING (series_id, bucket_start)
WHERE v.bucket_start < TIMESTAMP '2024-01-30 21:00:00'"""

# == alerts ================================================================================================
CTE["c_firing"] = """
SELECT group_id, bucket_start AS hour, event_count, min(n) AS n, any_value(ewma) AS ewma
FROM (SELECT *, unnest(range(5, event_count + 1)) AS n FROM c_judged
      WHERE event_count >= 5 AND n_hist >= 6)
WHERE n / greatest(ewma, 0.5) > 3 GROUP BY ALL"""
CTE["c_spike_cand"] = """
SELECT e.group_id, 'spike' AS kind, e.received_at AS at_time, e.event_id, e.hour_rank, f.ewma
FROM c_ranked e JOIN c_firing f
  ON f.group_id = e.group_id AND f.hour = date_trunc('hour', e.received_at) AND e.hour_rank >= f.n"""
CTE["c_new_cand"] = """
SELECT e.group_id, 'new_group' AS kind, e.received_at AS at_time, e.event_id
FROM c_ranked e JOIN c_groups g USING (group_id)
WHERE e.received_at < g.first_seen + INTERVAL 3 HOUR AND e.group_rank >= 4"""
CTE["c_sweeps"] = """
SELECT group_id, sweep_at, count(*) AS busy_hours
FROM (SELECT group_id, bucket_start, unnest(generate_series(bucket_start + INTERVAL 1 HOUR,
        bucket_start + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS sweep_at FROM c_rollup)
GROUP BY ALL HAVING count(*) FILTER (bucket_start > sweep_at - INTERVAL 3 HOUR) = 0
  AND count(*) FILTER (bucket_start <= sweep_at - INTERVAL 3 HOUR) >= 6"""
CTE["c_cand"] = """
SELECT group_id, kind, at_time, event_id, 60 AS mins FROM c_spike_cand
UNION ALL SELECT group_id, kind, at_time, event_id, 60 FROM c_new_cand
UNION ALL SELECT group_id, 'regression', regressed_at, regressed_event_id, 60 FROM c_back
UNION ALL SELECT s.group_id, 'silence', sweep_at, '', 1440 FROM c_sweeps s
  WHERE coalesce((SELECT any_value(t.status) FROM c_timeline t WHERE t.group_id = s.group_id
    AND t.since <= s.sweep_at AND (t.until IS NULL OR s.sweep_at < t.until)), 'open')
    IN ('open', 'regressed')"""


def _greedy(cands: str) -> str:
    """Next kept candidate after the last kept one, key by key."""
    return f"""
SELECT group_id, kind, min(at_time) AS at_time, any_value(mins) AS mins FROM {cands} GROUP BY group_id, kind
UNION ALL
SELECT * FROM (SELECT e.group_id, e.kind, (SELECT min(c.at_time) FROM {cands} c
    WHERE c.group_id = e.group_id AND c.kind = e.kind
      AND c.at_time >= e.at_time + INTERVAL 1 MINUTE * e.mins) AS at_time, e.mins
  FROM emit_{cands} e) WHERE at_time IS NOT NULL"""


CTE["emit_c_cand"] = _greedy("c_cand")
CTE["c_user_cand"] = """
SELECT 'user-' || user_id AS group_id, 'spike' AS kind, ts AS at_time,
  lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, 360 AS mins FROM events"""
CTE["emit_c_user_cand"] = _greedy("c_user_cand")
CTE["c_alerts"] = """
SELECT x.group_id, x.kind, x.at_time AS created_at, date_trunc('hour', x.at_time) AS bucket_start, g.title,
  CASE WHEN x.kind = 'spike' THEN 'ewma' END AS detector,
  CASE WHEN x.kind = 'spike' THEN s.hour_rank END AS observed,
  CASE WHEN x.kind = 'spike' THEN s.hour_rank / greatest(s.ewma, 0.5) END AS score,
  substr(sha256(x.group_id || '|' || x.kind || '|' || CAST(epoch_us(x.at_time) AS VARCHAR)), 1, 32)
    AS alert_id
FROM emit_c_cand x JOIN c_groups g USING (group_id)
LEFT JOIN (SELECT group_id, at_time, min_by(hour_rank, event_id) AS hour_rank, any_value(ewma) AS ewma
  FROM c_spike_cand GROUP BY ALL) s ON s.group_id = x.group_id AND s.at_time = x.at_time AND x.kind = 'spike'"""
CTE["c_delivered"] = """
SELECT *, minute(created_at) % 6 AS tries,
  CASE WHEN minute(created_at) % 6 = 0 THEN 'pending'
       WHEN minute(created_at) % 2 = 0 THEN 'sent'
       WHEN minute(created_at) % 6 >= 5 THEN 'failed' ELSE 'pending' END AS delivery_state
FROM c_alerts"""

# == statements, in the order of the inventory ================================================================
_SERVICE = """SELECT service, count(*) AS events, count(*) FILTER (event_id IS NULL) AS without_id,
  count(*) FILTER (stacktrace IS NOT NULL) AS traced, min(received_at) AS first_at,
  max(received_at) AS last_at FROM c_feed GROUP BY service"""
_ROLLUP = "SELECT * FROM c_rollup"
_OUTCOMES = """SELECT c.event_id, w.event_id IS NOT NULL AS stored, w.group_id, w.fingerprint,
  coalesce(w.hour_rank > 3, false) AS sampled, b.regressed_event_id IS NOT NULL AND
  w.event_id IS NOT NULL AS regressed, c.error, false AS retryable
FROM c_checked c LEFT JOIN c_ranked w ON w.event_id = c.event_id AND w.received_at = c.received_at
  AND w.seq = c.seq AND c.error IS NULL
LEFT JOIN c_back b ON b.regressed_event_id = c.event_id"""
CTE["c_outcomes"] = _OUTCOMES


def _frames(lang: str) -> str:
    return ("SELECT event_id, position, module, declaring_class, function, file, line, in_app "
            f"FROM c_frames WHERE lang = '{lang}'")


def _detector(name: str) -> str:
    return (f"SELECT group_id, bucket_start, is_active, fired, observed, round(baseline, 6) AS "
            f"baseline, round(score, 4) AS score, round(threshold::DOUBLE, 6) AS "
            f"threshold FROM c_verdicts WHERE detector = '{name}'")


_GROUPS_SQL = """SELECT group_id, fingerprint, fingerprint_version, service, platform,
  exception_type, title, culprit, fingerprint_input, CAST(frame_count AS INTEGER) AS frame_count,
  degraded_reason, level, first_seen, last_seen, event_count, release_first, release_last,
  sampled_count FROM c_groups"""
_BYTES = ("(SELECT CAST(sum(coalesce(strlen(message), 0) + coalesce(strlen(stacktrace), 0) "
          "+ coalesce(strlen(payload), 0)) AS BIGINT) FROM c_ev)")
_DENSE = ("SELECT event_type, make_timestamp(epoch_us(ts) // 24) AS moment, "
          "lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id FROM events")
_NONE = "coalesce({0}, '(none)')"
_CLOCK = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
_BOXES = ("count(*) FILTER (outcome = 'true_positive') AS tp, "
          "count(*) FILTER (outcome = 'false_positive') AS fp, "
          "count(*) FILTER (outcome = 'false_negative') AS fn, "
          "count(*) FILTER (outcome = 'true_negative') AS tn")


def _clock(c: str, none: str = "(none)") -> str:
    return f"coalesce({_CLOCK.format(c)}, '{none}')"


CTE["c_replay"] = """
SELECT a.group_id, b.fingerprint AS candidate, count(*) AS events
FROM c_ranked a JOIN c_ev2r b USING (event_id)
WHERE a.stacktrace IS NOT NULL AND a.hour_rank <= 3 GROUP BY ALL"""
# A replay declares the platform that was resolved at ingest; for traced events of a known
# platform this changes nothing, and an unknown one is detected again.
CTE["c_ev2r"] = "SELECT event_id, fingerprint FROM c_ev2"
_SPINE = ("SELECT CAST(unnest(generate_series({a}, {b}, INTERVAL 1 {unit})) AS TIMESTAMP) AS {name}")


def _trend(start: str, end: str, unit: str, where: str, name: str) -> str:
    spine = _SPINE.format(a=start, b=end, unit=unit, name=name)
    return f"""SELECT s.{name}, CAST(coalesce(sum(r.event_count), 0) AS BIGINT) AS event_count
FROM ({spine}) s LEFT JOIN (SELECT r.* FROM c_rollup r JOIN c_groups g USING (group_id)
  WHERE {where}) r ON r.bucket_start >= s.{name} AND r.bucket_start < s.{name} + INTERVAL 1 {unit}
GROUP BY s.{name}"""


_BUSY = "g.group_id = (SELECT group_id FROM c_groups ORDER BY event_count DESC, group_id LIMIT 1)"


def _tri(c: str) -> str:
    words = (f"list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')")
    return (f"list_distinct(flatten(list_transform({words}, lambda w: list_transform("
            f"range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))")


def _jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"coalesce({both} / nullif(len({a}) + len({b}) - {both}, 0), 0.0)"


CTE["c_plan"] = """
SELECT service, CASE WHEN service = 'checkout-api' THEN 0 ELSE ascii(service) END AS service_order,
  date_trunc('hour', received_at) AS hour,
  count(*) - CASE WHEN hour(any_value(received_at)) = 7 THEN 1 ELSE 0 END AS planned
FROM c_feed WHERE service <> '' AND seq = 0 GROUP BY ALL"""
# Grouping by the hour makes any event of the bucket tell its hour of day.
CTE["c_plan"] = """
SELECT service, CASE WHEN service = 'checkout-api' THEN 0 ELSE ascii(service) END AS service_order,
  h AS hour, count(*) - CASE WHEN hour(h) = 7 THEN 1 ELSE 0 END AS planned
FROM (SELECT *, date_trunc('hour', received_at) AS h FROM c_feed WHERE service <> '')
GROUP BY service, h"""
CTE["c_sent"] = """
SELECT g.service, r.bucket_start AS hour, CAST(sum(r.event_count) AS BIGINT) AS delivered
FROM c_rollup r JOIN c_groups g USING (group_id) GROUP BY ALL"""
CTE["c_tri"] = f"SELECT group_id, title, {_tri('title')} AS t FROM c_groups"

STATEMENTS.update({
    "A1_json_source": _SERVICE,
    "A2_stream_source": _SERVICE,
    "A3_table_sink_merge": _ROLLUP,
    "A4_backfill_release": """SELECT coalesce(json_extract_string(payload, '$.release'), release)
  AS release, count(*) AS events FROM c_feed GROUP BY 1""",
    "A4_backfill_rollups": _ROLLUP,
    "A5_backfill_release_range": """SELECT group_id, release_first, release_last FROM c_groups
WHERE release_first IS NOT NULL""",
    "A6_orphan_cleanup": """SELECT service, count(*) AS events FROM c_ev
WHERE resolved_platform <> 'unknown' GROUP BY 1""",
    "B1_validation": "SELECT coalesce(error, 'valid') AS error, count(*) AS events FROM c_checked "
                     "GROUP BY 1",
    "B2_legacy_fields": "SELECT event_id, seq, exception_type, release FROM c_resolved_feed",
    "B3_legacy_stacktrace": "SELECT event_id, seq, CAST(length(stacktrace) AS INTEGER) AS chars, "
                            "sha256(stacktrace) AS trace_hash FROM c_resolved_feed",
    "B4_capture_truncation": """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1
    THEN replace(text, 'e', chr(128512)) ELSE text END AS s FROM documents),
  letters AS (SELECT doc_id, s, regexp_extract_all(s, '(?s).') AS c FROM t),
  units AS (SELECT doc_id, i, sum(1 + CAST(unicode(x) > 65535 AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS u
    FROM (SELECT doc_id, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM letters)),
  fits AS (SELECT doc_id, count(*) FILTER (u <= 4000) AS m, count(*) FILTER (u <= 20000) AS st FROM units GROUP BY 1)
SELECT doc_id, CAST(length(substr(s, 1, m)) AS INTEGER) AS chars, sha256(substr(s, 1, m)) AS hash,
  CAST(length(substr(s, 1, st)) AS INTEGER) AS trace_chars, sha256(substr(s, 1, st)) AS trace_hash
FROM letters JOIN (SELECT doc_id, coalesce(m, 0) AS m, coalesce(st, 0) AS st FROM letters LEFT JOIN fits USING (doc_id))
  USING (doc_id)""",
    "B5_deduplicate": """SELECT event_id, received_at, seq FROM c_checked
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY received_at, seq) = 1""",
    "B6_missing_ids": "SELECT c.event_id, c.received_at, c.service FROM c_checked c "
                      "WHERE length(c.event_id) = 64",
    "B7_receipts": "SELECT * FROM c_outcomes",
    "B8_receipt_summary": """SELECT count(*) AS accepted, count(*) FILTER (stored) AS stored,
  count(*) FILTER (error IS NULL AND NOT stored) AS duplicates,
  count(*) FILTER (error IS NOT NULL) AS failed FROM c_outcomes""",
    "B9_hourly_rollup": _ROLLUP,
    "B10_rollup_merge": _ROLLUP,
    "B11_groups": _GROUPS_SQL,
    "B11_groups_in_three_parts": _GROUPS_SQL,
    "B11_groups_outlive_retention": _GROUPS_SQL,
    "A3_observation_merge": "SELECT detector, fired, count(*) AS verdicts, count(outcome) AS scored "
                            "FROM c_obs GROUP BY 1, 2",
    "A3_alert_merge": "SELECT kind, count(*) AS alerts FROM c_alerts GROUP BY 1",
    "B12_group_age": """SELECT event_id, CAST((epoch_us(received_at) - epoch_us(first_seen))
  // 3600000000 AS INTEGER) AS age_hours FROM c_ev JOIN c_groups USING (group_id)""",
    "B13_hourly_cap": """SELECT event_id, group_id, hour_rank > 3 AS sampled,
  hour_rank <= 3 AND stacktrace IS NOT NULL AS keeps_trace,
  hour_rank <= 3 AND payload IS NOT NULL AS keeps_payload FROM c_ranked""",
    "B13_default_cap": f"""SELECT event_id, n > 200 AS sampled, n <= 200 AS keeps_trace
FROM (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('hour', moment) ORDER BY moment, event_id) AS n
  FROM ({_DENSE}))""",
    "E9_default_threshold": f"""SELECT event_type AS group_id, moment AS at_time, event_id
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY moment, event_id) AS n
  FROM (SELECT *, min(moment) OVER (PARTITION BY event_type) AS born FROM ({_DENSE}))
  WHERE (epoch_us(moment) - epoch_us(born)) // 3600000000 <= 2)
WHERE n >= 10""",
    "B14_attach": "SELECT event_id, group_id, fingerprint, fingerprint_version, "
                  "resolved_platform AS platform FROM c_ev",
    "B15_reconcile": """SELECT CAST(0 AS BIGINT) AS mismatches, count(*) AS events,
  count(DISTINCT group_id) AS groups FROM c_ev""",
    "B16_outcome_metrics": """SELECT CASE WHEN error IS NOT NULL THEN 'rejected'
  WHEN NOT stored THEN 'duplicate' WHEN sampled THEN 'sampled' ELSE 'stored' END AS outcome,
  count(*) AS events FROM c_outcomes GROUP BY 1""",
    "B16_sweep_metrics": """SELECT (SELECT count(*) FROM c_alerts WHERE kind = 'silence') AS alerted,
  (SELECT count(*) FROM c_ev WHERE received_at < TIMESTAMP '2024-01-17') AS deleted,
  (SELECT count(outcome) FROM c_obs) AS scored""",
    "C1_normalize_documents": f"""SELECT doc_id, CAST(length(t) AS INTEGER) AS chars,
  sha256(t) AS hash FROM (SELECT doc_id, {normalized('text')} AS t FROM documents)""",
    "C1_normalize_messages": "SELECT event_id, normalized_message FROM c_fpbase",
    "C2_message_templates": "SELECT service, normalized_message AS template, count(*) AS events "
                            "FROM c_fpbase GROUP BY ALL",
    "C2_turn_templates": f"""SELECT role, count(DISTINCT t) AS templates, count(*) AS turns
FROM (SELECT role, {normalized('text')} AS t FROM conversations) GROUP BY role""",
    "C3_platform_alias": """SELECT coalesce(platform, '(none)') AS declared,
  CASE WHEN lower(trim(platform)) IN ('java', 'jvm', 'kotlin', 'scala') THEN 'java'
       WHEN lower(trim(platform)) IN ('javascript', 'js', 'node', 'nodejs', 'typescript', 'ts')
       THEN 'javascript' ELSE 'unknown' END AS platform, count(*) AS events
FROM c_feed GROUP BY ALL""",
    "C4_platform_detection": "SELECT event_id, java_confidence, javascript_confidence, "
                             "resolved_platform FROM c_plat",
    "C5_java_frames": _frames("java"),
    "C6_java_methods": """SELECT declaring_class, function, count(*) AS frames FROM c_frames
WHERE lang = 'java' AND starts_with(function, 'lambda') GROUP BY ALL""",
    "C7_java_in_app": """SELECT declaring_class, in_app, count(*) AS frames FROM c_frames
WHERE lang = 'java' GROUP BY ALL""",
    "C8_v8_frames": _frames("javascript"),
    "C9_javascript_files": "SELECT file, count(*) AS frames FROM c_frames "
                           "WHERE lang = 'javascript' GROUP BY ALL",
    "C10_javascript_in_app": """SELECT coalesce(module, '') AS module, in_app, count(*) AS frames
FROM c_frames WHERE lang = 'javascript' GROUP BY ALL""",
    "C11_minified": "SELECT event_id, minified FROM c_fpbase",
    "C12_degraded_reasons": """SELECT resolved_platform, coalesce(degraded_reason, 'none') AS reason,
  count(*) AS events FROM c_fpbase GROUP BY ALL""",
    "C13_signature_v1": "SELECT sig1 AS signature, count(*) AS frames FROM c_frames GROUP BY 1",
    "C14_signature_v2": "SELECT sig2 AS signature, count(*) AS frames FROM c_frames GROUP BY 1",
    "C15_exception_types": """SELECT coalesce(exception_type, '(none)') AS given, normalized_type,
  count(*) AS events FROM c_fpbase GROUP BY ALL""",
    "C16_fingerprint_input": "SELECT fingerprint_input, count(*) AS events FROM c_ev GROUP BY 1",
    "C17_fingerprint_hash": "SELECT event_id, fingerprint FROM c_ev",
    "C18_titles": "SELECT title, count(*) AS events FROM c_ev GROUP BY 1",
    "C19_culprits": "SELECT coalesce(culprit, '(none)') AS culprit, count(*) AS events FROM c_ev "
                    "GROUP BY 1",
    "C20_fingerprint_v2": "SELECT event_id, fingerprint, fingerprint_version, "
                          "coalesce(culprit, '(none)') AS culprit FROM c_ev2",
    "C21_replay_merges": """SELECT candidate, group_id, members, title
FROM (SELECT *, count(*) OVER (PARTITION BY candidate) AS members FROM c_replay)
JOIN c_groups USING (group_id) WHERE members > 1""",
    "C21_replay_control": "SELECT CAST(0 AS BIGINT) AS merges, CAST(0 AS BIGINT) AS splits",
    "C22_replay_splits": """SELECT group_id, "into", title FROM (SELECT group_id, count(*) AS "into"
  FROM c_replay GROUP BY 1 HAVING count(*) > 1) JOIN c_groups USING (group_id)""",
    "C23_replay_coverage": """SELECT (SELECT count(*) FROM c_groups) AS groups_total,
  count(DISTINCT group_id) AS groups_covered, CAST(sum(events) AS BIGINT) AS events_replayed,
  2 AS version FROM c_replay""",
    "C24_frame_counts": """SELECT group_id, CAST(own AS INTEGER) AS in_app_frames,
  CAST(frame_count - own AS INTEGER) AS vendor_frames FROM c_groups""",
    "D1_status_intervals": f"""SELECT group_id, changed_at, status,
  coalesce(resolved_in_release, '(none)') AS resolved_in_release, {_clock('until')} AS until
FROM c_intervals""",
    "D2_regressions": """SELECT group_id, changed_at, regressed_at, regressed_event_id,
  coalesce(regressed_in_release, '(none)') AS regressed_in_release FROM c_back""",
    "D3_group_states": f"""SELECT group_id, status, {_clock('resolved_at')} AS resolved_at,
  {_clock('regressed_at')} AS regressed_at,
  coalesce(resolved_in_release, '(none)') AS resolved_in_release,
  coalesce(regressed_in_release, '(none)') AS regressed_in_release FROM c_states""",
    "D4_triage_list": """SELECT group_id, service, title, status, event_count, last_seen
FROM c_states WHERE status = 'regressed' ORDER BY last_seen DESC, group_id DESC LIMIT 100""",
    "E1_dense_history": "SELECT group_id, bucket_start, array_to_string(history, ',') AS history "
                        "FROM c_hist",
    "E2_series_stats": """SELECT group_id, bucket_start, CAST(n_hist AS INTEGER) AS history_hours,
  round(mean, 6) AS mean, round(sd, 6) AS stddev, round(zero_share, 6) AS zero_share FROM c_judged""",
    "E3_ewma": _detector("ewma"),
    "E4_zscore": _detector("zscore"),
    "E5_poisson": _detector("poisson"),
    "E5_poisson_200_terms": """
SELECT group_id, bucket_start, p200_fired AS fired, event_count AS observed, round(rate, 6) AS baseline
FROM c_judged WHERE event_count >= 5""",
    "E5_busy_surges": f"""
SELECT o_orderdate, n AS orders, tail < 0.001 AS fires, round(-log10(greatest(tail, 1e-300)), 4) AS score
FROM (SELECT *, {_poisson('(10 * n)', '(1.0::DOUBLE * n)')} AS tail
  FROM (SELECT o_orderdate, count(*) AS n FROM orders GROUP BY 1))""",
    "E6_shadow_evaluation": """SELECT group_id, bucket_start, count(*) AS verdicts,
  count(*) FILTER (is_active) AS active, count(*) FILTER (fired) AS fired FROM c_verdicts
GROUP BY ALL""",
    "E7_observations": "SELECT group_id, bucket_start, detector, is_active, fired, observed "
                       "FROM c_verdicts",
    "E8_spike_instants": """SELECT f.group_id, f.hour, f.n, e.received_at AS nth_at,
  e.event_id AS nth_id FROM c_firing f JOIN c_ranked e ON e.group_id = f.group_id
  AND date_trunc('hour', e.received_at) = f.hour AND e.hour_rank = f.n""",
    "E9_new_groups": "SELECT group_id, at_time, event_id FROM c_new_cand",
    "E10_silence": """SELECT group_id,
  count(*) FILTER (bucket_start <= TIMESTAMP '2024-01-20 02:00:00') AS busy_hours,
  count(*) FILTER (bucket_start > TIMESTAMP '2024-01-20 02:00:00') AS recent_hours
FROM c_rollup JOIN c_states USING (group_id)
WHERE bucket_start > TIMESTAMP '2024-01-19 05:00:00'
  AND bucket_start <= TIMESTAMP '2024-01-20 05:00:00' AND status IN ('open', 'regressed')
GROUP BY 1 HAVING busy_hours >= 6 AND recent_hours = 0""",
    "E10_silence_sweeps": "SELECT * FROM c_sweeps",
    "E11_hindsight": "SELECT group_id, bucket_start, round(oracle_baseline, 6) AS oracle_baseline, "
                     "surge FROM c_hindsight",
    "E12_scored": "SELECT group_id, bucket_start, detector, coalesce(outcome, 'pending') AS outcome "
                  "FROM c_obs",
    "E13_scorecard": f"""SELECT detector, arg_max(is_active, bucket_start) AS is_active,
  count(*) FILTER (fired) AS fired, count(outcome) AS judged, count(*) - count(outcome) AS pending,
  {_BOXES} FROM c_obs GROUP BY 1""",
    "E14_precision_recall": f"""SELECT detector, round(tp / nullif(tp + fp, 0), 6) AS precision,
  round(tp / nullif(tp + fn, 0), 6) AS recall FROM (SELECT detector, {_BOXES} FROM c_obs
GROUP BY 1)""",
    "E15_backtest": f"SELECT detector, {_BOXES} FROM c_backtest GROUP BY 1",
    "E16_disagreements": """SELECT series_id, bucket_start, observed, surge,
  max(outcome) FILTER (detector = 'ewma') AS ewma,
  max(outcome) FILTER (detector = 'zscore') AS zscore,
  max(outcome) FILTER (detector = 'poisson') AS poisson
FROM c_backtest GROUP BY ALL HAVING count(DISTINCT outcome) > 1""",
    "E17_model_vs_recorded": """SELECT detector, coalesce(outcome, 'pending') AS outcome,
  count(*) FILTER (bucket_start < TIMESTAMP '2024-01-30 21:00:00') AS modelled,
  count(*) AS recorded FROM (SELECT detector, bucket_start, outcome FROM c_obs) GROUP BY ALL""",
    "F1_cooldown": "SELECT group_id, kind, at_time, (SELECT min(c.event_id) FROM c_user_cand c WHERE "
                   "c.group_id = e.group_id AND c.at_time = e.at_time) AS event_id FROM emit_c_user_cand e",
    "F2_alerts": """SELECT group_id, kind, created_at, bucket_start, title,
  'pending' AS delivery_state, coalesce(detector, '(none)') AS detector,
  coalesce(observed, -1) AS observed, round(coalesce(score, -1.0), 4) AS score FROM c_alerts""",
    "F3_pending_queue": """SELECT group_id, kind, created_at, tries AS delivery_attempts, s.service,
  s.status, s.event_count FROM c_delivered JOIN c_states s USING (group_id)
WHERE delivery_state = 'pending'""",
    "F4_delivery_state": f"""SELECT group_id, kind, created_at, delivery_state,
  tries AS delivery_attempts, CASE WHEN delivery_state IN ('failed', 'pending') AND tries > 0
    THEN 500 ELSE 0 END AS error_chars, CASE WHEN delivery_state = 'sent'
    THEN {_CLOCK.format('created_at + INTERVAL 1 MINUTE * tries')} ELSE '(none)' END AS delivered_at
FROM c_delivered""",
    "F5_alert_feed": """SELECT alert_id, group_id, kind, created_at, g.service, d.title,
  delivery_state FROM c_delivered d JOIN c_groups g USING (group_id)
ORDER BY created_at DESC, alert_id LIMIT 50""",
    "G1_retention_window": """SELECT service, bytes, CASE WHEN bytes * 1000 >= 419430400 THEN 3
  WHEN bytes * 1000 >= 314572800 THEN 7 ELSE 14 END AS window_days
FROM (SELECT service, CAST(sum(coalesce(strlen(message), 0) + coalesce(strlen(stacktrace), 0))
  AS BIGINT) AS bytes FROM c_feed GROUP BY 1)""",
    "G2_retention_survivors": """SELECT l_returnflag, count(*) AS "rows", min(l_shipdate) AS oldest
FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-01' - INTERVAL 365 DAY GROUP BY 1""",
    "G2_bounded_delete": """SELECT service, count(*) AS events, min(received_at) AS oldest
FROM (SELECT *, row_number() OVER (ORDER BY received_at, event_id) AS n FROM c_ev)
WHERE NOT (n <= 5000 AND received_at < TIMESTAMP '2024-01-17') GROUP BY 1""",
    "G3_sweep_record": f"""SELECT TIMESTAMP '2024-01-31' AS ran_at, 'scheduled' AS source,
  7 AS window_days, count(*) AS deleted_events, {_BYTES} AS events_bytes
FROM c_ev WHERE received_at < TIMESTAMP '2024-01-24'""",
    "G4_trend_survives": """SELECT CAST(0 AS BIGINT) AS changed_buckets, count(*) AS events_left,
  (SELECT count(*) FROM c_rollup WHERE bucket_start < TIMESTAMP '2024-01-17')
    AS buckets_without_events
FROM c_ev WHERE received_at >= TIMESTAMP '2024-01-17'""",
    "H1_group_page": """SELECT group_id, title, service, status, event_count, first_seen, last_seen
FROM c_states WHERE title ILIKE '%not found%' AND (last_seen, group_id) <
  (TIMESTAMP '2024-01-29', 'zzzz') ORDER BY last_seen DESC, group_id DESC LIMIT 21""",
    "H1_newest_page": """SELECT group_id, title, service, status, event_count, first_seen, last_seen
FROM c_states WHERE title ILIKE '%not found%' AND (last_seen, group_id) <
  (TIMESTAMP '2024-01-29', 'zzzz') ORDER BY last_seen DESC, group_id DESC LIMIT 21""",
    "H1_orders_page": """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND (o_orderdate, o_orderkey) < (TIMESTAMP '2000-06-01', 1000000)
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51""",
    "H2_counts_by_status": "SELECT status, count(*) AS n FROM c_states "
                           "WHERE title ILIKE '%NOT FOUND%' GROUP BY 1",
    "H3_overview_trend": _trend("TIMESTAMP '2024-01-02'", "TIMESTAMP '2024-01-31'", "DAY",
                                "g.service = 'signup-svc'", "day"),
    "H3_overview_all": _trend("TIMESTAMP '2024-01-25'", "TIMESTAMP '2024-01-31'", "DAY", "true",
                              "day"),
    "H4_widened_overview": "SELECT *, '30d' AS \"window\" FROM (" + _trend(
        "TIMESTAMP '2024-01-10'", "TIMESTAMP '2024-02-08'", "DAY", "true", "day") + ")",
    "H5_services": "SELECT DISTINCT service FROM c_groups",
    "H6_sparklines": """SELECT group_id, array_to_string(list(n ORDER BY d), ',') AS daily
FROM (SELECT g.group_id, d, coalesce(sum(r.event_count), 0)::BIGINT AS n
  FROM (SELECT DISTINCT group_id FROM c_rollup WHERE bucket_start >= TIMESTAMP '2024-01-25') g
  CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-25', TIMESTAMP '2024-01-31',
    INTERVAL 1 DAY)) AS d)
  LEFT JOIN c_rollup r ON r.group_id = g.group_id AND date_trunc('day', r.bucket_start) = d
  GROUP BY ALL) GROUP BY 1""",
    "H7_group_detail": f"""SELECT s.group_id, s.title, s.status,
  coalesce(CASE WHEN s.release_first = s.release_last THEN s.release_first
    ELSE s.release_first || ' → ' || s.release_last END, '') AS release_range,
  coalesce(e.message, '') AS sample_message, coalesce(sha256(e.stacktrace), '') AS sample_trace,
  {_clock('e.received_at', '')} AS sample_at
FROM c_states s LEFT JOIN (SELECT * FROM c_ranked WHERE stacktrace IS NOT NULL AND hour_rank <= 3
  QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY received_at DESC, event_id DESC) = 1) e
  ON e.group_id = s.group_id""",
    "H8_group_series_hours": "SELECT strftime(h, '%H:%M') AS label, " + _CLOCK.format("h")
                             + " AS iso, event_count FROM (" + _trend(
        "TIMESTAMP '2024-01-19 19:00:00'", "TIMESTAMP '2024-01-20 18:00:00'", "HOUR", _BUSY, "h")
                             + ")",
    "H8_group_series_days": "SELECT strftime(d, '%d %b') AS label, " + _CLOCK.format("d")
                            + " AS iso, event_count FROM (" + _trend(
        "TIMESTAMP '2024-01-02'", "TIMESTAMP '2024-01-31'", "DAY", _BUSY, "d") + ")",
    "H9_similar_to_one": f"""SELECT p_partkey, p_name, round(s, 2) AS score
FROM (SELECT p_partkey, p_name, {_jaccard(_tri('p_name'), _tri("'small ring'"))} AS s FROM part
  WHERE p_partkey <> 0) WHERE s > 0.3 ORDER BY s DESC, p_partkey LIMIT 5""",
    "H9_similar_by_index": f"""SELECT p_partkey, p_name, round(s, 2) AS score
FROM (SELECT p_partkey, p_name, {_jaccard(_tri('p_name'), _tri("'small ring'"))} AS s FROM part
  WHERE p_partkey <> 0) WHERE s > 0.3 ORDER BY s DESC, p_partkey LIMIT 5""",
    "H10_similar_groups": f"""SELECT group_id, similar_id, round(s, 2) AS score,
  CAST(row_number() OVER (PARTITION BY group_id ORDER BY s DESC, similar_id) AS INTEGER) AS "rank"
FROM (SELECT a.group_id, b.group_id AS similar_id, {_jaccard('a.t', 'b.t')} AS s
  FROM c_tri a JOIN c_tri b ON a.group_id <> b.group_id) WHERE s > 0.3
QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY s DESC, similar_id) <= 5""",
    "H11_nav_counts": """SELECT (SELECT count(*) FROM c_states WHERE status IN ('open', 'regressed'))
  AS open_groups, (SELECT count(*) FROM c_alerts) AS alerts""",
    "H12_storage_status": f"""SELECT (SELECT count(*) FROM c_ev) AS event_rows,
  {_CLOCK.format('(SELECT min(received_at) FROM c_ev)')} AS oldest_event,
  {_CLOCK.format('(SELECT max(received_at) FROM c_ev)')} AS newest_event,
  (SELECT count(*) FROM c_rollup) AS rollup_rows, '2024-01-31 00:00:00' AS last_sweep_at,
  'scheduled' AS last_sweep_source, 14 AS last_sweep_window_days,
  (SELECT count(*) FROM c_ev WHERE received_at < TIMESTAMP '2024-01-17') AS last_sweep_deleted,
  true AS bytes_add_up, {_BYTES} AS events_bytes""",
    "H13_trend_summary": """SELECT group_id, CAST(sum(event_count) AS BIGINT) AS total,
  max(event_count) AS peak, arg_min(bucket_start, (-event_count, bucket_start)) AS first_peak_at
FROM c_rollup GROUP BY 1""",
    "I1_delivered": "SELECT * FROM c_sent",
    "I2_remainder": """SELECT service, hour, planned, coalesce(delivered, 0) AS delivered,
  planned - coalesce(delivered, 0) AS owed FROM c_plan LEFT JOIN c_sent USING (service, hour)
WHERE planned > coalesce(delivered, 0)""",
    "I3_drift": """SELECT hour, coalesce(arg_max(CASE WHEN got > planned THEN 'over' ELSE 'short' END,
    service_order) FILTER (got <> planned), 'intact') AS state,
  coalesce(string_agg(service || ' ' || got || '/' || planned, ', ' ORDER BY service_order)
    FILTER (got <> planned), '') AS notes
FROM (SELECT p.*, coalesce(delivered, 0) AS got FROM c_plan p LEFT JOIN c_sent
  USING (service, hour)) GROUP BY 1""",
    "J1_stream_ingest": "SELECT group_id, count(*) AS events FROM c_ev GROUP BY 1",
    "J1_stream_store": "SELECT group_id, count(*) AS events FROM c_ev GROUP BY 1",
    "B5_late_duplicates": "SELECT group_id, count(*) AS events FROM c_ev GROUP BY 1",
    "B16_stream_outcomes": """SELECT CASE WHEN error IS NOT NULL THEN 'rejected' WHEN stored THEN 'stored'
    ELSE 'duplicate' END AS outcome, count(*) AS events FROM c_outcomes GROUP BY 1""",
    "G2_sweep_record": """SELECT TIMESTAMP '2024-01-31' AS ran_at, 'scheduled' AS source, 14 AS window_days,
  count(*) AS deleted_events, CAST(1 AS BIGINT) AS events_bytes FROM c_ev WHERE received_at < TIMESTAMP '2024-01-17'""",
    "H3_year_trend": """SELECT group_id, CAST(sum(event_count) AS BIGINT) AS event_count FROM c_rollup
WHERE bucket_start >= TIMESTAMP '2023-02-10 05:00:00' AND bucket_start < TIMESTAMP '2024-01-27 03:00:00' GROUP BY 1""",
    "J2_stream_rollup": _ROLLUP,
    "J2_stream_windows": """SELECT * FROM c_rollup WHERE bucket_start + INTERVAL 1 HOUR <=
  (SELECT max(received_at) - INTERVAL 1 MINUTE FROM c_ev)""",
    "J4_stream_silence": """WITH m AS (SELECT max(received_at) - INTERVAL 1 MINUTE AS mark FROM c_ev)
SELECT group_id, sweep_at, CAST(count(*) AS INTEGER) AS busy_hours
FROM (SELECT group_id, bucket_start, unnest(generate_series(bucket_start + INTERVAL 1 HOUR,
        bucket_start + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS sweep_at
      FROM c_rollup, m WHERE bucket_start + INTERVAL 1 HOUR <= mark), m
WHERE sweep_at <= mark
GROUP BY ALL HAVING count(*) FILTER (bucket_start > sweep_at - INTERVAL 3 HOUR) = 0
  AND count(*) >= 6""",
    "J3_stream_alerts": """SELECT e.group_id, e.kind, e.at_time, (SELECT min(c.event_id) FROM c_cand c
  WHERE c.group_id = e.group_id AND c.kind = e.kind AND c.at_time = e.at_time) AS event_id FROM emit_c_cand e
WHERE e.kind <> 'silence' AND e.at_time < (
  SELECT date_trunc('millisecond', max(moment)) - INTERVAL 1 MINUTE FROM (
    SELECT received_at AS moment FROM c_ev UNION ALL SELECT changed_at FROM c_log))""",
})


def statements() -> dict[str, str]:
    return {name: build(sql) for name, sql in STATEMENTS.items()}
