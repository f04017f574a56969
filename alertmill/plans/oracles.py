"""The catalog's queries in plain SQL, to check results with another engine."""

from __future__ import annotations

from alertmill.plans.catalog import (
    AS_OF, BAN, GREP, LOOPING, NOTIFY, NOTIFY_THRESHOLD, QUERIES_BY_ID, SEND_THRESHOLD, WORDS,
)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows) -> str:
    def item(v):
        return "NULL" if v is None else str(v) if isinstance(v, int) else _q(v)

    return ", ".join("(" + ", ".join(item(v) for v in row) + ")" for row in rows)


# The message payload of an event.
_STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
_PAYLOAD = (
    """'{"host":"' || user_id || '","severity":"' || event_type || '","facility":"app","timestamp":"' || """
    + _STAMP
    + """ || '","msg":"' || replace(replace(props, '\\', '\\\\'), '"', '\\"') || '"}'"""
)
_MESSAGES = f"SELECT event_id AS id, ts, user_id, event_type, props, {_PAYLOAD} AS payload, 'slg.' || event_type || '.app.' || user_id AS subject FROM events"
_TEXT = "user_id || '|' || event_type || '|' || props"

_BAN_ACTIVE = f"(SELECT p FROM (VALUES {_values(BAN)}) b(p, e) WHERE e IS NULL OR e::TIMESTAMP >= TIMESTAMP '{AS_OF}')"
_NOTIFY = f"(VALUES {_values([(p,) for p in NOTIFY])}) n(p)"
_CANDIDATES = f"""
SELECT * FROM ({_MESSAGES}) m
WHERE NOT EXISTS (SELECT 1 FROM {_BAN_ACTIVE} b WHERE regexp_matches(m.payload, b.p))
  AND EXISTS (SELECT 1 FROM {_NOTIFY} WHERE regexp_matches(m.payload, n.p))"""


def _ring(rows: str, order: str = "id", partition: str = "", seconds: int = 300) -> str:
    """``rows`` (id, ts, payload, ..) with the list ``live`` each row is compared with."""
    part = f"PARTITION BY {partition} " if partition else ""
    return f"""
SELECT *, list_filter(coalesce(ring, []), lambda r: epoch_us(ts) - r.us <= {seconds}::BIGINT * 1000000 AND r.t <> '') AS live
FROM (SELECT *, list({{'us': epoch_us(ts), 't': payload}}) OVER ({part}ORDER BY ts, {order} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS ring
      FROM ({rows}))"""


_MIN = "list_min(list_transform(live, lambda r: levenshtein(r.t, payload)))"

# CRC32 by its definition, one table entry per byte value.
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([n, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) r(n))"""


def _crc(text: str) -> str:
    return f"""xor(4294967295::BIGINT, list_reduce(list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT))"""


_EXPIRES = "CASE WHEN user_id % 11 <> 0 THEN ts + (user_id % 50) * INTERVAL 1 HOUR END"
_IDS = f"{_CRC_TABLE}, ids AS MATERIALIZED (SELECT p, {_crc('p')} AS id FROM (SELECT DISTINCT props AS p FROM events), crc_table)"
_ADDS = f"""{_IDS}, adds AS (
  SELECT event_type AS list_name, i.id, props AS pattern, {_EXPIRES} AS expired_at, ts, event_id AS seq, value, user_id
  FROM events JOIN ids i ON i.p = props)"""
_FIRSTS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY list_name, id ORDER BY ts, seq) AS rn FROM {}) WHERE rn = 1"
_RFC = "CASE WHEN expired_at IS NULL THEN '0001-01-01T00:00:00Z' ELSE strftime(expired_at, '%Y-%m-%dT%H:%M:%S') || rtrim(rtrim('.' || strftime(expired_at, '%f'), '0'), '.') || 'Z' END"
_ITEM = "'{\"pattern\":\"' || replace(pattern, '\"', '\\\"') || '\",\"expired_at\":\"' || " + _RFC + " || '\"}'"


# Commands stepped through one by one for each item.
def _steps(log: str) -> str:
    return f"""WITH RECURSIVE {_ADDS}, log AS ({log}),
cmds AS (SELECT *, row_number() OVER (PARTITION BY list_name, id ORDER BY ts, seq) AS rn FROM log),
steps AS (
  SELECT list_name, id, rn, seq, NOT rm AS present, CASE WHEN NOT rm THEN pattern END AS pattern, CASE WHEN NOT rm THEN expired_at END AS expired_at,
         CASE WHEN rm THEN 'not_found' ELSE 'ok' END AS status
  FROM cmds WHERE rn = 1
  UNION ALL
  SELECT c.list_name, c.id, c.rn, c.seq, NOT c.rm,
         CASE WHEN c.rm THEN NULL WHEN s.live THEN s.pattern ELSE c.pattern END,
         CASE WHEN c.rm THEN NULL WHEN s.live THEN s.expired_at ELSE c.expired_at END,
         CASE WHEN c.rm THEN CASE WHEN s.live THEN 'ok' ELSE 'not_found' END
              ELSE CASE WHEN s.live THEN 'duplicate' ELSE 'ok' END END
  FROM (SELECT s0.*, s0.present AND (s0.expired_at IS NULL OR s0.expired_at >= n.ts) AS live
        FROM steps s0 JOIN cmds n ON n.list_name = s0.list_name AND n.id = s0.id AND n.rn = s0.rn + 1) s
  JOIN cmds c ON c.list_name = s.list_name AND c.id = s.id AND c.rn = s.rn + 1)
"""


_STEPS = _steps("SELECT 'list' || (user_id % 5) AS list_name, id, list_name = 'error' AS rm, pattern, expired_at, ts, seq FROM adds")
_CHAT_STEPS = _steps(
    "SELECT 'ban' AS list_name, id, list_name = 'view' AS rm, pattern, ts + user_id * INTERVAL 1 HOUR AS expired_at, ts, seq "
    "FROM adds WHERE list_name IN ('click', 'signup', 'view')"
)

_SECONDS = """CASE WHEN regexp_full_match({d}, '0|([0-9]+[hm])+') THEN
  coalesce(list_sum(list_transform(regexp_extract_all({d}, '([0-9]+)h', 1), lambda v: v::BIGINT)), 0)::BIGINT * 3600
  + coalesce(list_sum(list_transform(regexp_extract_all({d}, '([0-9]+)m', 1), lambda v: v::BIGINT)), 0)::BIGINT * 60 END"""

_CHAT = """chat AS (
  SELECT conv_id * 1000 + turn AS update_id, conv_id::VARCHAR AS sender,
         CASE role WHEN 'user' THEN '/list ban add ' || turn || 'h30m ' || text
                   WHEN 'assistant' THEN '/list notify add ' || turn || ' ' || text
                   ELSE '/whois ' || text END AS text,
         make_timestamp((1700000000 + conv_id * 1000 + turn) * 1000000) AS ts
  FROM conversations)"""
_CHAT_ROUTES = ", ".join(
    f"('{n}', '{c}', '{p}')"
    for n in ("ban", "notify")
    for c, p in (("ls", f"/list {n} ls"), ("add", f"/list {n} add [0-9hm]* .*"), ("rm", f"/list {n} rm [0-9]*"), ("help", f"/list {n} help"))
) + ", (NULL, 'whois', '/whois .*')"
_CHAT_ADDS = f"""WITH {_CHAT}, a AS (
  SELECT update_id, ts, l AS list_name, regexp_extract(text, '/list ' || l || ' add ([0-9hm]*) (.*)', 1) AS d,
         regexp_extract(text, '/list ' || l || ' add ([0-9hm]*) (.*)', 2) AS pattern
  FROM chat, (VALUES ('ban'), ('notify')) v(l)
  WHERE regexp_matches(text, '/list ' || l || ' add [0-9hm]* .*')),
parsed AS (SELECT *, {_SECONDS.format(d='d')} AS secs FROM a)"""

_DEVICES = """dev AS (
  SELECT p_partkey AS id, p_name AS name, '10.' || ((p_partkey >> 16) & 255) || '.' || ((p_partkey >> 8) & 255) || '.' || (p_partkey & 255) AS ip,
         p_brand AS brand, p_type AS type, p_size::VARCHAR AS size FROM part),
attrs AS (SELECT id, name, ip, 'brand' AS attr, brand AS value FROM dev UNION ALL SELECT id, name, ip, 'type', type FROM dev
          UNION ALL SELECT id, name, ip, 'size', size FROM dev UNION ALL SELECT id, name, ip, '*', '*' FROM dev)"""
# The pairs of each query, as its body states them.
_PAIRS = [
    (1, "brand", "Brand#2"), (1, "type", "ECONOMY"), (2, "brand", "Brand#2"), (2, "type", "SMALL"), (2, "size", "7"),
    (3, "brand", "Brand#none"), (5, "*", "*"), (6, "*", "*"), (6, "size", "11"),
]
_DIVISION = f"""pairs(query_id, attr, value) AS (VALUES {_values(_PAIRS)}),
sizes AS (SELECT query_id, count(*) AS size FROM pairs GROUP BY query_id),
found AS (SELECT query_id, id, name, ip FROM (SELECT p.query_id, a.id, a.name, a.ip, count(*) AS n FROM pairs p JOIN attrs a USING (attr, value) GROUP BY 1, 2, 3, 4)
          JOIN sizes USING (query_id) WHERE n = size),
known AS (SELECT query_id FROM pairs p GROUP BY query_id
          HAVING bool_and(EXISTS (SELECT 1 FROM attrs a WHERE a.attr = p.attr AND a.value = p.value))),
statuses AS (SELECT query_id, CASE WHEN query_id IN (7, 8) THEN 'bad_request' WHEN query_id IN (SELECT query_id FROM known) THEN 'ok' ELSE 'no_result' END AS status
             FROM (VALUES {_values([(q,) for q, _ in QUERIES_BY_ID])}) v(query_id))"""

_LINES = r"""lines AS (
  SELECT doc_id * 16777216 + i - 1 AS line_no, regexp_replace(l, '\r$', '') AS value FROM (
    SELECT doc_id, unnest(parts) AS l, unnest(range(1, len(parts) + 1)) AS i
    FROM (SELECT doc_id, string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS parts
          FROM documents WHERE length(text) > 0)))"""
_HITS = f"""g(query_id, pattern) AS (VALUES {_values(GREP)}),
hits AS (SELECT g.query_id, g.pattern, l.line_no, l.value FROM (SELECT * FROM g WHERE query_id <> 5) g JOIN lines l ON regexp_matches(l.value, g.pattern))"""

_LOST = """SELECT e.event_id AS nonce, e.ts AS sent_at FROM events e
LEFT JOIN events v ON v.event_id = e.event_id + 1 AND v.event_type = 'view' AND v.ts >= e.ts AND v.ts <= e.ts + INTERVAL 300 SECOND
WHERE e.event_type = 'error' AND v.event_id IS NULL"""

# Largest number of characters that fit 4000 bytes, by halving steps.
_FIT = "list_reduce([0, 2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1], lambda n, b: CASE WHEN strlen(left(text, n + b)) <= 4000 THEN n + b ELSE n END)"


def _escaped(text: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("''", "&#39;"), ('"', "&#34;")):
        text = f"replace({text}, '{char}', '{entity}')"
    return text


_UPDATES = """ups AS (
  SELECT conv_id * 1000 + turn AS update_id, conv_id, role, 1700000000 + turn * 60 AS date, text FROM conversations)"""
_FRESH = f"""WITH {_UPDATES}
SELECT update_id, conv_id::VARCHAR AS sender, text, make_timestamp(date * 1000000) AS ts
FROM ups WHERE role <> 'system' AND date > 0 AND 1700000360 - date < 180"""

_NEAR_BY_USER = f"""SELECT id, payload FROM ({_ring(f"SELECT event_id AS id, ts, user_id, {_TEXT} AS payload FROM events", partition="user_id", seconds=86400)})
WHERE NOT coalesce({_MIN} < {SEND_THRESHOLD}, FALSE)"""
_SENT = f"""SELECT id, subject, '#syslog message at ' || {_STAMP} || chr(10) || user_id || chr(10) || props AS alert_text
FROM ({_ring(_CANDIDATES)}) WHERE len(live) > 0 AND NOT {_MIN} < {NOTIFY_THRESHOLD}"""

ORACLE_SQL: dict[str, str] = {
    "syslog_parse": f"SELECT event_id AS id, user_id::VARCHAR AS host, event_type AS severity, 'app' AS facility, {_STAMP} AS sent, props AS msg FROM events",
    "syslog_rejects": rf"""
SELECT id, payload, CASE WHEN NOT json_valid(payload) THEN 'not_one_document'
   WHEN json_type(CASE WHEN json_valid(payload) THEN payload END) <> 'OBJECT' THEN 'not_an_object'
   ELSE 'wrong_field_type' END AS reject_reason
FROM (SELECT id, CASE event_type WHEN 'view' THEN left(payload, length(payload) - 5)
         WHEN 'purchase' THEN regexp_replace(payload, '"host":"([0-9]+)"', '"host":\1')
         WHEN 'signup' THEN payload || ' ' || payload WHEN 'error' THEN '[' || payload || ']' ELSE payload END AS payload
      FROM ({_MESSAGES}))
WHERE NOT json_valid(payload) OR json_type(CASE WHEN json_valid(payload) THEN payload END) <> 'OBJECT'
   OR json_type(CASE WHEN json_valid(payload) THEN payload END, '$.host') <> 'VARCHAR'""",
    "subject_publish": f"SELECT id, subject, payload FROM ({_MESSAGES})",
    "subject_filter": rf"""
SELECT id, subject, s AS subscription FROM ({_MESSAGES}),
  (VALUES ('slg.error.>', '^slg\.error\..+$'), ('slg.*.app.7', '^slg\.[^.]+\.app\.7$'), ('slg.view.app.11', '^slg\.view\.app\.11$')) v(s, re)
WHERE regexp_matches(subject, re)""",
    "publish_folders": f"SELECT subject, payload, event_type AS severity, 'app' AS facility FROM ({_MESSAGES})",
    "ban_filter": f"SELECT id, payload FROM ({_MESSAGES}) m WHERE NOT EXISTS (SELECT 1 FROM {_BAN_ACTIVE} b WHERE regexp_matches(m.payload, b.p))",
    "list_exists": f"SELECT doc_id, EXISTS (SELECT 1 FROM (VALUES {_values(WORDS)}) w(n, p) WHERE regexp_matches(d.text, w.p)) AS matched FROM documents d",
    "pattern_routes": f"SELECT doc_id, 'r' || n AS route, p AS pattern FROM documents d JOIN (VALUES {_values(WORDS)}) w(n, p) ON regexp_matches(d.text, w.p)",
    "pattern_index": "SELECT event_id AS id, c_custkey::VARCHAR AS route FROM events JOIN customer ON c_custkey = user_id WHERE event_type IN ('error', 'view', 'click')",
    "ban_index": f"SELECT id, payload FROM ({_MESSAGES}) m WHERE event_type NOT IN ('error', 'view', 'click') OR user_id NOT IN (SELECT c_custkey FROM customer)",
    "pattern_loops": f"SELECT doc_id, 'r' || n AS route, p AS pattern FROM documents d JOIN (VALUES {_values(LOOPING)}) w(n, p) ON regexp_matches(d.text, w.p)",
    "near_dup_send": f"""SELECT id, payload FROM ({_ring(f"SELECT event_id AS id, ts, {_TEXT} AS payload FROM events")})
WHERE len(live) > 0 AND NOT {_MIN} < {SEND_THRESHOLD}""",
    "near_dup_by_user": _NEAR_BY_USER,
    "near_dup_stream": _NEAR_BY_USER,
    "min_distance": f"""SELECT id, coalesce({_MIN}, -1)::BIGINT AS distance FROM ({_ring(f"SELECT event_id AS id, ts, {_TEXT} AS payload FROM events")})""",
    "notify_alerts": _SENT,
    "notify_fanout": f"""SELECT id, matched_pattern FROM ({_ring(f"SELECT c.*, n.p AS matched_pattern FROM ({_CANDIDATES}) c JOIN {_NOTIFY} ON regexp_matches(c.payload, n.p)", order="id, matched_pattern")})
WHERE len(live) > 0 AND NOT {_MIN} < {NOTIFY_THRESHOLD}""",
    "notify_stream": f"SELECT id, -100::BIGINT AS chat_id, 'HTML' AS parse_mode, '<pre>' || {_escaped('alert_text')} || '</pre>' AS text FROM ({_SENT})",
    "alert_render": f"""
SELECT id, CASE WHEN user_id % 3 = 0 THEN '-100' || user_id END AS chat_id, 'HTML' AS parse_mode,
       '<pre>' || {_escaped(f"('#syslog message at ' || {_STAMP} || chr(10) || user_id || chr(10) || props)")} || '</pre>' AS text,
       CASE WHEN user_id % 3 <> 0 THEN 'chat id unspecified' END AS reject_reason
FROM ({_MESSAGES})""",
    "alert_html": f"""
SELECT doc_id, CASE WHEN length(text) > 0 THEN '<pre>' || {_escaped("cut")} || '</pre>' END AS html
FROM (SELECT doc_id, text, CASE WHEN strlen(text) <= 4000 THEN text ELSE left(text, n) || repeat(chr(65533), 4000 - strlen(left(text, n))) END AS cut
      FROM (SELECT doc_id, text, {_FIT} AS n FROM documents))""",
    "batch_salt": f"WITH {_CRC_TABLE} SELECT event_id, ({_crc('s')})::VARCHAR AS batch_id FROM (SELECT event_id, props || '.' || (event_id % 1000) AS s FROM events), crc_table",
    "list_add_first_wins": f"WITH {_ADDS} SELECT list_name, id, pattern, seq FROM ({_FIRSTS.format('adds')})",
    "list_add_outcomes": f"""WITH {_ADDS} SELECT seq, id, CASE WHEN row_number() OVER (PARTITION BY list_name, id ORDER BY ts, seq) = 1 THEN 'ok' ELSE 'duplicate' END AS status FROM adds""",
    "list_upload": f"""WITH {_ADDS}
SELECT seq, list_name, pattern, id::VARCHAR AS id, expired_at, CASE WHEN row_number() OVER (PARTITION BY list_name, id ORDER BY ts, seq) = 1 THEN 'ok' ELSE 'duplicate' END AS status
FROM adds WHERE list_name <> 'view'
UNION ALL SELECT seq, list_name, NULL, NULL, NULL, 'bad_request' FROM adds WHERE list_name = 'view'""",
    "list_active": f"WITH {_ADDS} SELECT seq, list_name, id, expired_at FROM adds WHERE expired_at IS NULL OR expired_at >= TIMESTAMP '{AS_OF}'",
    "list_delete": f"""WITH {_ADDS},
d AS (SELECT list_name, CASE WHEN seq % 97 <> 0 THEN id ELSE 0 END AS id, ts, seq FROM adds WHERE value >= 20),
k AS (SELECT DISTINCT list_name, id FROM adds WHERE value < 20)
SELECT seq, d.id, CASE WHEN d.id = 0 THEN 'bad_request' WHEN k.id IS NOT NULL AND row_number() OVER (PARTITION BY d.list_name, d.id ORDER BY ts, seq) = 1 THEN 'ok' ELSE 'not_found' END AS status
FROM d LEFT JOIN k ON k.list_name = d.list_name AND k.id = d.id""",
    "list_remaining": f"""WITH {_ADDS}, f AS ({_FIRSTS.format('adds')})
SELECT list_name, id, pattern FROM f WHERE NOT EXISTS (SELECT 1 FROM adds d WHERE d.value >= 60 AND d.list_name <> 'view' AND d.list_name = f.list_name AND d.id = f.id)""",
    "list_state_fold": f"{_STEPS} SELECT list_name, id, pattern, expired_at FROM (SELECT *, max(rn) OVER (PARTITION BY list_name, id) AS last FROM steps) WHERE rn = last AND present",
    "list_command_outcomes": f"{_STEPS} SELECT seq, status FROM steps",
    "list_snapshot_json": f"""WITH {_ADDS}, f AS ({_FIRSTS.format('adds')})
SELECT list_name, 0::BIGINT AS page, '{{' || string_agg('"' || id || '":' || {_ITEM}, ',' ORDER BY id) || '}}' AS body FROM f GROUP BY list_name""",
    "list_snapshot_decode": f"WITH {_ADDS} SELECT list_name, id, pattern, expired_at FROM ({_FIRSTS.format('adds')})",
    "list_text": f"""WITH {_ADDS}, f AS ({_FIRSTS.format('adds')})
SELECT list_name, 0::BIGINT AS page, string_agg(id || ':' || pattern || ':' || replace(rtrim({_RFC}, 'Z'), 'T', ' ') || ' +0000 UTC' || chr(10), '' ORDER BY id) AS body FROM f GROUP BY list_name""",
    "list_gc": f"WITH {_ADDS} SELECT list_name, count(*) FILTER (WHERE expired_at IS NULL OR expired_at >= TIMESTAMP '{AS_OF}') AS n_live, count(*) AS n_items FROM adds GROUP BY list_name",
    "list_gc_empty": f"""WITH {_ADDS} SELECT list_name || ':' || pattern || ':' || strftime(ts, '%Y-%m-%d') AS list_name FROM adds GROUP BY 1
HAVING count(*) FILTER (WHERE expired_at IS NULL OR expired_at >= TIMESTAMP '2024-01-20 00:00:00') = 0""",
    "list_patterns": "SELECT DISTINCT props AS pattern FROM events WHERE event_type = 'error'",
    "duration_parse": f"""
SELECT p_partkey, d AS duration, secs::VARCHAR AS seconds, TIMESTAMP '2024-01-01 00:00:00' + secs * INTERVAL 1 SECOND AS expired_at,
       CASE WHEN secs IS NULL THEN 'duration ' || d || ' is incorrect' END AS reply
FROM (SELECT p_partkey, d, {_SECONDS.format(d='d')} AS secs FROM (
  SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN p_size || 'h' WHEN 'ECONOMY' THEN p_partkey || 'm' || p_size || 'h' WHEN 'LARGE' THEN p_size::VARCHAR
    WHEN 'MEDIUM' THEN p_size || 'h' || p_partkey ELSE '0' || p_size || 'h' || p_partkey || 'm1h' END AS d FROM part))""",
    "chat_updates": _FRESH,
    "chat_stream": _FRESH,
    "chat_next_offset": f"WITH {_UPDATES} SELECT greatest(max(update_id) + 1, 0)::BIGINT AS next_offset FROM ups WHERE role <> 'system'",
    "chat_commands": f"WITH {_CHAT} SELECT update_id, l AS list_name, c AS command FROM chat JOIN (VALUES {_CHAT_ROUTES}) r(l, c, p) ON regexp_matches(text, p)",
    "chat_adds": f"""{_CHAT_ADDS}
SELECT update_id, list_name, pattern, ts + secs * INTERVAL 1 SECOND AS expired_at, CASE WHEN secs IS NULL THEN 'duration ' || d || ' is incorrect' END AS reply FROM parsed""",
    "chat_list_state": _CHAT_ADDS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
ok AS (SELECT list_name, pattern, ts, update_id, ts + secs * INTERVAL 1 SECOND AS expired_at FROM parsed WHERE secs IS NOT NULL),
chain AS (
  SELECT list_name, pattern, arg_min(ts, (ts, update_id)) AS ts, arg_min(expired_at, (ts, update_id)) AS expired_at FROM ok GROUP BY list_name, pattern
  UNION ALL
  SELECT n.list_name, n.pattern, n.ts, n.expired_at FROM (
    SELECT o.list_name, o.pattern, o.ts, o.expired_at, row_number() OVER (PARTITION BY o.list_name, o.pattern ORDER BY o.ts, o.update_id) AS k
    FROM chain c JOIN ok o ON o.list_name = c.list_name AND o.pattern = c.pattern AND o.ts > c.expired_at) n WHERE k = 1)
SELECT list_name, pattern, max(expired_at) AS expired_at FROM chain GROUP BY list_name, pattern""",
    "chat_whois": f"WITH {_CHAT} SELECT update_id, regexp_extract(text, '/whois (.*)', 1) AS pattern FROM chat WHERE regexp_matches(text, '/whois .*')",
    "chat_removes": f"WITH {_ADDS} SELECT seq AS update_id, 'ban' AS list_name, id FROM adds WHERE list_name = 'view'",
    "chat_change_replies": f"""{_CHAT_STEPS}
SELECT a.user_id::VARCHAR AS sender, CASE WHEN s.status <> 'ok' THEN 'can''t change the list, ' || s.status
   WHEN a.list_name = 'view' THEN 'record removed' ELSE 'record added' END AS text
FROM steps s JOIN adds a USING (seq)""",
    "chat_list_replies": f"""{_CHAT_STEPS},
asked AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
held AS (SELECT e.event_id, e.ts AS asked_at, s.id, arg_max(s.present, s.rn) AS present, arg_max(s.pattern, CASE WHEN s.present THEN s.rn END) AS pattern,
           arg_max(s.expired_at, CASE WHEN s.present THEN s.rn END) AS expired_at
         FROM steps s JOIN adds a USING (seq) JOIN asked e ON a.ts < e.ts OR a.ts = e.ts AND a.seq < e.event_id GROUP BY ALL),
rows AS (SELECT event_id, id, id || ':' || pattern || ':' || replace(rtrim({_RFC}, 'Z'), 'T', ' ') || ' +0000 UTC' AS line
         FROM held WHERE present AND expired_at >= asked_at)
SELECT user_id::VARCHAR AS sender, coalesce(string_agg(line || chr(10), '' ORDER BY id), '') AS text
FROM asked LEFT JOIN rows USING (event_id) GROUP BY event_id, user_id""",
    "list_history": f"""{_STEPS},
ok AS (SELECT s.list_name, s.id, s.pattern, s.expired_at, s.present, a.ts, s.seq FROM steps s JOIN adds a USING (seq) WHERE status = 'ok'
       AND NOT coalesce(s.present AND s.expired_at < a.ts, false)),
next AS (SELECT *, lead(NOT present) OVER w AS ends, lead(ts) OVER w AS to_ts, lead(seq) OVER w AS to_s FROM ok WINDOW w AS (PARTITION BY list_name, id ORDER BY ts, seq))
SELECT list_name, id, pattern, seq AS from_seq, CASE WHEN ends THEN to_s END AS to_seq, ts AS from_at, CASE WHEN ends THEN to_ts END AS to_at, expired_at
FROM next WHERE present""",
    "chat_list_replies_last": f"""{_CHAT_STEPS},
state AS (SELECT id, pattern, expired_at FROM (SELECT *, max(rn) OVER (PARTITION BY list_name, id) AS last FROM steps)
          WHERE rn = last AND present AND expired_at >= TIMESTAMP '{AS_OF}'),
rows AS (SELECT id, id || ':' || pattern || ':' || replace(rtrim({_RFC}, 'Z'), 'T', ' ') || ' +0000 UTC' AS line FROM state)
SELECT user_id::VARCHAR AS sender, coalesce((SELECT string_agg(line || chr(10), '' ORDER BY id) FROM rows), '') AS text
FROM events WHERE event_type = 'error'""",
    "chat_whois_replies": """
WITH asks AS (SELECT user_id::VARCHAR AS sender, '#0*' || (user_id % 10) || '$' AS p FROM events WHERE event_type = 'purchase'),
hits AS (SELECT p, c_custkey, c_name FROM (SELECT DISTINCT p FROM asks) JOIN customer ON regexp_matches(c_name, p)),
r AS (SELECT p, string_agg(c_name, chr(10) ORDER BY c_custkey) AS t FROM hits GROUP BY p)
SELECT sender, coalesce(t, 'no_content from whois-service for query:' || asks.p) AS text FROM asks LEFT JOIN r ON r.p = asks.p""",
    "device_search": f"WITH {_DEVICES} SELECT id, name, ip FROM dev WHERE brand = 'Brand#2' AND type = 'ECONOMY'",
    "device_search_batch": f"WITH {_DEVICES}, {_DIVISION} SELECT query_id::BIGINT AS query_id, id, name, ip FROM found",
    "device_search_status": f"WITH {_DEVICES}, {_DIVISION} SELECT s.query_id::BIGINT AS query_id, status, count(f.id) AS n_found FROM statuses s LEFT JOIN found f USING (query_id) GROUP BY ALL",
    "device_search_json": f"""WITH {_DEVICES}, {_DIVISION}
SELECT s.query_id::BIGINT AS query_id, s.status, CASE WHEN status = 'ok' THEN '0' END AS page,
       CASE WHEN status = 'ok' THEN coalesce('[' || string_agg('{{"name":"' || name || '","ip":"' || ip || '"}}', ',' ORDER BY id) || ']', '[]') END AS body
FROM statuses s LEFT JOIN found f USING (query_id) GROUP BY s.query_id, s.status""",
    "device_by_brand": f"WITH {_DEVICES} SELECT id AS query_id, 'ok' AS status, count(*) OVER (PARTITION BY brand, type) AS n_found FROM dev",
    "attribute_index": f"WITH {_DEVICES} SELECT attr, value, id >> 10 AS span, count(*) AS count, string_agg(id, ',' ORDER BY id) AS ids FROM attrs GROUP BY 1, 2, 3",
    "device_index_search": f"WITH {_DEVICES} SELECT id FROM dev WHERE brand = 'Brand#2' AND (type = 'ECONOMY' OR id % 10 = 0)",
    "attribute_counts": f"WITH {_DEVICES} SELECT attr, value, count(*) AS count FROM attrs GROUP BY ALL",
    "device_file_load": f"WITH {_DEVICES} SELECT name, ip, brand, size FROM dev",
    "device_array_load": f"WITH {_DEVICES} SELECT row_number() OVER (ORDER BY encode((id // 500) || '/'), id) - 1 AS id, name, ip, type FROM dev",
    "list_snapshot_read": f"WITH {_ADDS} SELECT list_name, id, pattern, expired_at FROM ({_FIRSTS.format('adds')}) WHERE list_name = 'error'",
    "route_handlers": f"""SELECT doc_id, length(text) AS value FROM documents WHERE regexp_matches(text, {_q(WORDS[1][1])})
UNION ALL SELECT -1, count(*) FROM documents WHERE regexp_matches(text, {_q(WORDS[2][1])}) HAVING count(*) > 0""",
    "line_file_load": f"WITH {_LINES} SELECT row_number() OVER (ORDER BY line_no) AS line_no, value FROM lines",
    "whois_lines": f"WITH {_LINES}, {_HITS} SELECT pattern, line_no, value FROM hits",
    "whois_grep": f"""WITH {_LINES}, {_HITS},
r AS (SELECT pattern, count(*) AS n, string_agg(value, chr(10) ORDER BY line_no) AS t FROM hits GROUP BY pattern)
SELECT query_id::BIGINT AS query_id, g.pattern, CASE WHEN query_id = 5 THEN 'bad_request' WHEN n IS NULL THEN 'no_content' ELSE 'ok' END AS status, coalesce(n, 0) AS n_lines, 0 AS page, t AS text
FROM g LEFT JOIN r ON r.pattern = g.pattern""",
    "heartbeat_check": _LOST,
    "heartbeat_stream": f"""SELECT nonce, sent_at, 'Dear engineers, syslog doesn''t work correctly' AS text FROM ({_LOST})
WHERE sent_at + INTERVAL 330 SECOND < (SELECT least(max(ts) FILTER (WHERE event_type = 'error'), max(ts) FILTER (WHERE event_type = 'view')) FROM events)""",
    "first_arrival": """
SELECT o_orderkey AS request_id, coalesce(p, '{}') AS response, CASE WHEN p IS NULL THEN 'timeout error' END AS error
FROM orders LEFT JOIN (
  SELECT o.o_orderkey AS k, arg_min(l_partkey || '/' || l_linenumber, (l_shipdate, l_partkey || '/' || l_linenumber)) AS p
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 180 DAY
  GROUP BY 1) ON k = o_orderkey""",
    "first_arrival_hot": """
SELECT a.event_id AS request_id, coalesce(p, '{}') AS response, CASE WHEN p IS NULL THEN 'timeout error' END AS error
FROM (SELECT event_id FROM events WHERE event_type = 'error') a LEFT JOIN (
  SELECT e.event_id AS k, arg_min(m.props, (m.ts, m.props)) AS p
  FROM events e JOIN events m ON e.user_id % 3 = m.user_id % 3 AND m.ts >= e.ts AND m.ts <= e.ts + INTERVAL 120 SECOND
  WHERE e.event_type = 'error' AND m.event_type <> 'error' GROUP BY 1) ON k = a.event_id""",
    "first_arrival_stream": """
SELECT a.event_id AS request_id, coalesce(p, '{}') AS response, CASE WHEN p IS NULL THEN 'timeout error' END AS error
FROM (SELECT event_id FROM events WHERE event_type = 'error') a LEFT JOIN (
  SELECT e.event_id AS k, arg_min(m.props, (m.ts, m.props)) AS p
  FROM events e JOIN events m ON e.user_id = m.user_id AND m.ts >= e.ts AND m.ts <= e.ts + INTERVAL 7200 SECOND
  WHERE e.event_type = 'error' AND m.event_type <> 'error' GROUP BY 1) ON k = a.event_id""",
}
