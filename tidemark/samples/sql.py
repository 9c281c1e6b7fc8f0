"""Building blocks of the reference SQL (DuckDB dialect), the mirror of `tables`."""

BASE = """
WITH lang AS (SELECT p_partkey, p_brand FROM part WHERE p_size <= 25),
src AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) + 1 AS rid FROM events),
canon AS (
  SELECT event_id,
    CASE event_type WHEN 'click' THEN 'WatchEvent' WHEN 'view' THEN 'PushEvent' WHEN 'purchase' THEN 'ForkEvent'
                    WHEN 'signup' THEN 'IssuesEvent' WHEN 'error' THEN 'CreateEvent' END AS event_type,
    CAST(date_trunc('second', ts) AS TIMESTAMP) AS created_at,
    user_id AS actor_id,
    'user-' || user_id AS actor_login,
    rid AS repo_id,
    'org' || (rid % 10) || '/repo' || rid AS repo_name,
    CAST(CASE WHEN rid % 7 = 0 THEN rid % 10 + 1 ELSE 0 END AS BIGINT) AS org_id,
    coalesce(p_brand, '') AS language,
    CAST(strlen(props) AS BIGINT) AS payload_size,
    CASE event_type WHEN 'view' THEN 'refs/heads/main' WHEN 'error' THEN 'main' ELSE '' END AS ref
  FROM src LEFT JOIN lang ON p_partkey = rid
)"""

CANON_COLUMNS = (
    "event_id, event_type, created_at, actor_id, actor_login, repo_id, repo_name, org_id, language, payload_size, ref"
)
UNENRICHED = CANON_COLUMNS.replace("language", "'' AS language")

ROLLUPS = f"""{BASE},
stars AS (
  SELECT repo_id, max_by(repo_name, event_id) AS repo_name, CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS hour,
         count(*) AS stars, max(event_id) AS last_event_id
  FROM canon WHERE event_type = 'WatchEvent' GROUP BY repo_id, date_trunc('hour', created_at)
),
langs AS (
  SELECT CAST(created_at AS DATE) AS day, language, count(*) AS events
  FROM canon WHERE language <> '' GROUP BY ALL
),
activity AS (
  SELECT CAST(isodow(created_at) AS INTEGER) AS weekday, CAST(hour(created_at) AS INTEGER) AS hour, count(*) AS events
  FROM canon GROUP BY ALL
)"""


def trending(since: str, condition: str = "true", limit: int = 50, having: str = "true") -> str:
    return f"""{BASE}
SELECT repo_id, max_by(repo_name, event_id) AS repo_name, count(*) AS stars
FROM canon WHERE event_type = 'WatchEvent' AND created_at >= TIMESTAMP '{since}' AND {condition}
GROUP BY repo_id HAVING {having} ORDER BY stars DESC, repo_id LIMIT {limit}"""


# Ids in the upper half of the unsigned numbers, as the bits they are held in (see `tables.with_big_ids`).
BIG_EVENT = "CAST(CASE WHEN repo_id = 85 THEN event_id - 9223372036854775808 ELSE event_id END AS BIGINT) AS event_id"
BIG_ACTOR = "CAST(CASE WHEN repo_id = 84 THEN actor_id - 9223372036854775808 ELSE actor_id END AS BIGINT) AS actor_id"
WIDE = UNENRICHED.replace("event_id", BIG_EVENT, 1).replace("actor_id", BIG_ACTOR, 1)

# Raw feed lines: which are rejected and what remains (see `tables.raw_lines`).
RAW = f"""{BASE},
tagged AS (
  SELECT * REPLACE (
      {BIG_EVENT}, {BIG_ACTOR},
      '' AS language,
      CAST(CASE WHEN repo_id IN (98, 99) THEN 0
           WHEN event_type = 'PushEvent' AND repo_id % 2 = 0 THEN strlen('{{"push_id":1,"size":1,"commits":[],"ref":"refs/heads/main"}}')
           WHEN event_type = 'PushEvent' THEN strlen('{{"push_id":1,"ref":"refs/heads/main"}}')
           WHEN event_type = 'CreateEvent' THEN strlen('{{"ref":"main","ref_type":"branch"}}')
           WHEN event_type = 'WatchEvent' THEN strlen('{{"action":"started"}}')
           ELSE strlen('{{"ref":"ignored","n":' || canon.event_id || '}}') END AS BIGINT) AS payload_size,
      CASE WHEN repo_id IN (98, 99) THEN '' ELSE ref END AS ref,
      CASE WHEN repo_id = 97 THEN 0 ELSE org_id END AS org_id),
    CASE WHEN repo_id = 91 THEN 'bad_id' WHEN repo_id = 92 THEN 'no_type' WHEN repo_id = 93 THEN 'no_created_at'
         WHEN repo_id = 94 THEN 'malformed_json' WHEN repo_id IN (95, 96) THEN 'wrong_field_type' END AS reject_reason
  FROM canon
)"""

# The same lines in an archive (see `tables.archive_lines`); lines of blanks are events to no one but the reject counter.
ARCHIVE = f"""{RAW},
lines AS (
  SELECT * REPLACE (
      CAST(CASE repo_id WHEN 86 THEN strlen('{{ "ref" : [ 1.50 ] }}') WHEN 87 THEN strlen('"\\u0041 \\/ \u00e9"') ELSE payload_size END AS BIGINT)
        AS payload_size,
      CASE WHEN repo_id IN (86, 87) THEN '' ELSE ref END AS ref,
      CASE WHEN repo_id IN (88, 89) THEN 'malformed_json' ELSE reject_reason END AS reject_reason)
  FROM tagged
  UNION ALL BY NAME SELECT 'malformed_json' AS reject_reason FROM tagged WHERE repo_id = 90
)"""

# Bus messages: which are poison (see `tables.bus_messages`).
BUS = f"""{BASE},
checked AS (
  SELECT {WIDE}, CAST(canon.event_id % 6 AS INTEGER) AS "partition", canon.event_id // 6 AS "offset",
    CASE WHEN repo_id IN (91, 96) THEN 'value is not a JSON object' WHEN repo_id = 92 THEN 'event_id is missing'
         WHEN repo_id = 93 THEN 'event_type is empty' WHEN repo_id = 94 THEN 'created_at is the zero time'
         WHEN repo_id = 95 THEN 'ref is not a string' END AS error
  FROM canon
)"""

# The value of a message as it stands on the bus, broken ones included.
MESSAGE_VALUE = """CASE WHEN repo_id = 91 THEN 'not json' WHEN repo_id = 92 THEN '{}' ELSE
  '{"event_id":' || event_id || ',"event_type":"' || CASE WHEN repo_id = 93 THEN '' ELSE event_type END || '","created_at":"'
  || CASE WHEN repo_id = 94 THEN '0001-01-01T00:00:00Z' ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') END
  || '","actor_id":' || actor_id || ',"actor_login":"' || actor_login || '","repo_id":' || repo_id || ',"repo_name":"' || repo_name
  || '","org_id":' || org_id || ',"language":"","payload_size":' || payload_size || ',"ref":'
  || CASE WHEN repo_id = 95 THEN '7' ELSE '"' || ref || '"' END || '}' || CASE WHEN repo_id = 96 THEN ' tail' ELSE '' END END"""
