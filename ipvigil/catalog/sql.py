"""SQL twins of the fixtures, as common table expressions to put in front of a check query."""

TE = """
te0 AS (
  SELECT e.event_id,
    concat(CAST(11 + CAST(floor(e.user_id / 250) AS INT) AS VARCHAR), '.', CAST(e.user_id % 250 AS VARCHAR), '.',
           CAST(CAST(floor(e.k / 5) AS INT) AS VARCHAR), '.', CAST(e.k % 5 + 1 AS VARCHAR)) AS ip,
    CASE WHEN e.event_id % 50 = 0 THEN NULL WHEN e.event_id % 211 = 5 THEN 'ZZZ'
         ELSE concat(chr(65 + n.n_nationkey), chr(65 + n.n_regionkey)) END AS country_code,
    CASE WHEN e.event_id % 97 = 0 THEN NULL WHEN e.event_id % 331 = 1 THEN e.value + CAST(100 AS DOUBLE)
         ELSE least(e.value, CAST(100 AS DOUBLE)) END AS abuse_confidence_score,
    CASE WHEN e.event_id % 50 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(n.n_nationkey * 5 - 61 AS DOUBLE) END AS latitude,
    CASE WHEN e.event_id % 50 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(n.n_nationkey * 13 - 150 AS DOUBLE) END AS longitude,
    concat(strftime(e.ts, '%Y-%m-%d'), 'T00:00:00+00:00') AS last_reported_at,
    CASE WHEN e.event_id % 40 = 0 THEN NULL ELSE e.ts END AS event_time,
    make_timestamp((CAST(ceil(epoch_us(e.ts) / 300000000) AS BIGINT) * 300 + 7) * 1000000) AS loaded_at,
    e.event_type AS source,
    CASE WHEN (e.event_id * 31) % 100 < 35
         THEN concat('C', lpad(CAST((e.event_id * 17) % 23 + 1 AS VARCHAR), 2, '0')) END AS category,
    CAST((e.event_id * 53) % 10000 AS DOUBLE) / 10000 AS reoffense_probability,
    CASE WHEN e.event_id % 20 = 3 THEN NULL
         ELSE CAST(-0.3 AS DOUBLE) - CAST((e.event_id * 37) % 3000 AS DOUBLE) / 10000 END AS anomaly_score
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
  JOIN nation n ON n.n_nationkey = (e.user_id * e.user_id) % 25
),
te AS (
  SELECT *, CASE WHEN abuse_confidence_score >= 90 THEN 'critical' WHEN abuse_confidence_score >= 70 THEN 'high'
                 WHEN abuse_confidence_score >= 40 THEN 'medium' ELSE 'low' END AS risk_level
  FROM te0
)"""

CANDIDATES = """,
candidates AS (
  SELECT ip, min(event_id) AS m FROM te GROUP BY ip
  UNION ALL
  SELECT concat('100.64.', CAST(CAST(floor(c_custkey / 250) AS INT) AS VARCHAR), '.', CAST(c_custkey % 250 AS VARCHAR)) AS ip,
    c_custkey AS m FROM customer
),
reputation AS (
  SELECT ip, CAST(m % 101 AS DOUBLE) AS abuse_confidence_score, m % 25 AS num_distinct_users, m % 60 AS total_reports,
    m % 11 = 0 AS is_tor, m % 13 AS asn_key,
    CASE WHEN m % 4 = 1 THEN concat('Kind ', CAST(m % 5 AS VARCHAR)) END AS first_category
  FROM candidates WHERE m % 3 <> 0
),
geo AS (
  SELECT ip, m % 4 = 0 AS is_hosting, m % 5 = 0 AS is_proxy_or_vpn, m % 7 = 0 AS is_mobile FROM candidates WHERE m % 2 = 0
),
geo_payloads AS (
  SELECT ip, CASE WHEN m % 5 = 0 THEN 'fail' ELSE 'success' END AS status, concat('City ', CAST(m % 9 AS VARCHAR)) AS city,
    concat('Region ', CAST(m % 4 AS VARCHAR)) AS region, concat(chr(CAST(65 + m % 26 AS INT)), 'Q') AS country_code,
    CASE WHEN m % 7 = 3 THEN NULL ELSE CAST(m % 90 AS DOUBLE) END AS lat, CAST(m % 180 AS DOUBLE) AS lon,
    m % 5 = 1 AS proxy, m % 4 = 0 AS hosting, m % 7 = 0 AS mobile, concat('AS', CAST(m % 13 AS VARCHAR)) AS asn
  FROM candidates WHERE m % 2 = 0
)"""

DIM_CATEGORY = """,
dim_category AS (
  SELECT concat('C', lpad(CAST(id AS VARCHAR), 2, '0')) AS category, concat('T', CAST(id % 7 AS VARCHAR)) AS tactic,
    concat('X', CAST(1000 + id AS VARCHAR)) AS technique_id, concat('Technique ', CAST(id AS VARCHAR)) AS technique_name
  FROM range(1, 24) r(id) WHERE id % 6 <> 0
)"""

DIM_COUNTRY = """,
dim_country AS (
  SELECT concat(chr(65 + n_nationkey), chr(65 + n_regionkey)) AS country_code,
    CAST(n_nationkey * 5 - 61 AS DOUBLE) AS latitude, CAST(n_nationkey * 13 - 150 AS DOUBLE) AS longitude,
    CASE WHEN n_nationkey % 5 <> 4 THEN n_name END AS name
  FROM nation
)"""

FEED_LIST = """,
feed_list AS (
  SELECT 'lists' AS source, te.source AS list_name,
    CASE te.source WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS priority,
    event_id AS pos, ip, event_id % 7 = 0 AS known
  FROM te
)"""

METRICS = """,
pipeline_metrics AS (
  SELECT CAST(floor(epoch_us(loaded_at) / 1000000 / 300) AS BIGINT) AS batch_id, count(*) AS batch_rows,
    CASE WHEN count(*) % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(5 AS DOUBLE) + count(*) * CAST(1.5 AS DOUBLE) END AS write_duration_ms,
    loaded_at AS recorded_at
  FROM te GROUP BY loaded_at
)"""

SNAPSHOTS = """,
briefing_snapshots AS (
  SELECT date_trunc('hour', loaded_at) AS recorded_at, CAST(count(*) % 10 AS DOUBLE) / 10 AS gini_coefficient,
    CAST(min(event_id) % 100 AS DOUBLE) AS top_country_pct, CAST(count(DISTINCT source) * 10 AS DOUBLE) AS cross_source_pct,
    CAST(count(category) AS DOUBLE) * 100 / count(*) AS categorized_pct
  FROM te GROUP BY date_trunc('hour', loaded_at)
)"""

MESSAGES = """,
messages AS (
  SELECT event_id, ip, country_code, abuse_confidence_score, last_reported_at, source, category,
    CAST(epoch_us(loaded_at) AS DOUBLE) / 1e6 - event_id % 300 + CAST(0.25 AS DOUBLE) AS ingested_at
  FROM te
)"""

BROKEN = """,
broken AS (
  SELECT event_id, substr(concat('{"ip":"', ip, '","country_code":"'), 1, 20) AS text FROM messages WHERE event_id % 500 = 7
)"""
LONG = """,
history AS (
  SELECT *, row_number() OVER (PARTITION BY ip ORDER BY loaded_at DESC, event_id DESC) AS rank FROM te
)"""

def over_events(body: str, *parts: str) -> str:
    """A complete statement: the event table, the given parts, then `body` (which may add CTEs by a leading comma)."""
    head = "WITH " + TE + "".join(parts)
    return f"{head}{body}" if body.lstrip().startswith(",") else f"{head}\n{body}"


def in_order(select: str, order: str) -> str:
    """A page with the places of its rows."""
    return f"SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS position FROM ({select}) page"
