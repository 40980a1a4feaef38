"""Aggregations, windows, rankings and reports."""

from pyspark.sql import functions as F

from ipvigil.catalog import fixtures as X
from ipvigil.catalog.joins import CLUSTERS, FIRST, OFFENDERS
from ipvigil.catalog.registry import listed, positioned, query
from ipvigil.catalog.scalars import BREAKS, RARITY
from ipvigil.catalog.sql import DIM_CATEGORY, LONG, METRICS, SNAPSHOTS, in_order, over_events
from ipvigil.operators import addresses as A
from ipvigil.operators import concentration, counts, quality, rankings
from ipvigil.plans.briefing import briefing, snapshot
from ipvigil.plans.health import pipeline_health
from ipvigil.plans.summary import summary

IP_STATS = """,
ip_stats AS (SELECT ip, count(*) AS reports, count(DISTINCT source) AS sources FROM te GROUP BY ip)"""

GINI = """,
sizes AS ({sizes}),
curve AS (
  SELECT n, row_number() OVER (ORDER BY n) AS position,
    sum(n) OVER (ORDER BY n, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM sizes
),
gini AS (
  SELECT CAST(1 AS DOUBLE) - CAST(sum(2 * (upto - n) + n) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS gini,
    count(*) AS groups FROM curve
)"""
BY_COUNTRY = GINI.replace("{sizes}", "SELECT coalesce(country_code, '~') AS k, count(*) AS n FROM te GROUP BY country_code")
CURVE = """SELECT 0 AS position, CAST(0 AS DOUBLE) AS pct_groups, CAST(0 AS DOUBLE) AS pct_events
UNION ALL
SELECT CAST(position AS BIGINT), CAST(position AS DOUBLE) * 100 / (SELECT count(*) FROM sizes),
  CAST(upto AS DOUBLE) * 100 / CAST((SELECT sum(n) FROM sizes) AS DOUBLE)
FROM (SELECT upto, row_number() OVER (ORDER BY upto) AS position FROM curve) c"""


@query("total", over_events("SELECT count(*) AS total FROM te"))
def _(spark, sf):
    return counts.total(X.threat_events(spark, sf))


@query("by_risk", over_events("SELECT risk_level, count(*) AS n FROM te GROUP BY risk_level"))
def _(spark, sf):
    return counts.count_by(X.threat_events(spark, sf), "risk_level")


@query("by_country", over_events("SELECT country_code, count(*) AS n FROM te GROUP BY country_code"))
def _(spark, sf):
    return counts.count_by(X.threat_events(spark, sf), "country_code")


@query("distinct_countries", over_events("SELECT count(DISTINCT country_code) AS countries FROM te"))
def _(spark, sf):
    return counts.distinct_values(X.threat_events(spark, sf), "country_code", "countries")


@query("last_loaded", over_events("SELECT max(loaded_at) AS last_loaded_at FROM te"))
def _(spark, sf):
    return counts.last_loaded(X.threat_events(spark, sf))


@query(
    "new_24h",
    over_events("SELECT count(*) AS total FROM te WHERE loaded_at >= (SELECT max(loaded_at) FROM te) - INTERVAL 24 HOUR"),
)
def _(spark, sf):
    return counts.total(counts.loaded_since(X.threat_events(spark, sf), "24 HOURS"))


@query("ip_stats", over_events("SELECT * FROM ip_stats", IP_STATS))
def _(spark, sf):
    return A.ip_stats(X.threat_events(spark, sf))


@query("repeat_count", over_events("SELECT count(*) AS repeat_ips FROM ip_stats WHERE reports > 1", IP_STATS))
def _(spark, sf):
    return A.offender_totals(X.threat_events(spark, sf)).select("repeat_ips")


@query("cross_source_count", over_events("SELECT count(*) AS cross_source_ips FROM ip_stats WHERE sources >= 2", IP_STATS))
def _(spark, sf):
    return A.offender_totals(X.threat_events(spark, sf)).select("cross_source_ips")


@query(
    "max_repeats",
    over_events("SELECT count(*) AS repeat_ips, max(reports) AS max_reports FROM ip_stats WHERE reports > 1", IP_STATS),
)
def _(spark, sf):
    return A.offender_totals(X.threat_events(spark, sf)).select("repeat_ips", "max_reports")


@query(
    "corroboration_share",
    over_events(
        """SELECT r AS repeat_ips, c AS cross_source_ips, CASE WHEN r > 0 THEN CAST(c AS DOUBLE) * 100 / CAST(r AS DOUBLE) END AS pct
        FROM (SELECT count(*) FILTER (WHERE reports > 1) AS r, count(*) FILTER (WHERE sources >= 2) AS c FROM ip_stats) t""",
        IP_STATS,
    ),
)
def _(spark, sf):
    return A.corroboration_share(X.threat_events(spark, sf))


@query("by_category", over_events("SELECT category, count(*) AS n FROM te WHERE category IS NOT NULL GROUP BY category"))
def _(spark, sf):
    return counts.count_by_category(X.threat_events(spark, sf))


@query("by_source", over_events("SELECT source, count(*) AS n FROM te GROUP BY source"))
def _(spark, sf):
    return counts.count_by(X.threat_events(spark, sf), "source")


SUMMARY = """
SELECT 'total' AS section, CAST(NULL AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS value FROM te
UNION ALL SELECT 'new_24h', NULL, CAST(count(*) AS DOUBLE) FROM te WHERE loaded_at >= (SELECT max(loaded_at) FROM te) - INTERVAL 24 HOUR
UNION ALL SELECT 'last_loaded_epoch', NULL, CAST(epoch_us(max(loaded_at)) // 1000000 AS DOUBLE) FROM te
UNION ALL SELECT 'repeat_offenders', NULL, CAST(count(*) AS DOUBLE) FROM ip_stats WHERE reports > 1
UNION ALL SELECT 'cross_source_corroborated', NULL, CAST(count(*) AS DOUBLE) FROM ip_stats WHERE sources >= 2
UNION ALL SELECT 'by_risk', risk_level, CAST(count(*) AS DOUBLE) FROM te GROUP BY risk_level
UNION ALL SELECT 'by_country', country_code, CAST(count(*) AS DOUBLE) FROM te GROUP BY country_code
UNION ALL SELECT 'distinct_countries', NULL, CAST(count(DISTINCT country_code) AS DOUBLE) FROM te
UNION ALL SELECT 'by_category', category, CAST(count(*) AS DOUBLE) FROM te WHERE category IS NOT NULL GROUP BY category
UNION ALL SELECT 'gini_coefficient', NULL, gini FROM gini"""


@query("summary", over_events(SUMMARY, IP_STATS, BY_COUNTRY))
def _(spark, sf):
    return summary(X.threat_events(spark, sf))


@query("gini", over_events("SELECT gini, groups FROM gini", BY_COUNTRY))
def _(spark, sf):
    return concentration.gini(counts.count_by(X.threat_events(spark, sf), "country_code"))


@query("lorenz", over_events(CURVE, BY_COUNTRY))
def _(spark, sf):
    return concentration.lorenz(counts.count_by(X.threat_events(spark, sf), "country_code"))


def _orders_per_customer(spark, sf):
    return X.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))


BY_CUSTOMER = "WITH " + GINI.replace("{sizes}", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey").lstrip().lstrip(",")


@query("gini_orders", BY_CUSTOMER + " SELECT gini, groups FROM gini")
def _(spark, sf):
    return concentration.gini(_orders_per_customer(spark, sf))


@query("lorenz_orders", BY_CUSTOMER + " " + CURVE)
def _(spark, sf):
    return concentration.lorenz(_orders_per_customer(spark, sf))


@query(
    "attack_patterns",
    over_events(
        """SELECT c.category, c.n, CAST(c.n AS DOUBLE) * 100 / w.cat AS pct_of_categorized, t.country_code AS top_country,
          t.n AS top_country_n, d.tactic, CAST(w.cat AS DOUBLE) * 100 / w.total AS pct_categorized_of_total
        FROM (SELECT category, count(*) AS n FROM te WHERE category IS NOT NULL GROUP BY category) c
        JOIN (SELECT count(*) AS total, count(category) AS cat FROM te) w ON true
        LEFT JOIN (SELECT category, country_code, n FROM (
            SELECT category, country_code, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, country_code) AS rn
            FROM te WHERE category IS NOT NULL AND country_code IS NOT NULL GROUP BY category, country_code) x WHERE rn = 1) t
          ON c.category = t.category
        LEFT JOIN dim_category d ON c.category = d.category""",
        DIM_CATEGORY,
    ),
)
def _(spark, sf):
    return counts.attack_patterns(X.threat_events(spark, sf), X.dim_category(spark))


@query(
    "top_country_per_category",
    over_events(
        """SELECT category, country_code, n FROM (
        SELECT category, country_code, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, country_code) AS rn
        FROM te WHERE category IS NOT NULL AND country_code IS NOT NULL GROUP BY category, country_code) x WHERE rn = 1"""
    ),
)
def _(spark, sf):
    return counts.top_country_per_category(X.threat_events(spark, sf))


OFFENDER_ORDER = "source_count DESC, report_count DESC, ip"


@query(
    "repeat_offenders",
    over_events(in_order("SELECT * FROM offenders ORDER BY source_count DESC, report_count DESC, ip LIMIT 20", OFFENDER_ORDER), OFFENDERS),
)
def _(spark, sf):
    return listed(positioned(A.repeat_offenders(X.threat_events(spark, sf))), "sources")


@query(
    "repeat_offenders_page",
    over_events(
        in_order("SELECT * FROM offenders ORDER BY source_count DESC, report_count DESC, ip LIMIT 50 OFFSET 100", OFFENDER_ORDER), OFFENDERS
    ),
)
def _(spark, sf):
    return listed(positioned(A.repeat_offenders(X.threat_events(spark, sf), page=3, page_size=50)), "sources")


@query(
    "repeat_offenders_after",
    over_events(
        in_order(
            """SELECT * FROM offenders WHERE source_count < 2 OR (source_count = 2 AND (report_count < 2 OR (report_count = 2 AND ip > '2')))
            ORDER BY source_count DESC, report_count DESC, ip LIMIT 50""",
            OFFENDER_ORDER,
        ),
        OFFENDERS,
    ),
)
def _(spark, sf):
    return listed(positioned(A.repeat_offenders(X.threat_events(spark, sf), page_size=50, after=(2, 2, "2"))), "sources")


@query(
    "infra_clusters",
    over_events(
        "SELECT subnet, ip_count, country_code, sources, max_score, array_to_string(sample_list, ',') AS sample_ips FROM clusters "
        "ORDER BY ip_count DESC, subnet LIMIT 15",
        CLUSTERS,
    ),
)
def _(spark, sf):
    return listed(A.infra_clusters(X.threat_events(spark, sf)), "sources", "sample_ips")


@query(
    "infra_clusters_all",
    over_events(
        "SELECT subnet, ip_count, country_code, sources, max_score, array_to_string(sample_list, ',') AS sample_ips FROM clusters",
        CLUSTERS,
    ),
)
def _(spark, sf):
    return listed(A.infra_clusters(X.threat_events(spark, sf), limit=None), "sources", "sample_ips")


@query(
    "minute_batches",
    over_events(
        "SELECT date_trunc('minute', loaded_at) AS loaded_minute, count(*) AS n FROM te GROUP BY 1 ORDER BY 1 DESC LIMIT 20"
    ),
)
def _(spark, sf):
    return quality.recent_minutes(X.threat_events(spark, sf))


@query("minute_batch_count", over_events("SELECT count(DISTINCT date_trunc('minute', loaded_at)) AS minutes FROM te"))
def _(spark, sf):
    return quality.minute_batch_count(X.threat_events(spark, sf))


@query(
    "pct_valid_geo",
    over_events(
        "SELECT CAST(count(*) FILTER (WHERE latitude <> 0 AND longitude <> 0) * 100 AS DOUBLE) / count(*) AS pct_valid_geo FROM te"
    ),
)
def _(spark, sf):
    return quality.pct_valid_geo(X.threat_events(spark, sf))


LATENCY = """,
latency AS (
  SELECT quantile_cont(CAST(epoch_us(loaded_at) - epoch_us(event_time) AS DOUBLE), 0.5) / 1e6 AS p50,
    quantile_cont(CAST(epoch_us(loaded_at) - epoch_us(event_time) AS DOUBLE), 0.95) / 1e6 AS p95, count(*) AS samples
  FROM te WHERE event_time IS NOT NULL
)"""


@query("latency_pcts", over_events("SELECT round(p50, 4) AS p50, round(p95, 4) AS p95, samples FROM latency", LATENCY))
def _(spark, sf):
    found = quality.latency_percentiles(X.threat_events(spark, sf))
    return found.select(F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "samples")


@query(
    "throughput",
    over_events(
        "SELECT count(*) / CAST(10 AS DOUBLE) AS per_minute FROM te WHERE loaded_at > (SELECT max(loaded_at) FROM te) - INTERVAL 10 MINUTE"
    ),
)
def _(spark, sf):
    return quality.throughput(X.threat_events(spark, sf))


COUNTERS = """,
counters AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE country_code IS NULL OR length(country_code) <> 2) AS bad_country,
    count(*) FILTER (WHERE abuse_confidence_score < 0 OR abuse_confidence_score > 100) AS bad_score,
    count(*) FILTER (WHERE risk_level NOT IN ('low', 'medium', 'high', 'critical')) AS bad_risk,
    count(*) FILTER (WHERE last_reported_at IS NOT NULL AND try_cast(last_reported_at AS TIMESTAMPTZ) IS NULL) AS bad_time,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT ip, source, last_reported_at FROM te) d) AS exact_duplicates
  FROM te
),
checks0 AS (
  SELECT 'country_code completeness' AS name, bad_country AS failed, total FROM counters
  UNION ALL SELECT 'score range', bad_score, total FROM counters
  UNION ALL SELECT 'risk level values', bad_risk, total FROM counters
  UNION ALL SELECT 'exact duplicates', exact_duplicates, total FROM counters
  UNION ALL SELECT 'last_reported_at format', bad_time, total FROM counters
),
checks AS (
  SELECT name, CASE WHEN failed = 0 THEN 'pass' WHEN round(CAST(failed AS DOUBLE) * 100 / total, 2) < 1 THEN 'warn' ELSE 'fail' END AS status,
    failed, total, round(CAST(failed AS DOUBLE) * 100 / total, 2) AS pct FROM checks0
)"""


@query("dq_counters", over_events("SELECT * FROM counters", COUNTERS))
def _(spark, sf):
    return quality.quality_counters(X.threat_events(spark, sf))


@query("dq_checks", over_events("SELECT * FROM checks", COUNTERS))
def _(spark, sf):
    return quality.quality_checks(X.threat_events(spark, sf))


@query(
    "dq_format",
    over_events(
        """SELECT 'last_reported_at format' AS name, 'fail' AS status, count(*) FILTER (WHERE event_id % 50 = 1) AS failed, count(*) AS total,
          round(count(*) FILTER (WHERE event_id % 50 = 1) * CAST(100 AS DOUBLE) / count(*), 2) AS pct FROM te"""
    ),
)
def _(spark, sf):
    """Share of report times that are no time; one in 50 is cut short here."""
    events = X.threat_events(spark, sf)
    cut = F.when(F.col("event_id") % 50 == 1, F.substring("last_reported_at", 1, 6)).otherwise(F.col("last_reported_at"))
    return quality.quality_checks(events.withColumn("last_reported_at", cut)).filter("name = 'last_reported_at format'")


@query("failing_checks", over_events("SELECT count(*) AS failing FROM checks WHERE status <> 'pass'", COUNTERS))
def _(spark, sf):
    return quality.failing_checks(X.threat_events(spark, sf))


HEALTH = """
SELECT 'recent_batch' AS section, CAST(epoch_us(m) // 1000000 AS VARCHAR) AS key, CAST(n AS DOUBLE) AS value FROM (
  SELECT date_trunc('minute', loaded_at) AS m, count(*) AS n FROM te GROUP BY 1 ORDER BY 1 DESC LIMIT 20) b
UNION ALL SELECT 'total_batches', NULL, CAST(count(DISTINCT date_trunc('minute', loaded_at)) AS DOUBLE) FROM te
UNION ALL SELECT 'pct_valid_geo', NULL, CAST(count(*) FILTER (WHERE latitude <> 0 AND longitude <> 0) * 100 AS DOUBLE) / count(*) FROM te
UNION ALL SELECT 'by_source', source, CAST(count(*) AS DOUBLE) FROM te GROUP BY source
UNION ALL SELECT 'latency_p50_seconds', NULL, round(p50, 1) FROM latency
UNION ALL SELECT 'latency_p95_seconds', NULL, round(p95, 1) FROM latency
UNION ALL SELECT 'latency_sample_size', NULL, CAST(samples AS DOUBLE) FROM latency
UNION ALL SELECT 'throughput_per_min', NULL, count(*) / CAST(10 AS DOUBLE) FROM te
  WHERE loaded_at > (SELECT max(loaded_at) FROM te) - INTERVAL 10 MINUTE
UNION ALL SELECT 'check_failed', name, CAST(failed AS DOUBLE) FROM checks
UNION ALL SELECT 'check_pct', name, CAST(pct AS DOUBLE) FROM checks
UNION ALL SELECT 'check_not_passed', name, CAST(CASE status WHEN 'pass' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END AS DOUBLE) FROM checks"""


@query("pipeline_health", over_events(HEALTH, LATENCY, COUNTERS))
def _(spark, sf):
    return pipeline_health(X.threat_events(spark, sf))


@query(
    "write_metrics",
    over_events(
        """SELECT batch_id, batch_rows, write_duration_ms, recorded_at,
          CASE WHEN write_duration_ms <> 0 THEN batch_rows / (write_duration_ms / 1000) END AS rows_per_sec
        FROM pipeline_metrics ORDER BY recorded_at DESC LIMIT 20""",
        METRICS,
    ),
)
def _(spark, sf):
    return quality.write_metrics(X.pipeline_metrics(X.threat_events(spark, sf)))


@query(
    "write_percentiles",
    over_events(
        """SELECT round(quantile_cont(write_duration_ms, 0.5), 4) AS p50_ms, round(quantile_cont(write_duration_ms, 0.95), 4) AS p95_ms,
          count(*) AS samples FROM pipeline_metrics""",
        METRICS,
    ),
)
def _(spark, sf):
    found = quality.write_percentiles(X.pipeline_metrics(X.threat_events(spark, sf)))
    return found.select(F.round("p50_ms", 4).alias("p50_ms"), F.round("p95_ms", 4).alias("p95_ms"), "samples")


@query(
    "score_coverage",
    over_events(
        "SELECT count(*) AS total, count(reoffense_probability) AS reoffense_scored, count(anomaly_score) AS anomaly_scored FROM te"
    ),
)
def _(spark, sf):
    return quality.score_coverage(X.threat_events(spark, sf))


TACTICS = """,
tactics AS (
  SELECT tactic, count(*) AS n, CAST(count(*) AS DOUBLE) * 100 / (SELECT count(category) FROM te) AS pct_of_categorized
  FROM te JOIN dim_category d ON te.category = d.category GROUP BY tactic
)"""


@query("tactic_rollup", over_events("SELECT * FROM tactics", DIM_CATEGORY, TACTICS))
def _(spark, sf):
    return counts.tactic_rollup(X.threat_events(spark, sf), X.dim_category(spark))


@query(
    "tactic_ips",
    over_events(
        """SELECT count(DISTINCT ip) AS ip_count, max(d.tactic) AS tactic FROM te JOIN dim_category d ON te.category = d.category
        WHERE d.tactic = (SELECT tactic FROM tactics ORDER BY n DESC, tactic LIMIT 1)""",
        DIM_CATEGORY,
        TACTICS,
    ),
)
def _(spark, sf):
    return counts.tactic_ips(X.threat_events(spark, sf), X.dim_category(spark))


TOP_K = """,
ranked AS (SELECT k, n, row_number() OVER (ORDER BY n DESC, k) AS rn, sum(n) OVER () AS whole FROM groups)
SELECT CAST(k AS VARCHAR) AS grp, n, CAST(rn AS INT) AS position, CAST(n AS DOUBLE) * 100 / CAST(whole AS DOUBLE) AS pct FROM ranked WHERE rn <= 5
UNION ALL
SELECT 'Other', CAST(sum(n) AS BIGINT), 6, CAST(sum(n) AS DOUBLE) * 100 / CAST(max(whole) AS DOUBLE) FROM ranked WHERE rn > 5"""


@query(
    "top_k_share",
    over_events(",\ngroups AS (SELECT country_code AS k, count(*) AS n FROM te GROUP BY country_code)" + TOP_K),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    return counts.top_k_share(events.groupBy("country_code").agg(F.count("*").alias("n")), "country_code")


@query(
    "top_k_share_orders",
    "WITH groups AS (SELECT CAST(o_custkey AS VARCHAR) AS k, count(*) AS n FROM orders GROUP BY o_custkey)" + TOP_K,
)
def _(spark, sf):
    return counts.top_k_share(_orders_per_customer(spark, sf), "o_custkey")


@query(
    "live_country_counts",
    over_events(
        "SELECT country_code, count(*) AS n FROM te WHERE country_code IS NOT NULL GROUP BY country_code "
        "ORDER BY n DESC, country_code LIMIT 15"
    ),
)
def _(spark, sf):
    return counts.top_countries(X.threat_events(spark, sf), 15)


@query(
    "top_countries",
    over_events(
        "SELECT country_code, count(*) AS n FROM te WHERE country_code IS NOT NULL GROUP BY country_code "
        "ORDER BY n DESC, country_code LIMIT 10"
    ),
)
def _(spark, sf):
    return counts.top_countries(X.threat_events(spark, sf), 10)


@query(
    "score_percentiles",
    over_events("SELECT CAST(row_number() OVER (ORDER BY b) - 1 AS INT) AS pct, b AS score FROM breaks", BREAKS),
)
def _(spark, sf):
    return rankings.score_percentiles(X.threat_events(spark, sf)).select(F.posexplode("breaks").alias("pct", "score"))


@query("first_sighting", over_events("SELECT * FROM firsts", FIRST))
def _(spark, sf):
    columns = ["ip", "loaded_at", "event_id", "source", "country_code", "abuse_confidence_score", "risk_level", "category"]
    return A.first_sighting(X.threat_events(spark, sf).select(*columns))


@query(
    "first_order",
    """SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, orders FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS orders
      FROM orders) t WHERE rn = 1""",
)
def _(spark, sf):
    orders = X.table(spark, sf, "orders").selectExpr(
        "o_custkey AS ip", "o_orderdate AS loaded_at", "o_orderkey AS event_id", "o_totalprice"
    )
    named = {"ip": "o_custkey", "loaded_at": "o_orderdate", "event_id": "o_orderkey", "report_count": "orders"}
    return A.first_sighting(orders).withColumnsRenamed(named)


@query(
    "ip_history",
    over_events("SELECT ip, event_id, loaded_at, source, risk_level, CAST(rank AS INT) AS rank FROM history WHERE rank <= 50", LONG),
)
def _(spark, sf):
    events = X.threat_events(spark, sf).select("ip", "event_id", "loaded_at", "source", "risk_level")
    return A.ip_history(events)


@query(
    "ip_history_one",
    over_events(
        "SELECT ip, event_id, loaded_at, source FROM te WHERE ip = (SELECT max(ip) FROM te) ORDER BY loaded_at DESC, event_id DESC LIMIT 50"
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf).select("ip", "event_id", "loaded_at", "source")
    return A.history_of(events, events.agg(F.max("ip").alias("ip")).scalar())


@query(
    "ip_local_evidence",
    over_events(
        "SELECT ip, count(*) AS seen, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM history WHERE rank <= 50 GROUP BY ip",
        LONG,
    ),
)
def _(spark, sf):
    return listed(A.local_evidence(X.threat_events(spark, sf)), "sources")


@query(
    "latest_score",
    over_events(
        """SELECT ip, reoffense_probability FROM (
          SELECT ip, reoffense_probability, row_number() OVER (PARTITION BY ip ORDER BY rank) AS rn FROM history
          WHERE rank <= 50 AND reoffense_probability IS NOT NULL AND event_id % 3 <> 0) t WHERE rn = 1""",
        LONG,
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    score = F.when(F.col("event_id") % 3 != 0, F.col("reoffense_probability"))
    return A.latest_score(events.withColumn("reoffense_probability", score))


@query(
    "latest_snapshot",
    over_events(
        """SELECT s.*, CAST(epoch_us((SELECT max(loaded_at) FROM te)) // 1000000 - epoch_us(recorded_at) // 1000000 AS DOUBLE) / 60 AS age_minutes
        FROM briefing_snapshots s ORDER BY recorded_at DESC LIMIT 1""",
        SNAPSHOTS,
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    return rankings.latest_snapshot(X.briefing_snapshots(events), counts.as_of(events))


@query(
    "snapshot_due",
    over_events(
        """SELECT max(recorded_at) AS last, max(recorded_at) IS NULL OR max(recorded_at) < (SELECT max(loaded_at) FROM te) - INTERVAL 1 HOUR AS due
        FROM briefing_snapshots""",
        SNAPSHOTS,
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    return rankings.snapshot_due(X.briefing_snapshots(events), counts.as_of(events))


@query(
    "trend_direction",
    over_events(
        """SELECT first_value, last_value, n, CASE WHEN n < 2 THEN NULL WHEN abs(last_value - first_value) < 0.5 THEN 'stable'
          WHEN last_value > first_value THEN 'rising' ELSE 'falling' END AS direction
        FROM (SELECT arg_min(categorized_pct, recorded_at) AS first_value, arg_max(categorized_pct, recorded_at) AS last_value, count(*) AS n
              FROM briefing_snapshots) t""",
        SNAPSHOTS,
    ),
)
def _(spark, sf):
    return rankings.trend_direction(X.briefing_snapshots(X.threat_events(spark, sf)), "categorized_pct")


PAGE = """SELECT event_id, ip, country_code, risk_level, abuse_confidence_score, last_reported_at, loaded_at,
  (SELECT count(*) FROM te{where}) AS total FROM te{where} ORDER BY {column} DESC NULLS FIRST, event_id LIMIT {size} OFFSET {skip}"""


PAGE_ORDER = "{} DESC NULLS FIRST, event_id"


@query(
    "history_page",
    over_events(in_order(PAGE.format(where="", column="loaded_at", size=25, skip=50), PAGE_ORDER.format("loaded_at"))),
)
def _(spark, sf):
    return positioned(rankings.history_page(X.threat_events(spark, sf), page=3))


@query(
    "history_page_by_score",
    over_events(
        in_order(
            PAGE.format(where=" WHERE country_code = 'BB'", column="abuse_confidence_score", size=100, skip=0),
            PAGE_ORDER.format("abuse_confidence_score"),
        )
    ),
)
def _(spark, sf):
    return positioned(rankings.history_page(X.threat_events(spark, sf), page_size=500, country="bb", sort="score"))


@query(
    "history_after",
    over_events(
        in_order(
            """SELECT event_id, ip, country_code, risk_level, abuse_confidence_score, last_reported_at, loaded_at, (SELECT count(*) FROM te) AS total
            FROM te WHERE abuse_confidence_score < 90 OR (abuse_confidence_score = 90 AND event_id > 5)
            ORDER BY abuse_confidence_score DESC, event_id LIMIT 25""",
            PAGE_ORDER.format("abuse_confidence_score"),
        )
    ),
)
def _(spark, sf):
    return positioned(rankings.history_page(X.threat_events(spark, sf), sort="score", after=(90.0, 5)))


@query(
    "anomalies",
    over_events(
        """,
    recent AS (SELECT * FROM te ORDER BY loaded_at DESC, event_id DESC LIMIT 2000),
    picked AS (SELECT * FROM recent WHERE anomaly_score IS NOT NULL ORDER BY anomaly_score, loaded_at DESC, event_id LIMIT 8)
    SELECT p.event_id, ip, source, country_code, category, risk_level, abuse_confidence_score, anomaly_score,
      CAST(greatest(0, least(100, 100 - (SELECT count(*) FROM breaks WHERE b <= p.anomaly_score))) AS INT) AS unusual_pct, loaded_at, why,
      row_number() OVER (ORDER BY anomaly_score, loaded_at DESC, p.event_id) - 1 AS position
    FROM picked p LEFT JOIN explained x ON p.event_id = x.event_id""",
        BREAKS,
        RARITY,
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    return positioned(rankings.anomalies(events, rankings.score_percentiles(events).scalar()))


@query(
    "trends",
    over_events(
        in_order(
            "SELECT recorded_at, gini_coefficient, cross_source_pct, categorized_pct FROM briefing_snapshots ORDER BY recorded_at DESC LIMIT 200",
            "recorded_at",
        ),
        SNAPSHOTS,
    ),
)
def _(spark, sf):
    return positioned(rankings.trends(X.briefing_snapshots(X.threat_events(spark, sf))))


@query(
    "trends_oldest",
    over_events(
        in_order(
            "SELECT recorded_at, gini_coefficient, cross_source_pct, categorized_pct FROM briefing_snapshots ORDER BY recorded_at LIMIT 200",
            "recorded_at",
        ),
        SNAPSHOTS,
    ),
)
def _(spark, sf):
    return positioned(rankings.trends(X.briefing_snapshots(X.threat_events(spark, sf)), keep="oldest"))


BRIEFING = """,
figures AS (
  SELECT count(*) AS total, count(category) AS categorised, count(DISTINCT coalesce(source, '~')) AS n_sources, max(source) AS only_source,
    (SELECT gini FROM gini) AS g, (SELECT count(*) FROM ip_stats WHERE sources >= 2) AS cross_ips,
    (SELECT count(*) FROM ip_stats WHERE reports > 1) AS repeat_ips, (SELECT max(reports) FROM ip_stats WHERE reports > 1) AS max_reports
  FROM te
),
top5 AS (SELECT country_code, count(*) AS n FROM te GROUP BY country_code ORDER BY n DESC, country_code NULLS FIRST LIMIT 5),
top5_line AS (SELECT string_agg(coalesce(country_code, 'unknown'), ', ' ORDER BY n DESC, country_code NULLS FIRST) AS names, sum(n) AS n, max(n) AS first_n FROM top5),
prev AS (SELECT * FROM briefing_snapshots ORDER BY recorded_at DESC LIMIT 1),
lead AS (SELECT tactic, n, pct_of_categorized FROM tactics ORDER BY n DESC, tactic LIMIT 1),
lead_ips AS (SELECT count(DISTINCT ip) AS n FROM te JOIN dim_category d ON te.category = d.category WHERE d.tactic = (SELECT tactic FROM lead)),
deltas AS (
  SELECT round(round(g, 3) - prev.gini_coefficient, 2) AS gd,
    round(round(CAST(cross_ips AS DOUBLE) * 100 / total, 1) - prev.cross_source_pct, 2) AS cd FROM figures, prev
),
findings AS (
  SELECT 1 AS position, 'geography' AS kind, 'high' AS priority, names AS subject, CAST(NULL AS BIGINT) AS amount,
    CAST(top5_line.n AS DOUBLE) * 100 / total AS pct, CASE WHEN abs(gd) >= 0.05 THEN gd END AS delta FROM top5_line, figures, deltas
  UNION ALL
  SELECT 2, 'cross_source', 'high', NULL, cross_ips, CAST(cross_ips AS DOUBLE) * 100 / total, CASE WHEN abs(cd) >= 0.05 THEN cd END
  FROM figures, deltas WHERE cross_ips > 0
  UNION ALL
  SELECT 2, 'repeat_ips', 'medium', NULL, repeat_ips, CAST(repeat_ips AS DOUBLE) * 100 / total, NULL FROM figures WHERE cross_ips = 0
  UNION ALL
  SELECT 3, 'single_source', 'medium', only_source, n_sources, 100, NULL FROM figures WHERE n_sources <= 1
  UNION ALL
  SELECT 4, 'top_tactic', 'medium', lead.tactic, lead_ips.n, lead.pct_of_categorized, NULL FROM lead, lead_ips
  UNION ALL
  SELECT 5, 'limit_repeats', NULL, NULL, max_reports, CAST(repeat_ips AS DOUBLE) * 100 / total, NULL FROM figures WHERE max_reports <= 3
  UNION ALL
  SELECT 6, 'limit_categories', NULL, NULL, categorised, CAST(categorised AS DOUBLE) * 100 / total, NULL FROM figures
  UNION ALL SELECT 7, 'limit_latency', NULL, NULL, NULL, NULL, NULL
  UNION ALL SELECT 8, 'limit_lookups', NULL, NULL, NULL, NULL, NULL
)"""
BRIEFING_PARTS = (DIM_CATEGORY, SNAPSHOTS, IP_STATS, BY_COUNTRY, TACTICS, BRIEFING)


def _findings(spark, sf):
    events = X.threat_events(spark, sf)
    return briefing(events, X.briefing_snapshots(events), X.dim_category(spark), X.dim_tactic(spark))


@query("briefing", over_events("SELECT position, kind, priority, subject, amount, pct, delta FROM findings", *BRIEFING_PARTS))
def _(spark, sf):
    return _findings(spark, sf).drop("text")


@query(
    "rank_findings",
    over_events(
        """SELECT CAST(row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 9 END, position) AS INT)
          AS place, kind, priority FROM findings WHERE priority IS NOT NULL""",
        *BRIEFING_PARTS,
    ),
)
def _(spark, sf):
    ranked = rankings.rank_findings(_findings(spark, sf).filter("priority IS NOT NULL")).select("kind", "priority")
    return ranked.agg(F.collect_list(F.struct("*")).alias("r")).select(F.posexplode("r").alias("p", "f")).select(
        (F.col("p") + 1).alias("place"), "f.*"
    )


@query(
    "posture",
    over_events(
        """SELECT urgent, findings, CASE WHEN round(CAST(urgent AS DOUBLE) * 100 / findings) >= 50 THEN 'red'
          WHEN round(CAST(urgent AS DOUBLE) * 100 / findings) >= 25 THEN 'amber' ELSE 'green' END AS tone
        FROM (SELECT count(*) FILTER (WHERE priority = 'high') AS urgent, count(*) AS findings FROM findings WHERE priority IS NOT NULL) t""",
        *BRIEFING_PARTS,
    ),
)
def _(spark, sf):
    return rankings.posture(_findings(spark, sf).filter("priority IS NOT NULL"))


@query(
    "snapshot",
    over_events(
        """SELECT (SELECT max(loaded_at) FROM te) AS recorded_at, round(g, 3) AS gini_coefficient,
          round(CAST(first_n AS DOUBLE) * 100 / total, 1) AS top_country_pct, round(CAST(cross_ips AS DOUBLE) * 100 / total, 1) AS cross_source_pct,
          round(CAST(categorised AS DOUBLE) * 100 / total, 1) AS categorized_pct FROM figures, top5_line""",
        *BRIEFING_PARTS,
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    day_old = F.col("recorded_at") < counts.as_of(events) - F.expr("INTERVAL 1 DAY")
    return snapshot(events, X.briefing_snapshots(events).filter(day_old))
