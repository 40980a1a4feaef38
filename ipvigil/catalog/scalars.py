"""Projections, predicates and scalar functions."""

from pyspark.sql import functions as F

from ipvigil.catalog import fixtures as X
from ipvigil.catalog.registry import listed, query
from ipvigil.catalog.sql import (
    CANDIDATES,
    DIM_CATEGORY,
    DIM_COUNTRY,
    MESSAGES,
    METRICS,
    over_events,
)
from ipvigil.functions import columns as C
from ipvigil.operators import counts, enrich, rankings
from ipvigil.operators.decisions import origin_verdict


@query("risk_level", over_events("SELECT event_id, abuse_confidence_score, risk_level FROM te"))
def _(spark, sf):
    events = X.threat_events(spark, sf)
    return events.select("event_id", "abuse_confidence_score", C.risk_level("abuse_confidence_score").alias("risk_level"))


@query(
    "centroid",
    over_events(
        """SELECT event_id, te.country_code, coalesce(d.latitude, 0) AS latitude, coalesce(d.longitude, 0) AS longitude
        FROM te LEFT JOIN dim_country d ON te.country_code = d.country_code""",
        DIM_COUNTRY,
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf).select("event_id", "country_code")
    return enrich.with_centroid(events, X.dim_country(spark, sf))


@query(
    "event_time",
    over_events(
        "SELECT event_id, make_timestamp(CAST(floor(ingested_at) AS BIGINT) * 1000000) AS event_time FROM messages", MESSAGES
    ),
)
def _(spark, sf):
    rows = X.message_rows(X.threat_events(spark, sf))
    return rows.select("event_id", C.event_time("ingested_at").alias("event_time"))


@query(
    "categories",
    over_events(
        "SELECT event_id, CAST(CASE WHEN category IS NULL OR category = '' THEN 0 ELSE 1 END AS INT) AS n_categories, "
        "coalesce(category, '') AS categories FROM te"
    ),
)
def _(spark, sf):
    rows = X.threat_events(spark, sf).select("event_id", C.categories("category").alias("categories"))
    return listed(rows.withColumn("n_categories", F.size("categories")), "categories")


@query(
    "subnet24",
    over_events(
        "SELECT event_id, concat(split_part(ip, '.', 1), '.', split_part(ip, '.', 2), '.', split_part(ip, '.', 3), '.0/24') "
        "AS subnet FROM te"
    ),
)
def _(spark, sf):
    return X.threat_events(spark, sf).select("event_id", C.subnet24("ip").alias("subnet"))


@query(
    "is_ipv4",
    over_events(
        r"""SELECT event_id, txt, regexp_full_match(txt, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS is_ipv4 FROM (
        SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat(ip, ':80') WHEN 1 THEN concat('fe80::', CAST(event_id AS VARCHAR))
        WHEN 2 THEN concat(ip, '999') ELSE ip END AS txt FROM te) t"""
    ),
)
def _(spark, sf):
    rows = X.threat_events(spark, sf).selectExpr(
        "event_id",
        "CASE event_id % 4 WHEN 0 THEN concat(ip, ':80') WHEN 1 THEN concat('fe80::', CAST(event_id AS STRING)) "
        "WHEN 2 THEN concat(ip, '999') ELSE ip END AS txt",
    )
    return rows.withColumn("is_ipv4", C.is_ipv4("txt"))


@query(
    "filter_history",
    over_events(
        "SELECT event_id, ip, country_code, risk_level FROM te WHERE country_code = 'AA' AND risk_level = 'critical'"
    ),
)
def _(spark, sf):
    found = rankings.filter_history(X.threat_events(spark, sf), country="aaz", risk="critical")
    return found.select("event_id", "ip", "country_code", "risk_level")


@query(
    "filter_recent",
    over_events(
        """SELECT 'day' AS span, event_id FROM te WHERE loaded_at >= (SELECT max(loaded_at) FROM te) - INTERVAL 24 HOUR
        UNION ALL
        SELECT 'ten minutes' AS span, event_id FROM te WHERE loaded_at > (SELECT max(loaded_at) FROM te) - INTERVAL 10 MINUTE"""
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    day = counts.loaded_since(events, "24 HOURS").select(F.lit("day").alias("span"), "event_id")
    ten = counts.loaded_since(events, "10 MINUTES", inclusive=False).select(F.lit("ten minutes").alias("span"), "event_id")
    return day.unionByName(ten)


@query("filter_in", over_events("SELECT event_id, category FROM te WHERE category IN ('C01', 'C05', 'C23')"))
def _(spark, sf):
    events = X.threat_events(spark, sf).select("event_id", "category")
    wanted = spark.createDataFrame([("C01",), ("C05",), ("C23",), ("C05",), (None,)], "code string")
    return enrich.within(events, wanted, "category").select("event_id", "category")


@query("filter_live", over_events("SELECT event_id, ip FROM te WHERE country_code = 'BB' AND category = 'C07'"))
def _(spark, sf):
    events = X.threat_events(spark, sf).withColumn("categories", C.categories("category"))
    return enrich.matching_live(events, "BB", "C07").select("event_id", "ip")


@query("seen_categories", over_events("SELECT DISTINCT category FROM te WHERE category IS NOT NULL"))
def _(spark, sf):
    return enrich.seen_categories(X.threat_events(spark, sf).select(C.categories("category").alias("categories")))


TOP_15 = """,
top AS (SELECT country_code FROM te WHERE country_code IS NOT NULL GROUP BY country_code ORDER BY count(*) DESC, country_code LIMIT 15)"""


@query(
    "country_bucket",
    over_events(
        "SELECT event_id, CASE WHEN country_code IN (SELECT country_code FROM top) THEN country_code ELSE 'OTHER' END "
        "AS country_bucket FROM te",
        TOP_15,
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    return events.select("event_id", C.country_bucket("country_code", counts.top_country_codes(events)).alias("country_bucket"))


@query(
    "fill_defaults",
    over_events(
        "SELECT event_id, coalesce(category, 'UNKNOWN') AS category, coalesce(abuse_confidence_score, 0) AS "
        "abuse_confidence_score FROM te"
    ),
)
def _(spark, sf):
    return C.fill_feature_defaults(X.threat_events(spark, sf).select("event_id", "category", "abuse_confidence_score"))


NAMED_CATEGORIES = """,
ids AS (
  SELECT event_id, i * 2 AS pos, (event_id * i) % 25 + 1 AS id FROM te, range(1, 11) r(i) WHERE event_id % 19 <> 0
  UNION ALL
  SELECT event_id, i * 2 + 1 AS pos, (event_id + i) % 25 + 1 AS id FROM te, range(1, 11) r(i) WHERE event_id % 19 <> 0
),
named AS (
  SELECT event_id, concat('C', lpad(CAST(id AS VARCHAR), 2, '0')) AS name, min(pos) AS pos FROM ids WHERE id <= 23 GROUP BY 1, 2
)"""


@query(
    "category_names",
    over_events("SELECT event_id, string_agg(name, ',' ORDER BY pos) AS recent_categories FROM named GROUP BY event_id", NAMED_CATEGORIES),
)
def _(spark, sf):
    payloads = X.reputation_payloads(X.threat_events(spark, sf)).filter(F.col("data").isNotNull())
    names = C.category_names("data.reports", X.CATEGORY_NAMES)
    return listed(payloads.select("event_id", names.alias("recent_categories")), "recent_categories")


@query(
    "mitre_join",
    over_events(
        "SELECT event_id, te.category, tactic, technique_id, technique_name FROM te JOIN dim_category d ON te.category = d.category",
        DIM_CATEGORY,
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf).select("event_id", "category")
    return enrich.with_tactic(events, X.dim_category(spark), keep_unmapped=False)


@query(
    "country_name",
    over_events(
        "SELECT event_id, coalesce(d.name, te.country_code, 'Unknown') AS country_name FROM te LEFT JOIN dim_country d "
        "ON te.country_code = d.country_code",
        DIM_COUNTRY,
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf).select("event_id", "country_code")
    return enrich.with_country_name(events, X.dim_country(spark, sf)).select("event_id", "country_name")


@query(
    "reputation_project",
    over_events(
        """SELECT ip, country_code, 'Land ' || country_code AS country_name, concat('ISP ', source) AS isp,
          concat(source, '.example') AS domain,
          CASE WHEN event_id % 2 = 0 THEN concat('h', CAST(event_id AS VARCHAR), ',alias') ELSE '' END AS hostnames,
          'Data Center' AS usage_type, abuse_confidence_score, event_id % 60 AS total_reports,
          event_id % 25 AS num_distinct_users, event_id % 29 = 0 AS is_whitelisted, true AS is_public, event_id % 11 = 0 AS is_tor
        FROM te WHERE event_id % 19 <> 0"""
    ),
)
def _(spark, sf):
    flat = enrich.project_reputation(X.reputation_payloads(X.threat_events(spark, sf)), X.CATEGORY_NAMES)
    return listed(flat.drop("recent_categories"), "hostnames")


@query(
    "geo_project",
    over_events(
        "SELECT ip, city, region, lat, lon, proxy AS is_proxy_or_vpn, hosting AS is_hosting, mobile AS is_mobile, asn, "
        "'UTC' AS timezone FROM geo_payloads WHERE status = 'success'",
        CANDIDATES,
    ),
)
def _(spark, sf):
    return enrich.project_geo(X.geo_payloads(X.candidates(spark, sf, X.threat_events(spark, sf))))


@query(
    "cidr_report_project",
    over_events(
        """SELECT concat(split_part(ip, '.', 1), '.', split_part(ip, '.', 2), '.', split_part(ip, '.', 3)) AS network_address,
          '255.255.255.0' AS netmask, ip, abuse_confidence_score, event_id % 60 AS total_reports, last_reported_at
        FROM te WHERE event_id % 5 > 1
        UNION ALL
        SELECT concat(split_part(ip, '.', 1), '.', split_part(ip, '.', 2), '.', split_part(ip, '.', 3)) AS network_address,
          '255.255.255.0' AS netmask, concat('9.9.9.', CAST(event_id % 200 AS VARCHAR)) AS ip,
          CAST(NULL AS DOUBLE) AS abuse_confidence_score, CAST(NULL AS BIGINT) AS total_reports,
          CAST(NULL AS VARCHAR) AS last_reported_at
        FROM te WHERE event_id % 5 > 1"""
    ),
)
def _(spark, sf):
    return enrich.project_cidr_reports(X.cidr_payloads(X.threat_events(spark, sf)))


AS_NAMES = [
    "AMAZON-02", "Google LLC", "MICROSOFT-CORP", "OVH SAS", "DIGITALOCEAN-ASN", "Hetzner Online", "Alibaba US",
    "ORACLE-BMC", "Akamai Linode", "CLOUDFLARENET", "The Constant Company Vultr", "TENCENT-NET", "Novhost Ltd", "",
]


@query(
    "cloud_provider",
    over_events(
        f"""SELECT event_id, CASE
          WHEN regexp_matches(asn, 'amazon|aws', 'i') THEN 'AWS' WHEN regexp_matches(asn, 'google', 'i') THEN 'Google Cloud'
          WHEN regexp_matches(asn, 'microsoft|azure', 'i') THEN 'Microsoft Azure'
          WHEN regexp_matches(asn, '\\bovh\\b', 'i') THEN 'OVH'
          WHEN regexp_matches(asn, 'digitalocean', 'i') THEN 'DigitalOcean' WHEN regexp_matches(asn, 'hetzner', 'i') THEN 'Hetzner'
          WHEN regexp_matches(asn, 'alibaba', 'i') THEN 'Alibaba Cloud' WHEN regexp_matches(asn, '\\boracle\\b', 'i') THEN 'Oracle Cloud'
          WHEN regexp_matches(asn, 'linode|akamai', 'i') THEN 'Linode/Akamai' WHEN regexp_matches(asn, 'cloudflare', 'i') THEN 'Cloudflare'
          WHEN regexp_matches(asn, 'vultr', 'i') THEN 'Vultr' WHEN regexp_matches(asn, 'tencent', 'i') THEN 'Tencent Cloud' END AS provider
        FROM (SELECT event_id, ({AS_NAMES})[1 + event_id % {len(AS_NAMES)}] AS asn FROM te) t"""
    ),
)
def _(spark, sf):
    names = F.array(*[F.lit(n) for n in AS_NAMES])
    asn = F.element_at(names, (F.col("event_id") % len(AS_NAMES) + 1).cast("int"))
    return X.threat_events(spark, sf).select("event_id", C.cloud_provider(asn).alias("provider"))


@query(
    "origin_verdict",
    over_events(
        """SELECT r.ip, CASE WHEN is_tor THEN 'tor' WHEN is_proxy_or_vpn THEN 'proxy' WHEN is_hosting THEN 'hosting'
          WHEN is_mobile THEN 'mobile' ELSE 'residential' END AS origin, lower(first_category) AS last_activity
        FROM reputation r LEFT JOIN geo g ON r.ip = g.ip""",
        CANDIDATES,
    ),
)
def _(spark, sf):
    rows = X.candidates(spark, sf, X.threat_events(spark, sf))
    return origin_verdict(X.reputation(rows), X.geo(rows))


@query(
    "risk_factors",
    over_events(
        """SELECT event_id, CASE WHEN n = 3 THEN concat(a, '|', b) ELSE concat_ws('|', a, b, c) END AS factors FROM (
          SELECT event_id, a, b, c, CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT) AS n FROM (
            SELECT event_id,
              CASE WHEN source = 'view' AND coalesce(category, '') = '' THEN 'bulk feed without category' END AS a,
              CASE WHEN abuse_confidence_score >= 90 THEN 'top score' END AS b,
              CASE WHEN risk_level IN ('critical', 'high') THEN 'risk ' || risk_level END AS c
            FROM te) f) g"""
    ),
)
def _(spark, sf):
    factors = C.risk_factors("source", "category", "abuse_confidence_score", "risk_level", bulk_source="view")
    return listed(X.threat_events(spark, sf).select("event_id", factors.alias("factors")), "factors", separator="|")


SHARES = ", ".join(f"{i / 100:.2f}" for i in range(101))
BREAKS = f""",
breaks AS (
  SELECT round(unnest(quantile_cont(anomaly_score, [{SHARES}])), 6) AS b FROM te
)"""


@query(
    "unusual_pct",
    over_events(
        """SELECT event_id, CASE WHEN s.anomaly_score IS NOT NULL THEN CAST(greatest(0, least(100, 100 - u.n)) AS INT) END AS unusual_pct
        FROM te s LEFT JOIN (
          SELECT v.anomaly_score, count(b) AS n FROM (SELECT DISTINCT anomaly_score FROM te WHERE anomaly_score IS NOT NULL) v
          LEFT JOIN breaks ON b <= v.anomaly_score GROUP BY v.anomaly_score) u ON s.anomaly_score = u.anomaly_score""",
        BREAKS,
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    breaks = rankings.score_percentiles(events).scalar()
    marked = events.select("event_id", "anomaly_score").withColumn("breaks", breaks)
    return marked.select("event_id", C.unusual_pct("anomaly_score", F.col("breaks")).alias("unusual_pct"))


RARITY = """,
counted AS (
  SELECT 'source' AS label, source AS value, count(*) AS cnt FROM te GROUP BY source
  UNION ALL SELECT 'country', country_code, count(*) FROM te GROUP BY country_code
  UNION ALL SELECT 'category', category, count(*) FROM te GROUP BY category
),
options AS (
  SELECT event_id, cnt, 0 AS ord, 'source' AS label, source AS value FROM te JOIN counted c ON c.label = 'source' AND c.value = te.source
  UNION ALL
  SELECT event_id, cnt, 1, 'country', country_code FROM te JOIN counted c ON c.label = 'country' AND c.value = te.country_code
  UNION ALL
  SELECT event_id, cnt, 2, 'category', coalesce(category, 'uncategorized') FROM te
    JOIN counted c ON c.label = 'category' AND c.value IS NOT DISTINCT FROM te.category
),
rarest AS (
  SELECT event_id, label, value, cnt, (SELECT count(*) FROM te) AS total FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY cnt, ord) AS rn FROM options) o WHERE rn = 1
),
explained AS (
  SELECT event_id, label AS rare_label, value AS rare_value, cnt AS rare_count,
    concat(label, ' ', value, ' in ', CASE WHEN cnt * 1000 < total THEN '<0.1'
      ELSE concat(CAST(((cnt * 2000 + total) // (total * 2)) // 10 AS VARCHAR), '.', CAST(((cnt * 2000 + total) // (total * 2)) % 10 AS VARCHAR)) END,
      '% of events') AS why
  FROM rarest WHERE cnt * 20 < total
)"""


@query(
    "rarest_reason",
    over_events(
        "SELECT te.event_id, rare_label, rare_value, rare_count, why FROM te LEFT JOIN explained x ON te.event_id = x.event_id",
        RARITY,
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    rows = events.select("event_id", "source", "country_code", "category")
    return rankings.rarity(rows, events).select("event_id", "rare_label", "rare_value", "rare_count", "why")


@query(
    "trend_delta",
    over_events(
        """SELECT event_id, CASE WHEN abs(d) >= 0.05 THEN d END AS delta FROM (
          SELECT event_id, round(abuse_confidence_score - reoffense_probability * 100, 2) AS d FROM te) t"""
    ),
)
def _(spark, sf):
    delta = C.trend_delta(F.col("abuse_confidence_score"), F.col("reoffense_probability") * 100)
    return X.threat_events(spark, sf).select("event_id", delta.alias("delta"))


@query(
    "dq_status",
    over_events(
        """SELECT source, failed, total, CASE WHEN failed = 0 THEN 'pass' WHEN round(CAST(failed AS DOUBLE) * 100 / total, 2) < 1
          THEN 'warn' ELSE 'fail' END AS status
        FROM (SELECT source, count(*) FILTER (WHERE abuse_confidence_score > 100) AS failed, count(*) AS total FROM te GROUP BY source) t"""
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    counted = events.groupBy("source").agg(
        F.count_if(F.col("abuse_confidence_score") > 100).alias("failed"), F.count("*").alias("total")
    )
    return counted.withColumn("status", C.check_status("failed", "total"))


@query(
    "safe_ratio",
    over_events(
        "SELECT batch_id, CASE WHEN write_duration_ms <> 0 THEN batch_rows / (write_duration_ms / 1000) END AS rows_per_sec "
        "FROM pipeline_metrics",
        METRICS,
    ),
)
def _(spark, sf):
    rows = X.pipeline_metrics(X.threat_events(spark, sf))
    return rows.select("batch_id", C.safe_rate("batch_rows", F.col("write_duration_ms") / 1000.0).alias("rows_per_sec"))
