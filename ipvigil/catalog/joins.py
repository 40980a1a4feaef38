"""Joins, feed selection and exports."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ipvigil.catalog import fixtures as X
from ipvigil.catalog.registry import listed, query
from ipvigil.catalog.scalars import NAMED_CATEGORIES
from ipvigil.catalog.sql import BROKEN, CANDIDATES, DIM_CATEGORY, DIM_COUNTRY, FEED_LIST, LONG, MESSAGES, over_events
from ipvigil.operators import addresses as A
from ipvigil.operators import decisions, enrich
from ipvigil.schema import DIM_CATEGORY as DIM_CATEGORY_COLUMNS
from ipvigil.session import shared_folder
from ipvigil.sources import exports, feeds, messages, tables


@query(
    "parse_message",
    over_events(
        """SELECT event_id, ip, country_code, abuse_confidence_score, last_reported_at, source, ingested_at, category,
          CAST(NULL AS VARCHAR) AS malformed FROM messages WHERE event_id % 500 <> 7
        UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, text FROM broken""",
        MESSAGES,
        BROKEN,
    ),
)
def _(spark, sf):
    return messages.parse_message(X.message_text(X.threat_events(spark, sf)), keep=["event_id"])


@query(
    "parse_malformed",
    over_events(
        """SELECT event_id, CASE WHEN event_id % 500 <> 7 THEN ip END AS ip,
          CASE WHEN event_id % 500 <> 7 THEN source END AS source FROM messages""",
        MESSAGES,
    ),
)
def _(spark, sf):
    text = X.message_text(X.threat_events(spark, sf))
    return messages.parse_message(text, on_malformed="keep", keep=["event_id"]).select("event_id", "ip", "source")


@query(
    "feed_json",
    over_events(
        """SELECT ip, country_code, abuse_confidence_score, last_reported_at, 'bulk' AS source, CAST(event_id AS DOUBLE) AS ingested_at,
          CAST(NULL AS VARCHAR) AS category FROM te WHERE abuse_confidence_score >= 25
        UNION ALL
        SELECT concat('9.9.8.', CAST(event_id % 200 AS VARCHAR)), NULL, CAST(event_id % 100 AS DOUBLE), NULL, 'bulk',
          CAST(event_id AS DOUBLE), NULL FROM te WHERE event_id % 100 >= 25"""
    ),
)
def _(spark, sf):
    return feeds.bulk_entries(X.bulk_payloads(X.threat_events(spark, sf)), source="bulk")


@query("feed_text", over_events("SELECT event_id AS pos, ip FROM te WHERE event_id % 10 NOT IN (0, 1, 3)"))
def _(spark, sf):
    return feeds.list_entries(X.list_lines(X.threat_events(spark, sf)))


@query(
    "feed_tag",
    over_events(
        "SELECT pos, ip, list_name, concat('Kind ', list_name) AS category, CAST(70 + 5 * priority AS DOUBLE) AS "
        "abuse_confidence_score FROM feed_list",
        FEED_LIST,
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    entries = X.feed_list(events).select("source", "list_name", "pos", "ip")
    return feeds.tag(entries, X.dim_feed(events)).drop("source")


@query(
    "feed_union",
    over_events(
        """SELECT ip, country_code, abuse_confidence_score, last_reported_at, 'bulk' AS source, CAST(event_id AS DOUBLE) AS ingested_at,
          CAST(NULL AS VARCHAR) AS category FROM te WHERE abuse_confidence_score >= 25
        UNION ALL
        SELECT concat('9.9.8.', CAST(event_id % 200 AS VARCHAR)), NULL, CAST(event_id % 100 AS DOUBLE), NULL, 'bulk',
          CAST(event_id AS DOUBLE), NULL FROM te WHERE event_id % 100 >= 25
        UNION ALL
        SELECT ip, NULL, CAST(70 + 5 * priority AS DOUBLE), NULL, 'lists', NULL, concat('Kind ', list_name) FROM feed_list""",
        FEED_LIST,
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    bulk = feeds.bulk_entries(X.bulk_payloads(events), source="bulk")
    entries = X.feed_list(events).select("source", "list_name", "ip")
    return feeds.union_feeds(bulk, feeds.tag(entries, X.dim_feed(events)))


@query("known_ips", over_events("SELECT DISTINCT ip FROM te WHERE source = 'click'"))
def _(spark, sf):
    return feeds.known_ips(X.threat_events(spark, sf), "click")


@query(
    "new_ips_flat",
    over_events(
        """SELECT ip, min(pos) AS pos FROM feed_list WHERE list_name = 'view'
          AND ip NOT IN (SELECT ip FROM feed_list WHERE known) GROUP BY ip ORDER BY pos LIMIT 200""",
        FEED_LIST,
    ),
)
def _(spark, sf):
    entries = X.feed_list(X.threat_events(spark, sf))
    return feeds.new_ips(entries.filter("list_name = 'view'"), entries.filter("known"))


def _greedy(lists: int, cap: int) -> str:
    """One step per list: its first entries that are neither known nor chosen before."""
    steps, chosen = [], ""
    for i in range(1, lists + 1):
        earlier = f" AND ip NOT IN ({chosen})" if chosen else ""
        steps.append(
            f"""l{i} AS (SELECT ip, {i} AS priority, min(pos) AS pos FROM feed_list WHERE priority = {i}
            AND ip NOT IN (SELECT ip FROM feed_list WHERE known){earlier} GROUP BY ip ORDER BY pos LIMIT {cap})"""
        )
        chosen += (" UNION ALL " if chosen else "") + f"SELECT ip FROM l{i}"
    union = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(1, lists + 1))
    return ",\n" + ",\n".join(steps) + "\n" + union


@query("new_ips_lists", over_events(_greedy(5, 40), FEED_LIST))
def _(spark, sf):
    entries = X.feed_list(X.threat_events(spark, sf))
    return feeds.new_ips_by_list(entries, entries.filter("known"), [40] * 5)


@query(
    "feed_sample",
    over_events("SELECT event_id, ip FROM te ORDER BY md5(concat('42:', CAST(event_id AS VARCHAR))), event_id LIMIT 15"),
)
def _(spark, sf):
    return feeds.sample(X.threat_events(spark, sf), "event_id").select("event_id", "ip")


@query(
    "geo_backfill_country",
    over_events(
        """SELECT event_id, coalesce(te.country_code, CASE WHEN g.status = 'success' THEN g.country_code END) AS country_code
        FROM te LEFT JOIN geo_payloads g ON te.ip = g.ip""",
        CANDIDATES,
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    geo = X.landed_twice(X.geo_payloads(X.candidates(spark, sf, events)), countryCode=F.lit("ZZ"))
    return enrich.fill_country(events.select("event_id", "ip", "country_code"), geo).select("event_id", "country_code")


@query(
    "geo_refine",
    over_events(
        """SELECT event_id, CASE WHEN g.ip IS NOT NULL THEN g.lat ELSE te.latitude END AS latitude,
          CASE WHEN g.ip IS NOT NULL THEN g.lon ELSE te.longitude END AS longitude, g.city
        FROM te LEFT JOIN (SELECT * FROM geo_payloads WHERE status = 'success' AND lat IS NOT NULL) g ON te.ip = g.ip""",
        CANDIDATES,
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    geo = X.landed_twice(X.geo_payloads(X.candidates(spark, sf, events)), lat=F.col("lat") + 1, city=F.lit("Elsewhere"))
    return enrich.refine_location(events.select("event_id", "ip", "latitude", "longitude"), geo).drop("ip")


@query(
    "replay_pool",
    over_events(
        """SELECT event_id, ip, last_reported_at FROM te
        WHERE last_reported_at >= (SELECT min(last_reported_at) FROM te WHERE category IS NOT NULL)
        ORDER BY md5(concat('42:', CAST(event_id AS VARCHAR))), event_id LIMIT 500"""
    ),
)
def _(spark, sf):
    return tables.replay_pool(X.threat_events(spark, sf)).select("event_id", "ip", "last_reported_at")


@query(
    "scan_events",
    over_events("SELECT source, risk_level, count(*) AS n, count(anomaly_score) AS scored FROM te GROUP BY source, risk_level"),
)
def _(spark, sf):
    """Written in daily folders by two runs, and read from there."""
    path = shared_folder(spark, "events")
    events = X.threat_events(spark, sf).withColumn("load_date", F.to_date("loaded_at"))
    runs = events.withColumn("run", F.concat(F.lit("r"), F.col("event_id") % 2)).withColumn("batch_id", F.lit(0))
    runs.write.partitionBy("load_date", "run", "batch_id").parquet(path)
    stored = tables.scan_events(spark, path, since=datetime(2000, 1, 1))
    return stored.groupBy("source", "risk_level").agg(F.count("*").alias("n"), F.count("anomaly_score").alias("scored"))


FIRST = """,
firsts AS (
  SELECT ip, loaded_at, event_id, source, country_code, abuse_confidence_score, risk_level, category, report_count FROM (
    SELECT *, row_number() OVER (PARTITION BY ip ORDER BY loaded_at, event_id) AS rn, count(*) OVER (PARTITION BY ip) AS report_count
    FROM te) t WHERE rn = 1
)"""


@query(
    "join_first_counts",
    over_events(
        """SELECT f.ip, f.source, f.country_code, f.abuse_confidence_score, c.n AS report_count
        FROM firsts f JOIN (SELECT ip, count(*) AS n FROM te GROUP BY ip) c ON f.ip = c.ip""",
        FIRST,
    ),
)
def _(spark, sf):
    return A.first_with_counts(X.threat_events(spark, sf), ["ip", "source", "country_code", "abuse_confidence_score"])


@query(
    "join_dims",
    over_events(
        """SELECT event_id, coalesce(d.latitude, 0) AS latitude, coalesce(d.longitude, 0) AS longitude, m.tactic
        FROM te LEFT JOIN dim_country d ON te.country_code = d.country_code LEFT JOIN dim_category m ON te.category = m.category""",
        DIM_COUNTRY,
        DIM_CATEGORY,
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf).select("event_id", "country_code", "category")
    located = enrich.with_centroid(events, X.dim_country(spark, sf))
    return enrich.with_tactic(located, X.dim_category(spark)).select("event_id", "latitude", "longitude", "tactic")


@query(
    "anti_known",
    over_events("SELECT DISTINCT ip FROM feed_list WHERE ip NOT IN (SELECT ip FROM feed_list WHERE known)", FEED_LIST),
)
def _(spark, sf):
    entries = X.feed_list(X.threat_events(spark, sf))
    return entries.select("ip").distinct().join(entries.filter("known").select("ip"), "ip", "left_anti")


@query(
    "semi_in",
    over_events("SELECT event_id, ip FROM te WHERE ip IN (SELECT ip FROM reputation WHERE is_tor)", CANDIDATES),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    tor = X.reputation(X.candidates(spark, sf, events)).filter("is_tor").select("ip")
    return enrich.within(events.select("event_id", "ip"), tor, "ip")


REPORTED = """,
reported AS (
  SELECT ip, max(score) AS abuse_confidence_score FROM (
    SELECT ip, abuse_confidence_score AS score FROM te WHERE event_id % 5 > 1
    UNION ALL
    SELECT concat('9.9.9.', CAST(event_id % 200 AS VARCHAR)), NULL FROM te WHERE event_id % 5 > 1) r
  GROUP BY ip
),
enriched AS (
  SELECT r.ip, r.abuse_confidence_score, coalesce(s.n, 0) AS source_count
  FROM reported r LEFT JOIN (SELECT ip, count(DISTINCT source) AS n FROM te GROUP BY ip) s ON r.ip = s.ip
)"""


def reported_rows(spark, sf):
    events = X.threat_events(spark, sf)
    rows = enrich.project_cidr_reports(X.cidr_payloads(events))
    return A.cidr_enrich(rows.groupBy("ip").agg(F.max("abuse_confidence_score").alias("abuse_confidence_score")), events)


@query("cidr_enrich", over_events("SELECT * FROM enriched", REPORTED))
def _(spark, sf):
    return reported_rows(spark, sf)


@query(
    "rank_cidr",
    over_events("SELECT * FROM enriched ORDER BY source_count DESC, abuse_confidence_score DESC NULLS LAST, ip", REPORTED),
)
def _(spark, sf):
    return A.rank_cidr(reported_rows(spark, sf))


@query(
    "cidr_confirmed",
    over_events("SELECT count(*) FILTER (WHERE source_count >= 2) AS confirmed, count(*) AS reported FROM enriched", REPORTED),
)
def _(spark, sf):
    return A.cidr_confirmed(reported_rows(spark, sf))


@query(
    "cidr_members",
    over_events(
        """,
    numbered AS (
      SELECT ip, min(event_id) AS m, CAST(split_part(ip, '.', 1) AS BIGINT) AS a, CAST(split_part(ip, '.', 2) AS BIGINT) AS b,
        CAST(split_part(ip, '.', 3) AS BIGINT) AS c, CAST(split_part(ip, '.', 4) AS BIGINT) AS d FROM te GROUP BY ip
    ),
    ranges AS (
      SELECT DISTINCT concat(a, '.', b, '.', c, '.0/24') AS cidr, (a * 16777216 + b * 65536 + c * 256) AS lo, 256 AS size FROM numbered
      UNION ALL
      SELECT DISTINCT concat(a, '.', b, '.0.0/16'), (a * 16777216 + b * 65536), 65536 FROM numbered WHERE m % 10 = 0
      UNION ALL
      SELECT DISTINCT concat(ip, '/30'), (a * 16777216 + b * 65536 + c * 256 + d - d % 4), 4 FROM numbered WHERE m % 9 = 0
      UNION ALL
      SELECT DISTINCT concat(a, '.0.0.0/8'), a * 16777216, 16777216 FROM numbered
    )
    SELECT n.ip, r.cidr FROM numbered n JOIN ranges r
      ON a * 16777216 + b * 65536 + c * 256 + d >= r.lo AND a * 16777216 + b * 65536 + c * 256 + d < r.lo + r.size"""
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    return A.cidr_members(events, X.dim_cidr(events))


@query(
    "scalar_sub",
    over_events(
        "SELECT event_id FROM te WHERE last_reported_at >= (SELECT min(last_reported_at) FROM te WHERE category = 'C23')"
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    since = events.filter("category = 'C23'").agg(F.min("last_reported_at").alias("t")).scalar()
    return events.filter(F.col("last_reported_at") >= since).select("event_id")


def _landed(rows):
    """Reputation and location of the candidates, each looked up twice."""
    reputation = X.landed_twice(X.reputation(rows), abuse_confidence_score=F.lit(100.0), num_distinct_users=F.lit(99).cast("bigint"))
    return reputation, X.landed_twice(X.geo(rows), is_hosting=~F.col("is_hosting"))


def _kinds(spark):
    """The categories of the candidates' reputation records, two of five without a technique."""
    rows = [(f"Kind {i}", f"T{i}", f"X{i}", f"Technique {i}") for i in (1, 2, 4)]
    return spark.createDataFrame(rows, DIM_CATEGORY_COLUMNS)


@query(
    "dossier",
    over_events(
        """SELECT c.ip, coalesce(h.n, 0) AS history_count, coalesce(h.txt, '') AS history, r.abuse_confidence_score AS reputation_score,
          r.total_reports, g.is_hosting
        FROM candidates c
        LEFT JOIN (SELECT ip, count(*) AS n, string_agg(concat(CAST(rank AS VARCHAR), ':', source), ',' ORDER BY rank) AS txt
                   FROM history WHERE rank <= 50 GROUP BY ip) h ON c.ip = h.ip
        LEFT JOIN reputation r ON c.ip = r.ip LEFT JOIN geo g ON c.ip = g.ip""",
        CANDIDATES,
        LONG,
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    rows = X.candidates(spark, sf, events)
    full = decisions.dossier(rows, events, *_landed(rows))
    line = F.transform("history", lambda h: F.concat(h["rank"].cast("string"), F.lit(":"), h["source"]))
    return full.select(
        "ip",
        F.col("history_count").cast("bigint").alias("history_count"),
        F.coalesce(F.array_join(line, ","), F.lit("")).alias("history"),
        F.col("reputation.abuse_confidence_score").alias("reputation_score"),
        F.col("reputation.total_reports").alias("total_reports"),
        F.col("geo.is_hosting").alias("is_hosting"),
    )


@query(
    "attribution",
    over_events(
        """,
    evidence AS (
      SELECT ip, count(*) AS seen, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS n
      FROM history WHERE rank <= 50 GROUP BY ip
    ),
    ruled AS (
      SELECT c.ip, r.abuse_confidence_score AS s, r.num_distinct_users AS u, r.total_reports, coalesce(e.seen, 0) AS seen,
        coalesce(r.first_category, '') AS categories,
        coalesce(e.sources, '') AS sources,
        CASE WHEN r.ip IS NULL AND e.ip IS NULL THEN 0
          WHEN (r.abuse_confidence_score >= 90 AND coalesce(r.num_distinct_users, 0) >= 10)
            OR (r.abuse_confidence_score >= 70 AND coalesce(r.num_distinct_users, 0) >= 20) THEN 1
          WHEN e.n >= 2 THEN 2
          WHEN r.abuse_confidence_score >= 50 OR coalesce(r.num_distinct_users, 0) >= 3 THEN 3
          WHEN e.seen > 0 THEN 4
          WHEN r.abuse_confidence_score IS NOT NULL AND g.is_hosting THEN 5 ELSE 6 END AS rule
      FROM candidates c LEFT JOIN evidence e ON c.ip = e.ip LEFT JOIN reputation r ON c.ip = r.ip LEFT JOIN geo g ON c.ip = g.ip
    )
    SELECT ip, rule, CASE WHEN rule IN (1, 2) THEN 'block' WHEN rule IN (3, 4, 5) THEN 'monitor' ELSE 'insufficient_data' END AS recommendation,
      s IS NOT NULL OR seen > 0 AS known_threat, s AS confidence_score, u AS distinct_reporters, total_reports,
      seen AS seen_locally, sources AS corroborating_sources, categories,
      CASE WHEN categories IN ('Kind 1', 'Kind 2', 'Kind 4') THEN concat(categories, '/T', right(categories, 1), '/X', right(categories, 1)) ELSE '' END
        AS mitre
    FROM ruled""",
        CANDIDATES,
        LONG,
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    rows = X.candidates(spark, sf, events)
    decided = decisions.attribution(rows, events, *_landed(rows), _kinds(spark)).drop("reason")
    mitre = F.transform("mitre", lambda m: F.concat_ws("/", m["category"], m["tactic"], m["technique_id"]))
    return listed(decided.withColumn("mitre", mitre), "corroborating_sources", "categories", "mitre")


@query(
    "attribution_techniques",
    over_events(
        NAMED_CATEGORIES
        + """
    SELECT te.ip, d.category, d.tactic, d.technique_id, d.technique_name
    FROM named n JOIN te ON n.event_id = te.event_id JOIN dim_category d ON d.category = n.name""",
        DIM_CATEGORY,
    ),
)
def _(spark, sf):
    payloads = X.reputation_payloads(X.threat_events(spark, sf))
    return decisions.techniques(enrich.project_reputation(payloads, X.CATEGORY_NAMES), X.dim_category(spark))


@query(
    "keyed_update",
    over_events(
        "SELECT event_id, ip, CASE WHEN anomaly_score IS NULL AND event_id % 40 = 3 THEN CAST(-0.9 AS DOUBLE) ELSE anomaly_score END "
        "AS anomaly_score FROM te"
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf).select("event_id", "ip", "anomaly_score")
    updates = X.landed_twice(events.filter("event_id % 40 = 3").select("event_id", F.lit(-0.9).alias("anomaly_score")), anomaly_score=F.lit(-0.1))
    return enrich.keyed_update(events, updates, "event_id", "anomaly_score")


OFFENDERS = """,
offenders AS (
  SELECT ip, max(country_code) AS country_code, count(*) AS report_count, count(DISTINCT source) AS source_count,
    string_agg(DISTINCT source, ',' ORDER BY source) AS sources, max(abuse_confidence_score) AS max_score,
    max(last_reported_at) AS last_reported_at
  FROM te GROUP BY ip HAVING count(*) > 1
)"""


def exported(spark, write) -> DataFrame:
    """(part, line) of an export as it was written."""
    path = shared_folder(spark, "export")
    write(path)
    files = [spark.read.text(f"{path}/{part}").select(F.lit(part).alias("part"), F.col("value").alias("line")) for part in ("header", "rules")]
    return files[0].unionByName(files[1])


@query(
    "export_blocklist",
    over_events(
        """SELECT 'rules' AS part, concat('iptables -A INPUT -s ', ip, ' -j DROP') AS line FROM offenders
        UNION ALL SELECT 'header', '#!/bin/sh'
        UNION ALL SELECT 'header', '# generated blocklist, best corroborated addresses first'""",
        OFFENDERS,
    ),
)
def _(spark, sf):
    offenders = A.ip_stats(X.threat_events(spark, sf)).filter("reports > 1")
    return exported(spark, lambda path: exports.write_blocklist(offenders, path, "iptables"))


CLUSTERS = """,
clusters AS (
  SELECT concat(split_part(ip, '.', 1), '.', split_part(ip, '.', 2), '.', split_part(ip, '.', 3), '.0/24') AS subnet,
    count(DISTINCT ip) AS ip_count, max(country_code) AS country_code, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
    max(abuse_confidence_score) AS max_score, list_sort(list(DISTINCT ip))[1:8] AS sample_list
  FROM te GROUP BY 1 HAVING count(DISTINCT ip) >= 3
)"""


@query(
    "export_subnets",
    over_events(
        """SELECT 'rules' AS part, concat('deny ', subnet, ';') AS line FROM clusters
        UNION ALL SELECT 'header', '# generated deny list of /24 blocks with several reported addresses'""",
        CLUSTERS,
    ),
)
def _(spark, sf):
    return exported(spark, lambda path: exports.write_subnets(A.cluster_sizes(X.threat_events(spark, sf)), path))


@query(
    "export_feed_csv",
    over_events(
        """SELECT event_id, concat('"', ip, '","', coalesce(country_code, ''), '","', risk_level, '","',
          coalesce(strftime(event_time, '%Y-%m-%d %H:%M:%S'), ''), '"') AS line FROM te"""
    ),
)
def _(spark, sf):
    whole_seconds = F.date_trunc("second", "event_time").cast("timestamp_ntz")
    return exports.feed_csv_lines(X.threat_events(spark, sf).withColumn("event_time", whole_seconds))
