"""The event table and its companions, derived from the given tables.

Each frame has a twin in SQL text below, used by the checks; both define the same rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ipvigil.functions.columns import risk_level
from ipvigil.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOADED = (
    "CAST(timestamp_seconds(CAST(ceil(unix_micros(CAST(ts AS TIMESTAMP)) / 300000000) AS BIGINT) * 300 + 7) "
    "AS TIMESTAMP_NTZ)"
)


def events_from(raw: DataFrame, nation: DataFrame) -> DataFrame:
    """Threat events from the given event stream; works on a batch or a streaming frame."""
    keyed = raw.withColumn("k", F.expr("CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)")).withColumn(
        "n_nationkey", F.expr("CAST((user_id * user_id) % 25 AS INT)")
    )
    joined = keyed.join(nation.select("n_nationkey", "n_regionkey"), "n_nationkey")
    built = joined.selectExpr(
        "event_id",
        "concat(CAST(11 + CAST(floor(user_id / 250) AS INT) AS STRING), '.', CAST(user_id % 250 AS STRING), '.', "
        "CAST(CAST(floor(k / 5) AS INT) AS STRING), '.', CAST(k % 5 + 1 AS STRING)) AS ip",
        "CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 211 = 5 THEN 'ZZZ' "
        "ELSE concat(chr(65 + n_nationkey), chr(65 + n_regionkey)) END AS country_code",
        "CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 331 = 1 THEN value + 100.0D "
        "ELSE least(value, 100.0D) END AS abuse_confidence_score",
        "CASE WHEN event_id % 50 = 0 THEN 0.0D ELSE CAST(n_nationkey * 5 - 61 AS DOUBLE) END AS latitude",
        "CASE WHEN event_id % 50 = 0 THEN 0.0D ELSE CAST(n_nationkey * 13 - 150 AS DOUBLE) END AS longitude",
        "concat(date_format(ts, 'yyyy-MM-dd'), 'T00:00:00+00:00') AS last_reported_at",
        "CASE WHEN event_id % 40 = 0 THEN NULL ELSE ts END AS event_time",
        f"{LOADED} AS loaded_at",
        "event_type AS source",
        "CASE WHEN (event_id * 31) % 100 < 35 "
        "THEN concat('C', lpad(CAST((event_id * 17) % 23 + 1 AS STRING), 2, '0')) END AS category",
        "CAST((event_id * 53) % 10000 AS DOUBLE) / 10000 AS reoffense_probability",
        "CASE WHEN event_id % 20 = 3 THEN NULL "
        "ELSE -0.3D - CAST((event_id * 37) % 3000 AS DOUBLE) / 10000 END AS anomaly_score",
    )
    return built.withColumn("risk_level", risk_level("abuse_confidence_score"))


def threat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_from(table(spark, sf_dir, "events"), table(spark, sf_dir, "nation"))


def message_rows(events: DataFrame) -> DataFrame:
    epoch = F.unix_micros(F.col("loaded_at").cast("timestamp")) / F.lit(1e6) - F.col("event_id") % 300 + F.lit(0.25)
    return events.select(
        "event_id",
        "ip",
        "country_code",
        "abuse_confidence_score",
        "last_reported_at",
        "source",
        epoch.alias("ingested_at"),
        "category",
    )


def message_text(events: DataFrame) -> DataFrame:
    """(event_id, value): JSON messages, every 500th cut off in the middle."""
    rows = message_rows(events)
    text = F.to_json(F.struct(*[c for c in rows.columns if c != "event_id"]))
    broken = F.when(F.col("event_id") % 500 == 7, F.substring(text, 1, 20)).otherwise(text)
    return rows.select("event_id", broken.alias("value"))


def pipeline_metrics(events: DataFrame) -> DataFrame:
    loads = events.groupBy("loaded_at").agg(F.count("*").alias("batch_rows"))
    return loads.select(
        F.floor(F.unix_seconds(F.col("loaded_at").cast("timestamp")) / 300).alias("batch_id"),
        "batch_rows",
        F.when(F.col("batch_rows") % 4 == 0, 0.0).otherwise(5.0 + F.col("batch_rows") * 1.5).alias("write_duration_ms"),
        F.col("loaded_at").alias("recorded_at"),
    )


def briefing_snapshots(events: DataFrame) -> DataFrame:
    hour = F.date_trunc("hour", F.col("loaded_at")).cast("timestamp_ntz")
    pairs = events.groupBy(hour.alias("recorded_at"), "source").agg(
        F.count("*").alias("n"), F.min("event_id").alias("e"), F.count("category").alias("c")
    )
    return pairs.groupBy("recorded_at").agg(
        ((F.sum("n") % 10).cast("double") / 10).alias("gini_coefficient"),
        (F.min("e") % 100).cast("double").alias("top_country_pct"),
        (F.count("source") * 10).cast("double").alias("cross_source_pct"),
        (F.sum("c").cast("double") * 100 / F.sum("n")).alias("categorized_pct"),
    )


def feed_list(events: DataFrame) -> DataFrame:
    source = F.col("source")
    priority = (
        F.when(source == "error", 1).when(source == "click", 2).when(source == "view", 3).when(source == "signup", 4)
    ).otherwise(5)
    return events.select(
        F.lit("lists").alias("source"),
        source.alias("list_name"),
        priority.alias("priority"),
        F.col("event_id").alias("pos"),
        "ip",
        (F.col("event_id") % 7 == 0).alias("known"),
    )


def candidates(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    own = events.groupBy("ip").agg(F.min("event_id").alias("m"))
    others = table(spark, sf_dir, "customer").selectExpr(
        "concat('100.64.', CAST(CAST(floor(c_custkey / 250) AS INT) AS STRING), '.', "
        "CAST(c_custkey % 250 AS STRING)) AS ip",
        "c_custkey AS m",
    )
    return cut_lineage(own.unionByName(others), "candidates")


def reputation(rows: DataFrame) -> DataFrame:
    return rows.filter("m % 3 <> 0").selectExpr(
        "ip",
        "CAST(m % 101 AS DOUBLE) AS abuse_confidence_score",
        "m % 25 AS num_distinct_users",
        "m % 60 AS total_reports",
        "m % 11 = 0 AS is_tor",
        "m % 13 AS asn_key",
        "CASE WHEN m % 4 = 1 THEN array(concat('Kind ', CAST(m % 5 AS STRING))) ELSE CAST(array() AS array<string>) END "
        "AS recent_categories",
    )


def geo(rows: DataFrame) -> DataFrame:
    return rows.filter("m % 2 = 0").selectExpr(
        "ip", "m % 4 = 0 AS is_hosting", "m % 5 = 0 AS is_proxy_or_vpn", "m % 7 = 0 AS is_mobile"
    )


def geo_payloads(rows: DataFrame) -> DataFrame:
    """Location answers: every fifth failed, some without a position."""
    return rows.filter("m % 2 = 0").selectExpr(
        "ip",
        "CASE WHEN m % 5 = 0 THEN 'fail' ELSE 'success' END AS status",
        "concat('City ', CAST(m % 9 AS STRING)) AS city",
        "concat('Region ', CAST(m % 4 AS STRING)) AS regionName",
        "concat(chr(CAST(65 + m % 26 AS INT)), 'Q') AS countryCode",
        "CASE WHEN m % 7 = 3 THEN NULL ELSE CAST(m % 90 AS DOUBLE) END AS lat",
        "CAST(m % 180 AS DOUBLE) AS lon",
        "m % 5 = 1 AS proxy",
        "m % 4 = 0 AS hosting",
        "m % 7 = 0 AS mobile",
        "concat('AS', CAST(m % 13 AS STRING)) AS `as`",
        "'UTC' AS timezone",
    )


def landed_twice(answers: DataFrame, **stale: Column) -> DataFrame:
    """Every lookup answer, and an older one for the same address with other values."""
    older = answers.withColumns(stale).withColumn("landed_at", F.lit("2024-01-01"))
    return answers.withColumn("landed_at", F.lit("2024-02-01")).unionByName(older)


def reputation_payloads(events: DataFrame) -> DataFrame:
    """One nested answer per event with twelve reports of two categories each; ids 24 and 25 mean nothing."""
    return events.selectExpr(
        "event_id",
        "ip",
        "CASE WHEN event_id % 19 = 0 THEN NULL ELSE named_struct('countryCode', country_code, 'countryName', "
        "concat('Land ', country_code), 'isp', concat('ISP ', source), 'domain', concat(source, '.example'), "
        "'hostnames', CASE WHEN event_id % 2 = 0 THEN array(concat('h', CAST(event_id AS STRING)), 'alias') END, "
        "'usageType', 'Data Center', 'abuseConfidenceScore', abuse_confidence_score, 'totalReports', event_id % 60, "
        "'numDistinctUsers', event_id % 25, 'isWhitelisted', event_id % 29 = 0, 'isPublic', true, "
        "'isTor', event_id % 11 = 0, 'reports', transform(sequence(1, 12), i -> named_struct('categories', "
        "array(CAST((event_id * i) % 25 + 1 AS INT), CAST((event_id + i) % 25 + 1 AS INT))))) END AS data",
    )


CATEGORY_NAMES = {i: f"C{i:02d}" for i in range(1, 24)}


def dim_category(spark: SparkSession) -> DataFrame:
    """23 codes, every sixth of them unmapped."""
    return spark.range(1, 24).filter("id % 6 <> 0").selectExpr(
        "concat('C', lpad(CAST(id AS STRING), 2, '0')) AS category",
        "concat('T', CAST(id % 7 AS STRING)) AS tactic",
        "concat('X', CAST(1000 + id AS STRING)) AS technique_id",
        "concat('Technique ', CAST(id AS STRING)) AS technique_name",
    )


def dim_tactic(spark: SparkSession) -> DataFrame:
    return spark.range(0, 7).selectExpr("concat('T', CAST(id AS STRING)) AS tactic", "concat('Advice ', CAST(id AS STRING)) AS advice")


def dim_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "concat(chr(65 + n_nationkey), chr(65 + n_regionkey)) AS country_code",
        "CAST(n_nationkey * 5 - 61 AS DOUBLE) AS latitude",
        "CAST(n_nationkey * 13 - 150 AS DOUBLE) AS longitude",
        "CASE WHEN n_nationkey % 5 <> 4 THEN n_name END AS name",
    )


def dim_feed(events: DataFrame) -> DataFrame:
    rows = feed_list(events).select("source", "list_name", "priority").distinct()
    return rows.selectExpr(
        "source",
        "list_name",
        "priority",
        "concat('Kind ', list_name) AS category",
        "CAST(70 + 5 * priority AS DOUBLE) AS score",
        "40 AS cap",
    )


def dim_cidr(events: DataFrame) -> DataFrame:
    """Every /24 of the events, the /16 and /30 around some, and a /8."""
    numbered = events.groupBy("ip").agg(F.min("event_id").alias("m"))
    octets = F.split("ip", r"\.")
    first = [F.get(octets, F.lit(i)) for i in range(4)]
    c24 = numbered.select(F.concat_ws(".", first[0], first[1], first[2], F.lit("0/24")).alias("cidr"))
    c16 = numbered.filter("m % 10 = 0").select(F.concat_ws(".", first[0], first[1], F.lit("0.0/16")).alias("cidr"))
    c30 = numbered.filter("m % 9 = 0").select(F.concat(F.concat_ws(".", *first), F.lit("/30")).alias("cidr"))
    c8 = numbered.select(F.concat(first[0], F.lit(".0.0.0/8")).alias("cidr"))
    return cut_lineage(c24.unionByName(c16).unionByName(c30).unionByName(c8).distinct(), "ranges")


def cidr_payloads(events: DataFrame) -> DataFrame:
    """Range answers, one per event block of the same source and day, each with a short list of addresses."""
    return events.selectExpr(
        "named_struct('networkAddress', substring_index(ip, '.', 3), 'netmask', '255.255.255.0', "
        "'numPossibleHosts', CAST(254 AS BIGINT), 'addressSpaceDesc', 'test', 'reportedAddress', "
        "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN CAST(array() AS "
        "array<struct<ipAddress:string,abuseConfidenceScore:double,numReports:bigint,mostRecentReport:string>>) "
        "ELSE array(named_struct('ipAddress', ip, 'abuseConfidenceScore', abuse_confidence_score, 'numReports', "
        "event_id % 60, 'mostRecentReport', last_reported_at), named_struct('ipAddress', concat('9.9.9.', "
        "CAST(event_id % 200 AS STRING)), 'abuseConfidenceScore', CAST(NULL AS DOUBLE), 'numReports', "
        "CAST(NULL AS BIGINT), 'mostRecentReport', CAST(NULL AS STRING))) END) AS data"
    )


def bulk_payloads(events: DataFrame) -> DataFrame:
    """Bulk answers of two entries each."""
    return events.selectExpr(
        "event_id",
        "array(named_struct('ipAddress', ip, 'countryCode', country_code, 'abuseConfidenceScore', "
        "abuse_confidence_score, 'lastReportedAt', last_reported_at), named_struct('ipAddress', "
        "concat('9.9.8.', CAST(event_id % 200 AS STRING)), 'countryCode', CAST(NULL AS STRING), "
        "'abuseConfidenceScore', CAST(event_id % 100 AS DOUBLE), 'lastReportedAt', CAST(NULL AS STRING))) AS data",
        "CAST(event_id AS DOUBLE) AS ingested_at",
    )


def list_lines(events: DataFrame) -> DataFrame:
    """Lines of text lists: padded, commented, blank and '#' lines among them."""
    return events.selectExpr(
        "event_id AS pos",
        "CASE WHEN event_id % 10 = 0 THEN concat('# ', ip) WHEN event_id % 10 = 1 THEN '   ' "
        "WHEN event_id % 10 = 2 THEN concat('  ', ip, ' ; seen twice') WHEN event_id % 10 = 3 THEN concat('  #', ip) "
        "ELSE ip END AS value",
    )
