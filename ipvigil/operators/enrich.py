"""From parsed messages to events, and joins with lookup tables. All work on batch and streaming frames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ipvigil.functions import columns as C
from ipvigil.operators.scale import latest_per_key
from ipvigil.schema import EVENT_COLUMNS


def with_centroid(events: DataFrame, dim_country: DataFrame) -> DataFrame:
    """Country coordinates; an unknown or missing country lies at (0, 0)."""
    dim = dim_country.select("country_code", "latitude", "longitude")
    joined = events.drop("latitude", "longitude").join(dim, "country_code", "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("latitude", "longitude")}
    )


def with_country_name(events: DataFrame, dim_country: DataFrame) -> DataFrame:
    """Country name, else its code, else 'Unknown' (also for an empty code)."""
    dim = dim_country.select("country_code", F.col("name").alias("country_name"))
    code = F.when(F.col("country_code") != "", F.col("country_code"))
    joined = events.join(dim, "country_code", "left")
    return joined.withColumn("country_name", F.coalesce("country_name", code, F.lit("Unknown")))


def with_tactic(events: DataFrame, dim_category: DataFrame, keep_unmapped: bool = True) -> DataFrame:
    return events.join(dim_category, "category", "left" if keep_unmapped else "inner")


def enrich(messages: DataFrame, dim_country: DataFrame) -> DataFrame:
    """Event columns plus the category list (and the mark of malformed messages), for every message."""
    marked = ["malformed"] if "malformed" in messages.columns else []
    located = with_centroid(messages, dim_country)
    return located.withColumns(
        {
            "risk_level": C.risk_level("abuse_confidence_score"),
            "event_time": C.event_time("ingested_at"),
            "categories": C.categories("category"),
        }
    ).select(*EVENT_COLUMNS, "categories", *marked)


def fill_country(messages: DataFrame, geo: DataFrame) -> DataFrame:
    """Country by address where the message has none; stays NULL if the lookup knows nothing.

    The latest successful answer for an address counts (by `landed_at`, where the answers have it).
    """
    known = latest_per_key(geo.filter(F.col("status") == "success"), "ip")
    found = known.select("ip", F.col("countryCode").alias("found"))
    joined = messages.join(found, "ip", "left")
    return joined.withColumn("country_code", F.coalesce("country_code", "found")).drop("found")


def refine_location(events: DataFrame, geo: DataFrame) -> DataFrame:
    """City coordinates where the latest successful lookup with a position has them, else those at hand."""
    known = latest_per_key(geo.filter((F.col("status") == "success") & F.col("lat").isNotNull()), "ip")
    found = known.select("ip", F.col("lat").alias("geo_lat"), F.col("lon").alias("geo_lon"), "city")
    joined = events.join(found, "ip", "left")
    located = F.col("geo_lat").isNotNull()
    return joined.withColumns(
        {
            "latitude": F.when(located, F.col("geo_lat")).otherwise(F.col("latitude")),
            "longitude": F.when(located, F.col("geo_lon")).otherwise(F.col("longitude")),
        }
    ).drop("geo_lat", "geo_lon")


def project_reputation(payloads: DataFrame, names: dict[int, str]) -> DataFrame:
    """Flat reputation record per address from the nested payload; payloads without data are dropped."""
    d = F.col("data")
    return payloads.filter(d.isNotNull()).select(
        "ip",
        d["countryCode"].alias("country_code"),
        d["countryName"].alias("country_name"),
        d["isp"].alias("isp"),
        d["domain"].alias("domain"),
        F.coalesce(d["hostnames"], F.array().cast("array<string>")).alias("hostnames"),
        d["usageType"].alias("usage_type"),
        d["abuseConfidenceScore"].alias("abuse_confidence_score"),
        d["totalReports"].alias("total_reports"),
        d["numDistinctUsers"].alias("num_distinct_users"),
        d["isWhitelisted"].alias("is_whitelisted"),
        d["isPublic"].alias("is_public"),
        d["isTor"].alias("is_tor"),
        C.category_names(d["reports"], names).alias("recent_categories"),
    )


def project_geo(payloads: DataFrame) -> DataFrame:
    return payloads.filter(F.col("status") == "success").select(
        "ip",
        "city",
        F.col("regionName").alias("region"),
        "lat",
        "lon",
        F.col("proxy").alias("is_proxy_or_vpn"),
        F.col("hosting").alias("is_hosting"),
        F.col("mobile").alias("is_mobile"),
        F.col("as").alias("asn"),
        "timezone",
    )


def project_cidr_reports(payloads: DataFrame) -> DataFrame:
    """One row per reported address of a range payload; missing fields are NULL."""
    exploded = payloads.select("data.networkAddress", "data.netmask", F.explode("data.reportedAddress").alias("r"))
    return exploded.select(
        F.col("networkAddress").alias("network_address"),
        "netmask",
        F.col("r.ipAddress").alias("ip"),
        F.col("r.abuseConfidenceScore").alias("abuse_confidence_score"),
        F.col("r.numReports").alias("total_reports"),
        F.col("r.mostRecentReport").alias("last_reported_at"),
    )


def within(rows: DataFrame, members: DataFrame, column: str) -> DataFrame:
    """Rows whose `column` is among the values of the first column of `members`, a set of any size.

    A semi-join: repeated members multiply nothing, NULL is no member, and the set travels by its run-time size.
    """
    values = members.select(F.col(members.columns[0]).alias(column))
    return rows.join(values, column, "left_semi")


def matching_live(events: DataFrame, country: str | None = None, category: str | None = None) -> DataFrame:
    """Live-feed filter: country equality and membership in the category list; unset filters pass all."""
    if country:
        events = events.filter(F.col("country_code") == country)
    if category:
        events = events.filter(F.array_contains("categories", category))
    return events


def seen_categories(events: DataFrame) -> DataFrame:
    return events.select(F.explode("categories").alias("category")).distinct().orderBy("category")


def keyed_update(events: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Fill `column` by key where it is NULL; all other rows pass without a shuffle.

    Of several updates of a key the latest counts (by `landed_at`, where there is one, else the largest value).
    """
    missing = events.filter(F.col(column).isNull())
    timed = [c for c in ("landed_at",) if c in updates.columns and c not in (key, column)]
    new = latest_per_key(updates.select(key, *timed, F.col(column).alias("new_value")), key)
    filled = missing.join(new, key, "left").withColumn(column, F.col("new_value")).drop("new_value")
    return events.filter(F.col(column).isNotNull()).unionByName(filled.select(*events.columns))
