"""Block / monitor decisions for all addresses at once."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ipvigil.functions import columns as C
from ipvigil.operators.addresses import ip_history, local_evidence
from ipvigil.operators.scale import latest_per_key

DECISIONS = ["insufficient_data", "block", "block", "monitor", "monitor", "monitor", "insufficient_data"]


def evidence(addresses: DataFrame, events: DataFrame, reputation: DataFrame, geo: DataFrame) -> DataFrame:
    """Every address once with its local sightings, reputation and hosting flag. All four sides meet on ip."""
    rep = latest_per_key(reputation, "ip").select(
        "ip", "abuse_confidence_score", "num_distinct_users", "total_reports", "recent_categories"
    )
    hosts = latest_per_key(geo, "ip").select("ip", "is_hosting")
    joined = (
        addresses.select("ip")
        .distinct()
        .join(local_evidence(events), "ip", "left")
        .join(rep.withColumn("in_reputation", F.lit(True)), "ip", "left")
        .join(hosts, "ip", "left")
    )
    return joined.withColumns(
        {
            "seen": F.coalesce("seen", F.lit(0)),
            "sources": F.coalesce("sources", F.array().cast("array<string>")),
            "recent_categories": F.coalesce("recent_categories", F.array().cast("array<string>")),
            "in_reputation": F.coalesce("in_reputation", F.lit(False)),
        }
    )


def attribution(
    addresses: DataFrame, events: DataFrame, reputation: DataFrame, geo: DataFrame, dim_category: DataFrame | None = None
) -> DataFrame:
    """One decision per address, however often it is asked for: the first rule that holds, numbered 0 to 6.

    With `dim_category` also the tactics and techniques of its recent categories, as the list `mitre`.
    """
    known = evidence(addresses, events, reputation, geo)
    mitre = []
    if dim_category is not None:
        found = techniques(known.select("ip", "recent_categories"), dim_category)
        record = F.struct("category", "tactic", "technique_id", "technique_name")
        listed = found.groupBy("ip").agg(F.sort_array(F.collect_set(record)).alias("mitre"))
        known = known.join(listed, "ip", "left")
        mitre = [F.coalesce("mitre", F.array().cast(listed.schema["mitre"].dataType)).alias("mitre")]
    score = F.col("abuse_confidence_score")
    reporters = F.coalesce("num_distinct_users", F.lit(0))
    seen = F.col("seen") > 0
    rule = (
        F.when(~F.col("in_reputation") & ~seen, 0)
        .when(((score >= 90) & (reporters >= 10)) | ((score >= 70) & (reporters >= 20)), 1)
        .when(F.size("sources") >= 2, 2)
        .when((score >= 50) | (reporters >= 3), 3)
        .when(seen, 4)
        .when(score.isNotNull() & F.col("is_hosting"), 5)
        .otherwise(6)
    )
    decision = F.element_at(F.array(*[F.lit(d) for d in DECISIONS]), F.col("rule") + 1)
    texts = [
        F.lit("unknown to both reputation data and own events"),
        F.concat(F.lit("score "), F.col("confidence").cast("string"), F.lit(" backed by "), reporters.cast("string"), F.lit(" reporters")),
        F.concat(F.lit("seen by independent feeds: "), F.array_join("sources", ", ")),
        F.lit("moderate score or several reporters"),
        F.concat(F.lit("seen "), F.col("seen").cast("string"), F.lit(" time(s) by a single feed")),
        F.lit("weak score on a hosting network"),
        F.lit("on record, with too little support to act"),
    ]
    reason = F.element_at(F.array(*[F.coalesce(t, F.lit("")) for t in texts]), F.col("rule") + 1)
    return (
        known.withColumn("rule", rule)
        .withColumn("confidence", F.round(score, 0).cast("bigint"))
        .select(
            "ip",
            "rule",
            decision.alias("recommendation"),
            (score.isNotNull() | seen).alias("known_threat"),
            score.alias("confidence_score"),
            F.col("num_distinct_users").alias("distinct_reporters"),
            "total_reports",
            F.col("seen").alias("seen_locally"),
            F.col("sources").alias("corroborating_sources"),
            F.col("recent_categories").alias("categories"),
            reason.alias("reason"),
            *mitre,
        )
    )


def techniques(reputation: DataFrame, dim_category: DataFrame) -> DataFrame:
    """Tactic and technique of every recent category of an address; unmapped categories are left out."""
    reported = reputation.select("ip", F.explode("recent_categories").alias("category"))
    return reported.join(dim_category, "category").select("ip", "category", "tactic", "technique_id", "technique_name")


def origin_verdict(reputation: DataFrame, geo: DataFrame) -> DataFrame:
    """Kind of network behind an address, and what it was last reported for."""
    flags = latest_per_key(geo, "ip").select("ip", "is_proxy_or_vpn", "is_hosting", "is_mobile")
    joined = latest_per_key(reputation, "ip").select("ip", "is_tor", "recent_categories").join(flags, "ip", "left")
    return joined.select(
        "ip",
        C.origin("is_tor", "is_proxy_or_vpn", "is_hosting", "is_mobile").alias("origin"),
        C.last_activity("recent_categories").alias("last_activity"),
    )


def dossier(addresses: DataFrame, events: DataFrame, reputation: DataFrame, geo: DataFrame) -> DataFrame:
    """Per address: its newest rows as a list (at most 50), its reputation and its location as records."""
    fields = ["rank", "loaded_at", "source", "category", "risk_level", "abuse_confidence_score",
              "country_code", "last_reported_at", "reoffense_probability"]
    asked = addresses.select("ip").distinct()
    # trimmed to the newest rows per address first: what is joined has at most 50 rows per address
    rows = ip_history(events.select("ip", "event_id", *[f for f in fields if f != "rank"])).join(asked, "ip", "left_semi")
    history = rows.groupBy("ip").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("history"))
    rep, loc = (
        latest_per_key(side, "ip").select("ip", F.struct(*[c for c in side.columns if c not in ("ip", "landed_at")]).alias(name))
        for side, name in ((reputation, "reputation"), (geo, "geo"))
    )
    joined = asked.join(history, "ip", "left").join(rep, "ip", "left").join(loc, "ip", "left")
    return joined.withColumn("history_count", F.coalesce(F.size("history"), F.lit(0)))
