"""Declared schemas. Loading always names one, so nothing is inferred from the data."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _schema(columns: str) -> StructType:
    """Flat schema from "name type, name type" with Spark's type names.

    Spark's own reader of such texts needs a running session, which does not exist yet when this is imported.
    """
    out = StructType()
    for column in columns.split(", "):
        name, kind = column.split(" ")
        out = out.add(name, kind)
    return out


# --- fixed values: names and types of the messages and of the table, which other programs read
RAW_MESSAGE = _schema(
    "ip string, country_code string, abuse_confidence_score double, last_reported_at string, "
    "source string, ingested_at double, category string"
)

# columns every enriched event carries to the table and to the outgoing stream
EVENT_COLUMNS = [
    "ip",
    "country_code",
    "abuse_confidence_score",
    "risk_level",
    "latitude",
    "longitude",
    "last_reported_at",
    "event_time",
    "source",
    "category",
]

# event_id is our row key: load times tie within a batch, so every "newest" needs it
THREAT_EVENTS = _schema(
    "event_id long, ip string, country_code string, abuse_confidence_score double, risk_level string, "
    "latitude double, longitude double, last_reported_at string, event_time timestamp_ntz, "
    "loaded_at timestamp_ntz, source string, category string, reoffense_probability double, "
    "anomaly_score double"
)

PIPELINE_METRICS = _schema(
    "batch_id long, batch_rows long, write_duration_ms double, recorded_at timestamp_ntz, malformed_rows long"
)

BRIEFING_SNAPSHOTS = _schema(
    "recorded_at timestamp_ntz, gini_coefficient double, top_country_pct double, "
    "cross_source_pct double, categorized_pct double"
)

# nested payloads of external services, as DDL
BULK_PAYLOAD = (
    "data array<struct<ipAddress: string, countryCode: string, abuseConfidenceScore: double, "
    "lastReportedAt: string>>"
)

REPUTATION_PAYLOAD = (
    "ip string, data struct<countryCode: string, countryName: string, isp: string, domain: string, "
    "hostnames: array<string>, usageType: string, abuseConfidenceScore: double, totalReports: bigint, "
    "numDistinctUsers: bigint, isWhitelisted: boolean, isPublic: boolean, isTor: boolean, "
    "reports: array<struct<categories: array<int>>>>"
)

GEO_PAYLOAD = (
    "ip string, status string, city string, regionName string, countryCode string, lat double, lon double, "
    "proxy boolean, hosting boolean, mobile boolean, `as` string, timezone string"
)

CIDR_PAYLOAD = (
    "data struct<networkAddress: string, netmask: string, numPossibleHosts: bigint, "
    "addressSpaceDesc: string, reportedAddress: array<struct<ipAddress: string, "
    "abuseConfidenceScore: double, numReports: bigint, mostRecentReport: string>>>"
)

DIM_COUNTRY = _schema("country_code string, latitude double, longitude double, name string")
DIM_CATEGORY = _schema("category string, tactic string, technique_id string, technique_name string")
DIM_TACTIC = _schema("tactic string, advice string")
DIM_FEED = _schema("source string, list_name string, priority integer, category string, score double, cap integer")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Bring a frame written under an older schema up to `schema`: missing columns become NULL."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
