"""Freshness, latency and data-quality figures of the event table."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ipvigil.constants import RECENT_BATCHES
from ipvigil.functions.columns import check_status, known_risk_level, safe_pct, safe_rate
from ipvigil.operators.counts import loaded_since
from ipvigil.operators.scale import exact_percentiles
SECOND_MICROS = 1_000_000
DAY_MICROS = 86_400 * SECOND_MICROS


def load_minute():
    return F.date_trunc("minute", F.col("loaded_at")).cast("timestamp_ntz")


def minute_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(load_minute().alias("loaded_minute")).agg(F.count("*").alias("n"))


def recent_minutes(events: DataFrame, n: int = RECENT_BATCHES) -> DataFrame:
    return minute_counts(events).orderBy(F.col("loaded_minute").desc_nulls_first()).limit(n)


def minute_batch_count(events: DataFrame) -> DataFrame:
    return minute_counts(events).agg(F.count("loaded_minute").alias("minutes"))


def pct_valid_geo(events: DataFrame) -> DataFrame:
    """Percentage of rows with both coordinates set and not zero."""
    valid = F.count_if((F.col("latitude") != 0) & (F.col("longitude") != 0))
    return events.agg(valid.alias("valid"), F.count("*").alias("n")).select(
        F.try_divide(F.col("valid") * 100.0, F.col("n").cast("double")).alias("pct_valid_geo")
    )


def latency_percentiles(events: DataFrame, shares=(0.5, 0.95), approximate: bool = False) -> DataFrame:
    """Seconds from event to load: one column per share and the sample size.

    Exact by default at any size; `approximate` trades a bounded rank error for a single scan.
    """
    timed = events.filter(F.col("event_time").isNotNull() & F.col("loaded_at").isNotNull())
    micros = F.unix_micros(F.col("loaded_at").cast("timestamp")) - F.unix_micros(F.col("event_time").cast("timestamp"))
    latencies = timed.select(micros.alias("latency"))
    names = [f"p{round(s * 100)}" for s in shares]
    if approximate:
        picked = F.percentile_approx("latency", [float(s) for s in shares], 100_000)
        rows = latencies.agg(picked.alias("p"), F.count("*").alias("samples"))
        return rows.select(*[(F.col("p")[i] / 1e6).alias(n) for i, n in enumerate(names)], "samples")
    exact = exact_percentiles(latencies, "latency", shares, widths=(DAY_MICROS, SECOND_MICROS))
    columns = [
        F.max(F.when(F.col("share") == float(s), F.col("value") / 1e6)).alias(n) for s, n in zip(shares, names)
    ]
    return exact.agg(*columns, F.coalesce(F.max("n"), F.lit(0)).alias("samples"))


def throughput(events: DataFrame, minutes: int = 10, at: datetime | None = None) -> DataFrame:
    recent = loaded_since(events, f"{minutes} MINUTES", at, inclusive=False)
    return recent.agg((F.count("*") / F.lit(float(minutes))).alias("per_minute"))


def duplicate_rows(events: DataFrame, *columns: str, name: str = "exact_duplicates") -> DataFrame:
    """Rows beyond the first of every tuple; NULL counts as a value."""
    tuples = events.groupBy(*columns).agg(F.count("*").alias("n"))
    return tuples.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(name))


def failure_counts() -> dict[str, Column]:
    """Counts of rows that break a rule; they add up over parts of the table."""
    country, score = F.col("country_code"), F.col("abuse_confidence_score")
    return {
        "bad_country": F.count_if(country.isNull() | (F.length(country) != 2)),
        "bad_score": F.count_if((score < 0) | (score > 100)),
        "bad_risk": F.count_if(~known_risk_level("risk_level")),
        "bad_time": F.count_if(F.col("last_reported_at").isNotNull() & F.col("last_reported_at").try_cast("timestamp").isNull()),
    }


def exact_duplicates(events: DataFrame) -> DataFrame:
    return duplicate_rows(events, "ip", "source", "last_reported_at")


def quality_counters(events: DataFrame) -> DataFrame:
    """One row of failure counts, all but the duplicates from a single pass."""
    single = events.agg(F.count("*").alias("total"), *[c.alias(n) for n, c in failure_counts().items()])
    return single.withColumn("exact_duplicates", exact_duplicates(events).scalar())


CHECKS = [
    ("last_reported_at format", "bad_time"),
    ("country_code completeness", "bad_country"),
    ("score range", "bad_score"),
    ("risk level values", "bad_risk"),
    ("exact duplicates", "exact_duplicates"),
]


def judged(counters: DataFrame) -> DataFrame:
    """Check rows (name, status, failed, total, pct) from one row of counts."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("failed")) for n, c in CHECKS])
    return counters.select("total", F.inline(rows)).select(
        "name",
        check_status("failed", "total").alias("status"),
        "failed",
        "total",
        F.round(safe_pct("failed", "total"), 2).alias("pct"),
    )


def quality_checks(events: DataFrame) -> DataFrame:
    return judged(quality_counters(events))


def failing_checks(events: DataFrame) -> DataFrame:
    return quality_checks(events).agg(F.count_if(F.col("status") != "pass").alias("failing"))


def write_metrics(metrics: DataFrame, n: int = RECENT_BATCHES) -> DataFrame:
    """Newest micro-batches with their write rate (NULL where the write took no measurable time)."""
    newest = metrics.orderBy(F.col("recorded_at").desc_nulls_first(), F.col("batch_id").desc()).limit(n)
    return newest.withColumn("rows_per_sec", safe_rate("batch_rows", F.col("write_duration_ms") / 1000.0))


def write_percentiles(metrics: DataFrame) -> DataFrame:
    """Percentiles of write times; the table has one row per micro-batch, so the built-in exact form fits."""
    return metrics.agg(
        F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY write_duration_ms)").alias("p50_ms"),
        F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY write_duration_ms)").alias("p95_ms"),
        F.count("*").alias("samples"),
    )


def score_coverage(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count("*").alias("total"),
        F.count("reoffense_probability").alias("reoffense_scored"),
        F.count("anomaly_score").alias("anomaly_scored"),
    )
