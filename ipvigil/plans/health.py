"""State of the ingestion as rows (section, key, value)."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ipvigil.constants import RECENT_BATCHES
from ipvigil.operators import quality as Q
from ipvigil.operators.counts import as_of, grouped_by_each
from ipvigil.plans.summary import facts, section, stacked


def pipeline_health(events: DataFrame, at: datetime | None = None) -> DataFrame:
    """Recent batches, geo validity, sources, latency, throughput and quality checks.

    Everything additive is one grouping by load minute, by source and of all rows; latency and duplicates need their
    own passes. Nothing runs before the result is asked for.
    """
    recent = F.col("loaded_at") > as_of(events, at) - F.expr("INTERVAL 10 MINUTES")
    cells = grouped_by_each(
        events.withColumn("loaded_minute", F.unix_seconds(Q.load_minute().cast("timestamp"))),
        ["loaded_minute", "source"],
        valid=F.count_if((F.col("latitude") != 0) & (F.col("longitude") != 0)),
        recent=F.count_if(recent),
        **Q.failure_counts(),
    )
    minutes = cells.filter("grouping = 'loaded_minute'")
    latest = minutes.orderBy(F.col("value").cast("bigint").desc_nulls_first()).limit(RECENT_BATCHES)
    whole = cells.filter("grouping = ''").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("valid", "recent", *Q.failure_counts())],
    )
    whole = whole.withColumn("exact_duplicates", Q.exact_duplicates(events).scalar())
    checks = Q.judged(whole)
    grade = F.when(F.col("status") == "pass", 0).when(F.col("status") == "warn", 1).otherwise(2)
    return stacked([
        section("recent_batch", latest, "n", "value"),
        section("total_batches", minutes.agg(F.count_if(F.col("value").isNotNull() & (F.col("n") > 0)).alias("n")), "n"),
        section("by_source", cells.filter("grouping = 'source'"), "n", "value"),
        facts(whole, {
            "pct_valid_geo": F.try_divide(F.col("valid") * 100.0, F.col("total").cast("double")),
            "throughput_per_min": F.col("recent") / F.lit(10.0),
        }),
        facts(Q.latency_percentiles(events), {
            "latency_p50_seconds": F.round("p50", 1),
            "latency_p95_seconds": F.round("p95", 1),
            "latency_sample_size": F.col("samples"),
        }),
        facts(checks, {"check_failed": F.col("failed"), "check_pct": F.col("pct"), "check_not_passed": grade}, key="name"),
    ])
