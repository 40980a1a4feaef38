"""Reports from partials: events are loaded in batches with their partials, days are merged, and only partials are read."""

from datetime import date

from pyspark.sql import functions as F

from ipvigil.catalog import fixtures as X
from ipvigil.catalog.aggregates import IP_STATS, BY_COUNTRY, SUMMARY
from ipvigil.catalog.registry import query
from ipvigil.catalog.sql import DIM_CATEGORY, over_events
from ipvigil.operators.addresses import stats_of
from ipvigil.plans.summary import summary_of_partials
from ipvigil.session import cut_lineage, shared_folder
from ipvigil.sources import partials


#: What partials are made of.
COLUMNS = ["loaded_at", "country_code", "category", "risk_level", "source", "ip"]


def written(spark, sf) -> str:
    """Three batches, the first of them written twice; the days of the first half are merged, some of them twice.

    The batches lie on storage before their partials are made, so events are derived once and a batch is read by itself.
    """
    events, path = X.threat_events(spark, sf), shared_folder(spark, "partials")
    batches = events.select(*COLUMNS, (F.col("event_id") % 3).alias("batch"))
    loaded = cut_lineage(batches, "batches", "batch")
    for batch in (0, 1, 2, 0):
        partials.write_partials(loaded.filter(F.col("batch") == batch).drop("batch"), path, batch, "run")
    ends = loaded.agg(F.min("loaded_at").alias("low"), F.max("loaded_at").alias("high")).first()
    half = ends.low.date() + (ends.high.date() - ends.low.date()) / 2
    partials.merge_days(spark, path, date.fromordinal(half.toordinal() - 1))
    partials.merge_days(spark, path, half)
    return path


def _read(spark, sf, *kinds: str):
    path = written(spark, sf)
    return [partials.read_partials(spark, path, kind) for kind in kinds]


@query("partials_summary", over_events(SUMMARY, IP_STATS, BY_COUNTRY))
def _(spark, sf):
    return summary_of_partials(*_read(spark, sf, "cells", "addresses"))


@query("partials_ip_stats", over_events("SELECT * FROM ip_stats", IP_STATS))
def _(spark, sf):
    return stats_of(partials.pairs(*_read(spark, sf, "addresses")))


@query(
    "partials_by",
    over_events(
        """SELECT 'source' AS kind, source AS value, count(*) AS n FROM te GROUP BY source
        UNION ALL SELECT 'category', category, count(*) FROM te GROUP BY category
        UNION ALL SELECT 'risk_level', risk_level, count(*) FROM te GROUP BY risk_level"""
    ),
)
def _(spark, sf):
    (cells,) = _read(spark, sf, "cells")
    parts = [partials.count_by(cells, c).select(F.lit(c).alias("kind"), F.col(c).alias("value"), "n") for c in ("source", "category", "risk_level")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "partials_throughput",
    over_events(
        "SELECT CAST(count(*) AS DOUBLE) / 10 AS per_minute FROM te WHERE loaded_at > (SELECT max(loaded_at) FROM te) - INTERVAL 10 MINUTE"
    ),
)
def _(spark, sf):
    return partials.throughput(*_read(spark, sf, "cells"))


@query(
    "sketch_addresses",
    over_events("SELECT true AS theta_close, true AS hll_close, count(DISTINCT ip) AS ip_count FROM te"),
)
def _(spark, sf):
    """The sketches' answers over all days next to the exact one: both within three standard errors."""
    found = partials.distinct_addresses(*_read(spark, sf, "sketches"))
    exact = X.threat_events(spark, sf).select("ip").distinct().agg(F.count("ip").alias("n")).scalar()
    close = lambda c: F.abs(F.col(c) - exact) <= exact * 3 / 2 ** (partials.LG_K / 2)
    return found.select(close("ip_count").alias("theta_close"), close("ip_count_hll").alias("hll_close"), exact.alias("ip_count"))


@query(
    "sketch_tactics",
    over_events(
        """SELECT tactic, true AS close, count(DISTINCT ip) AS ip_count FROM te JOIN dim_category d ON te.category = d.category
        WHERE tactic IS NOT NULL GROUP BY tactic""",
        DIM_CATEGORY,
    ),
)
def _(spark, sf):
    dim = X.dim_category(spark)
    found = partials.tactic_addresses(*_read(spark, sf, "sketches"), dim).withColumnRenamed("ip_count", "estimate")
    pairs = X.threat_events(spark, sf).join(dim, "category").filter("tactic IS NOT NULL").select("tactic", "ip").distinct()
    exact = pairs.groupBy("tactic").agg(F.count("ip").alias("ip_count"))
    close = F.abs(F.col("estimate") - F.col("ip_count")) <= F.col("ip_count") * 3 / 2 ** (partials.LG_K / 2)
    return found.join(exact, "tactic").select("tactic", close.alias("close"), "ip_count")
