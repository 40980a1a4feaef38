"""The overview of the whole table as rows (section, key, value)."""

from collections.abc import Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ipvigil.operators.addresses import offender_totals, stats_of, totals_of
from ipvigil.operators.concentration import gini
from ipvigil.operators.counts import as_of, grouped_by_each
from ipvigil.sources.partials import pairs


def section(name: str, frame: DataFrame, value: str | Column, key: str | None = None) -> DataFrame:
    return facts(frame, {name: F.col(value) if isinstance(value, str) else value}, key)


def facts(frame: DataFrame, values: Mapping[str, Column], key: str | None = None) -> DataFrame:
    """Every row of `frame` as one row per named value."""
    label = F.col(key).cast("string") if key else F.lit(None).cast("string")
    rows = [
        F.struct(F.lit(name).alias("section"), label.alias("key"), value.cast("double").alias("value"))
        for name, value in values.items()
    ]
    return frame.select(F.inline(F.array(*rows)))


def stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def summary(events: DataFrame, at: datetime | None = None) -> DataFrame:
    """Totals, group counts, repeat and cross-source addresses and concentration.

    The group reports are one grouping by each column, whose rows are told apart afterwards. Besides, the table is read for
    the counts per address and, one column, for the newest load; nothing runs before the result is asked for. To answer
    without reading the events at all, see `summary_of_partials`.
    """
    return _summary(events, F.lit(1), offender_totals(events), at)


def summary_of_partials(cells: DataFrame, addresses: DataFrame, at: datetime | None = None) -> DataFrame:
    """`summary` from the partials that are written with each batch (`sources.partials`)."""
    return _summary(cells, F.col("n"), totals_of(stats_of(pairs(addresses))), at)


def _summary(rows: DataFrame, n: Column, totals: DataFrame, at: datetime | None) -> DataFrame:
    """`n`: how many events a row stands for."""
    since = as_of(rows, at) - F.expr("INTERVAL 24 HOURS")
    cells = grouped_by_each(
        rows,
        ["country_code", "category", "risk_level"],
        n=F.sum(n),
        recent=F.sum(F.when(F.col("loaded_at") >= since, n).otherwise(0)),
        last=F.max(F.unix_seconds(F.col("loaded_at").cast("timestamp"))),
    )
    by = {c: cells.filter(F.col("grouping") == c) for c in ("country_code", "category", "risk_level")}
    by_country = by["country_code"]
    whole = cells.filter("grouping = ''").agg(F.sum("n").alias("n"), F.sum("recent").alias("recent"), F.max("last").alias("last"))
    return stacked([
        facts(whole, {
            "total": F.coalesce("n", F.lit(0)),
            "new_24h": F.coalesce("recent", F.lit(0)),
            "last_loaded_epoch": F.col("last"),
        }),
        facts(totals, {
            "repeat_offenders": F.col("repeat_ips"),
            "cross_source_corroborated": F.col("cross_source_ips"),
        }),
        section("by_risk", by["risk_level"], "n", "value"),
        section("by_country", by_country, "n", "value"),
        section("distinct_countries", by_country.agg(F.count_if(F.col("value").isNotNull() & (F.col("n") > 0)).alias("n")), "n"),
        section("by_category", by["category"].filter("value IS NOT NULL"), "n", "value"),
        section("gini_coefficient", gini(by_country), "gini"),
    ])
