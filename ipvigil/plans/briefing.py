"""Ranked findings and limitations, and the hourly snapshot they are compared with."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ipvigil.functions.columns import safe_pct, trend_delta
from ipvigil.operators.addresses import offender_totals
from ipvigil.operators.concentration import gini
from ipvigil.operators.counts import as_of, grouped_by_each
from ipvigil.operators.rankings import latest_snapshot


def _figures(events: DataFrame, snapshots: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(one row of figures, counts by category), from one grouping by each column and the counts per address."""
    cells = grouped_by_each(events, ["country_code", "category", "source"])
    by_country, by_category, by_source = (
        cells.filter(F.col("grouping") == c).select(F.col("value").alias(c), "n") for c in ("country_code", "category", "source")
    )
    ordered = by_country.orderBy(F.col("n").desc(), F.col("country_code").asc_nulls_first()).limit(5)
    leading = ordered.agg(
        F.sum("n").alias("n"),
        F.max("n").alias("first"),
        F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("country_code").alias("c")))),
            lambda s: F.coalesce(s["c"], F.lit("unknown")),
        ).alias("names"),
    )
    base = by_category.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("category").isNotNull(), F.col("n"))), F.lit(0)).alias("categorised"),
    )
    offenders = offender_totals(events).select("repeat_ips", "cross_source_ips", "max_reports")
    row = base.withColumns(
        {
            "gini": gini(by_country).select("gini").scalar(),
            "sources": by_source.agg(F.count("*").alias("n")).scalar(),
            "only_source": by_source.agg(F.max("source").alias("s")).scalar(),
            "top5": leading.select(F.struct("n", "first", F.array_join("names", ", ").alias("names"))).scalar(),
            "offenders": offenders.select(F.struct("*")).scalar(),
        }
    )
    row = row.select("*", "offenders.*").drop("offenders").withColumns(
        {
            "top5_names": F.col("top5.names"),
            "top5_pct": safe_pct(F.coalesce(F.col("top5.n"), F.lit(0)), "total"),
            "top_country_pct": safe_pct(F.coalesce(F.col("top5.first"), F.lit(0)), "total"),
            "repeat_pct": safe_pct("repeat_ips", "total"),
            "cross_source_pct": safe_pct("cross_source_ips", "total"),
            "categorized_pct": safe_pct("categorised", "total"),
        }
    )
    if snapshots is not None:
        last = latest_snapshot(snapshots, as_of(events))
        row = row.withColumn("previous", last.select(F.struct("gini_coefficient", "cross_source_pct", "age_minutes")).scalar())
        row = row.withColumns(
            {
                "gini_delta": trend_delta(F.round("gini", 3), F.col("previous.gini_coefficient")),
                "cross_delta": trend_delta(F.round("cross_source_pct", 1), F.col("previous.cross_source_pct")),
            }
        )
    else:
        row = row.withColumns({c: F.lit(None).cast("double") for c in ("gini_delta", "cross_delta")})
    return row, by_category


def briefing(
    events: DataFrame, snapshots: DataFrame | None, dim_category: DataFrame, dim_tactic: DataFrame
) -> DataFrame:
    """Rows (position, kind, priority, subject, amount, pct, delta, text); limitations have no priority."""
    row, by_category = _figures(events, snapshots)
    mapped = by_category.filter("category IS NOT NULL").join(dim_category.select("category", "tactic"), "category")
    tactics = mapped.filter("tactic IS NOT NULL").groupBy("tactic").agg(F.sum("n").alias("n"))
    leading = tactics.orderBy(F.col("n").desc(), "tactic").limit(1).join(dim_tactic, "tactic", "left")
    chosen = dim_category.join(leading.select("tactic"), "tactic", "left_semi").select("category")
    tactic_ips = events.join(chosen, "category", "left_semi").select("ip").distinct().agg(F.count("*").alias("n"))
    row = row.withColumns(
        {
            "tactic": leading.select(F.struct("tactic", "n", "advice")).scalar(),
            "tactic_ips": tactic_ips.scalar(),
        }
    ).withColumn("tactic_pct", safe_pct("tactic.n", "categorised"))

    none = F.lit(None)

    def finding(position, kind, priority, when=None, subject=none, amount=none, pct=none, delta=none, text=none) -> Column:
        record = F.struct(
            F.lit(position).alias("position"),
            F.lit(kind).alias("kind"),
            F.lit(priority).cast("string").alias("priority"),
            subject.cast("string").alias("subject"),
            amount.cast("bigint").alias("amount"),
            pct.cast("double").alias("pct"),
            delta.cast("double").alias("delta"),
            text.cast("string").alias("text"),
        )
        return record if when is None else F.when(when, record)

    c = F.col
    count_text = lambda column: c(column).cast("string")
    any_events = c("total") > 0
    corroborated = c("cross_source_ips") > 0
    weak = F.coalesce(c("max_reports") <= 3, F.lit(False))
    advised = c("tactic.advice").isNotNull() & (c("categorised") > 0)
    findings = F.array_compact(F.array(
        finding(1, "geography", "high", any_events, c("top5_names"), none, c("top5_pct"), c("gini_delta"),
                F.concat(F.lit("Limit or block traffic from the leading countries first: "), c("top5_names"))),
        finding(2, "cross_source", "high", any_events & corroborated, none, c("cross_source_ips"), c("cross_source_pct"), c("cross_delta"),
                F.concat(F.lit("Block addresses confirmed by several feeds: "), count_text("cross_source_ips"))),
        finding(2, "repeat_ips", "medium", any_events & ~corroborated, none, c("repeat_ips"), c("repeat_pct"), none,
                F.concat(F.lit("Block addresses that keep returning: "), count_text("repeat_ips"))),
        finding(3, "single_source", "medium", any_events & (c("sources") <= 1), c("only_source"), c("sources"), F.lit(100.0), none,
                F.concat(F.lit("All events come from one feed, add another: "), F.coalesce("only_source", F.lit("unnamed")))),
        finding(4, "top_tactic", "medium", any_events & advised, c("tactic.tactic"), c("tactic_ips"), c("tactic_pct"), none,
                F.concat(c("tactic.advice"), F.lit(" - addresses involved: "), count_text("tactic_ips"))),
        finding(5, "limit_repeats", None, any_events & weak, none, c("max_reports"), c("repeat_pct"), none,
                F.concat(F.lit("No address was reported more often than "), count_text("max_reports"), F.lit(" times"))),
        finding(6, "limit_categories", None, any_events, none, c("categorised"), c("categorized_pct"), none,
                F.lit("Only part of the events carry a category; the bulk feed states none")),
        finding(7, "limit_latency", None, any_events, none, none, none, none,
                F.lit("Latency is measured on events with an event time only")),
        finding(8, "limit_lookups", None, any_events, none, none, none, none,
                F.lit("Decisions use own history alone where external records are missing")),
    ))
    return row.select(F.inline(findings))


def snapshot(events: DataFrame, snapshots: DataFrame, force: bool = False) -> DataFrame:
    """The row to append to the snapshot series: empty unless the last one is over an hour old."""
    row, _ = _figures(events, None)
    now = as_of(events)
    last = snapshots.agg(F.max("recorded_at").alias("last")).scalar()
    due = F.lit(True) if force else last.isNull() | (last < now - F.expr("INTERVAL 1 HOUR"))
    return row.filter((F.col("total") > 0) & due).select(
        now.alias("recorded_at"),
        F.round("gini", 3).alias("gini_coefficient"),
        F.round("top_country_pct", 1).alias("top_country_pct"),
        F.round("cross_source_pct", 1).alias("cross_source_pct"),
        F.round("categorized_pct", 1).alias("categorized_pct"),
    )
