"""Pages, top lists and time series."""

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ipvigil.constants import LIVE_FEED_ROWS, RECENT_POOL, TREND_ROWS
from ipvigil.functions import columns as C
from ipvigil.operators.addresses import page_bounds
from ipvigil.operators.scale import SCORE_WIDTHS, exact_percentiles, newest

# --- fixed values: names of request parameters
SORT_COLUMNS = {
    "loaded_at": "loaded_at",
    "score": "abuse_confidence_score",
    "reported_at": "last_reported_at",
    "ip": "ip",
    "country": "country_code",
}
HISTORY_COLUMNS = [
    "event_id",
    "ip",
    "country_code",
    "risk_level",
    "abuse_confidence_score",
    "last_reported_at",
    "loaded_at",
]


def filter_history(events: DataFrame, country: str | None = None, risk: str | None = None) -> DataFrame:
    """Optional equality filters; an empty string filters nothing."""
    if country:
        events = events.filter(F.col("country_code") == C.country_filter(country))
    if risk:
        events = events.filter(F.col("risk_level") == risk)
    return events


def history_page(
    events: DataFrame,
    page: int = 1,
    page_size: int = 25,
    country: str | None = None,
    risk: str | None = None,
    sort: str = "loaded_at",
    after: tuple[Any, int] | None = None,
) -> DataFrame:
    """One page of events, newest (or largest) first, with the number of matching rows.

    `after` = (sort value, event_id) of the last row seen continues from there at the cost of a first page,
    however deep; page numbers serve the first MAX_PAGED_ROWS rows.
    """
    skip, size = page_bounds(1 if after is not None else page, page_size)
    column = SORT_COLUMNS.get(sort, "loaded_at")
    matching = filter_history(events, country, risk)
    rows = matching
    if after is not None:
        value, event_id = after
        key = F.col(column)
        tie = F.col("event_id") > event_id
        if value is None:
            rows = rows.filter(key.isNotNull() | tie)
        else:
            value = F.lit(value).cast(events.schema[column].dataType)
            rows = rows.filter((key < value) | ((key == value) & tie))
    ordered = rows.orderBy(F.col(column).desc_nulls_first(), "event_id")
    found = ordered.offset(skip).limit(size) if skip else ordered.limit(size)
    return found.select(*HISTORY_COLUMNS).withColumn("total", matching.agg(F.count("*").alias("total")).scalar())


def rarity(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Add the rarest of source, country and category of every row: label, value, count, share and text.

    Counts come from one grouping of `events`, whose result adaptive execution reuses for all three features;
    "uncategorized" is counted against the NULL group. The columns are NULL when the rarest value still holds five
    percent or more.
    """
    features = ["source", "country_code", "category"]
    labels = {"source": "source", "country_code": "country", "category": "category"}
    cells = events.select(F.inline(F.array(*[
        F.struct(F.lit(labels[f]).alias("label"), F.col(f).cast("string").alias("value")) for f in features
    ])))
    counted = cells.groupBy("label", "value").agg(F.count("*").alias("cnt"))
    # through the count the label's filters stay above the grouping, so that it runs once
    counted = counted.withColumn("label", F.when(F.col("cnt") > 0, F.col("label")))
    total = counted.filter("label = 'source'").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n")).scalar()
    out = rows
    for i, f in enumerate(features):
        side = counted.filter(F.col("label") == labels[f]).select(
            F.col("value").alias(f"value_{i}"), F.col("cnt").alias(f"cnt_{i}")
        )
        out = out.join(side, F.col(f).eqNullSafe(F.col(f"value_{i}")), "left").drop(f"value_{i}")

    def candidate(i: int, value: Column) -> Column:
        return F.struct(
            F.coalesce(F.col(f"cnt_{i}"), F.lit(0)).alias("cnt"),
            F.lit(i).alias("ord"),
            F.lit(labels[features[i]]).alias("label"),
            value.alias("value"),
        )

    def stated(f: str) -> Column:
        return F.coalesce(F.col(f), F.lit("")) != ""

    options = F.array_compact(F.array(
        F.when(stated("source"), candidate(0, F.col("source"))),
        F.when(stated("country_code"), candidate(1, F.col("country_code"))),
        candidate(2, F.when(stated("category"), F.col("category")).otherwise("uncategorized")),
    ))
    out = out.withColumn("rarest", F.array_min(options)).withColumn("n_all", total)
    rare = (F.col("n_all") > 0) & (F.col("rarest.cnt") * 20 < F.col("n_all"))
    tiny = F.col("rarest.cnt") * 1000 < F.col("n_all")
    share = F.when(tiny, F.lit("<0.1")).otherwise(C.tenths_text(F.col("rarest.cnt"), F.col("n_all")))
    text = F.concat(F.col("rarest.label"), F.lit(" "), F.col("rarest.value"), F.lit(" in "), share, F.lit("% of events"))
    return out.withColumns(
        {
            "rare_label": F.when(rare, F.col("rarest.label")),
            "rare_value": F.when(rare, F.col("rarest.value")),
            "rare_count": F.when(rare, F.col("rarest.cnt")),
            "why": F.when(rare, text),
        }
    ).drop("rarest", "n_all", *[f"cnt_{i}" for i in range(len(features))])


def anomalies(events: DataFrame, breaks=None, limit: int = 8, pool: int = RECENT_POOL) -> DataFrame:
    """Strangest of the newest events (lowest anomaly score first) with their rank among all and a reason."""
    recent = newest(events, pool).filter(F.col("anomaly_score").isNotNull())
    picked = recent.orderBy("anomaly_score", F.col("loaded_at").desc(), "event_id").limit(limit)
    if isinstance(breaks, Column):
        picked = picked.withColumn("breaks", breaks)
        breaks = F.col("breaks")
    scored = picked.withColumn("unusual_pct", C.unusual_pct("anomaly_score", breaks))
    explained = rarity(scored, events)
    return explained.select(
        "event_id",
        "ip",
        "source",
        "country_code",
        "category",
        "risk_level",
        "abuse_confidence_score",
        "anomaly_score",
        "unusual_pct",
        "loaded_at",
        "why",
    ).orderBy("anomaly_score", F.col("loaded_at").desc(), "event_id")


def score_percentiles(events: DataFrame, column: str = "anomaly_score") -> DataFrame:
    """One array of 101 interpolated breakpoints (NULL without scores), exact for scores of any precision."""
    shares = [i / 100 for i in range(101)]
    found = exact_percentiles(events, column, shares, SCORE_WIDTHS)
    pairs = F.sort_array(F.collect_list(F.struct("share", F.round("value", 6).alias("value"))))
    return found.agg(pairs.alias("pairs")).select(F.when(F.size("pairs") > 0, F.col("pairs.value")).alias("breaks"))


def live_feed(events: DataFrame, n: int = LIVE_FEED_ROWS) -> DataFrame:
    located = events.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return located.orderBy(F.col("event_time").desc_nulls_last(), "ip", "source").limit(n)


def trends(snapshots: DataFrame, limit: int = TREND_ROWS, keep: str = "newest") -> DataFrame:
    """Snapshot series in time order. `keep='oldest'` stops following the series once it exceeds the limit."""
    order = F.col("recorded_at").asc() if keep == "oldest" else F.col("recorded_at").desc()
    chosen = snapshots.orderBy(order).limit(limit)
    return chosen.select("recorded_at", "gini_coefficient", "cross_source_pct", "categorized_pct").orderBy("recorded_at")


def latest_snapshot(snapshots: DataFrame, at: Column) -> DataFrame:
    """The last snapshot and its age in minutes."""
    last = snapshots.orderBy(F.col("recorded_at").desc()).limit(1)
    seconds = F.unix_seconds(at.cast("timestamp")) - F.unix_seconds(F.col("recorded_at").cast("timestamp"))
    return last.withColumn("age_minutes", seconds / F.lit(60.0))


def snapshot_due(snapshots: DataFrame, at: Column) -> DataFrame:
    newest_row = snapshots.agg(F.max("recorded_at").alias("last"))
    due = F.col("last").isNull() | (F.col("last") < at - F.expr("INTERVAL 1 HOUR"))
    return newest_row.select("last", due.alias("due"))


def trend_direction(snapshots: DataFrame, column: str, scale: float = 1.0) -> DataFrame:
    """Direction of a series from its first to its last value; NULL with fewer than two snapshots."""
    ends = snapshots.agg(
        F.min_by(F.coalesce(F.col(column), F.lit(0.0)), "recorded_at").alias("first_value"),
        F.max_by(F.coalesce(F.col(column), F.lit(0.0)), "recorded_at").alias("last_value"),
        F.count("*").alias("n"),
    )
    direction = F.when(F.col("n") >= 2, C.trend_direction("first_value", "last_value", scale))
    return ends.withColumn("direction", direction)


def rank_findings(findings: DataFrame) -> DataFrame:
    priority = F.col("priority")
    order = F.when(priority == "high", 0).when(priority == "medium", 1).when(priority == "low", 2).otherwise(9)
    return findings.orderBy(order, "position")


def posture(findings: DataFrame) -> DataFrame:
    counted = findings.agg(F.count_if(F.col("priority") == "high").alias("urgent"), F.count("*").alias("findings"))
    return counted.withColumn("tone", C.posture("urgent", "findings"))
