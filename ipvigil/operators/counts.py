"""Counts of events by group, and facts about the whole table."""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ipvigil.constants import TOP_COUNTRIES
from ipvigil.functions.columns import safe_pct


def as_of(events: DataFrame, at: datetime | None = None, time: str = "loaded_at") -> Column:
    """The reference moment of a report: given, or the newest load; never the wall clock."""
    if at is not None:
        return F.lit(at).cast("timestamp_ntz")
    if time == "loaded_at" and "load_date" in events.columns:
        last = events.select("load_date").agg(F.max("load_date").alias("d")).scalar()
        events = events.filter(F.col("load_date") == last)
    return events.agg(F.max(time).alias("as_of")).scalar()


def total(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("total"))


def count_by(events: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per value, largest first; the NULL group is kept."""
    counted = events.groupBy(column).agg(F.count("*").alias(name))
    return counted.orderBy(F.col(name).desc(), F.col(column).asc_nulls_first())


def count_by_category(events: DataFrame) -> DataFrame:
    return count_by(events.filter(F.col("category").isNotNull()), "category")


def distinct_values(events: DataFrame, column: str, name: str) -> DataFrame:
    """Exact number of non-NULL values. Grouping first lets the last task count rows, not hold a set."""
    return events.select(column).filter(F.col(column).isNotNull()).distinct().agg(F.count("*").alias(name))


def approx_distinct_values(events: DataFrame, column: str, name: str, error: float = 0.01) -> DataFrame:
    return events.agg(F.approx_count_distinct(column, error).alias(name))


def last_loaded(events: DataFrame) -> DataFrame:
    return events.agg(F.max("loaded_at").alias("last_loaded_at"))


def loaded_since(events: DataFrame, interval: str, at: datetime | None = None, inclusive: bool = True) -> DataFrame:
    """Events loaded within `interval` before the reference moment; of a table in daily folders only their days."""
    start = as_of(events, at) - F.expr(f"INTERVAL {interval}")
    loaded = F.col("loaded_at")
    if "load_date" in events.columns:
        events = events.filter(F.col("load_date") >= F.to_date(start))
    return events.filter(loaded >= start if inclusive else loaded > start)


def top_countries(events: DataFrame, k: int = TOP_COUNTRIES) -> DataFrame:
    """The k most frequent known countries; equal counts by code."""
    known = events.filter(F.col("country_code").isNotNull())
    counted = known.groupBy("country_code").agg(F.count("*").alias("n"))
    return counted.orderBy(F.col("n").desc(), "country_code").limit(k)


def top_country_codes(events: DataFrame, k: int = TOP_COUNTRIES) -> list[str]:
    return [row.country_code for row in top_countries(events, k).collect()]


def top_k_share(counted: DataFrame, group: str, n: str = "n", k: int = 5, rest: str = "Other") -> DataFrame:
    """Share of the k largest groups, and of all others together.

    `counted` has one row per group. The top k are found with a bounded sort; the others only need totals.
    """
    groups = counted.select(F.col(group).cast("string").alias("grp"), F.col(n).alias("n"))
    top = groups.orderBy(F.col("n").desc(), F.col("grp").asc_nulls_first()).limit(k)
    ranked = top.withColumn(
        "position", F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("grp").asc_nulls_first()))
    )
    whole = groups.agg(F.sum("n").alias("whole"))
    leftover = whole.select(
        F.lit(rest).alias("grp"),
        (F.col("whole") - F.coalesce(top.agg(F.sum("n").alias("s")).scalar(), F.lit(0))).alias("n"),
        F.lit(k + 1).alias("position"),
    ).filter("n > 0")
    both = ranked.select("grp", "n", "position").unionByName(leftover)
    return both.withColumn("pct", safe_pct("n", whole.scalar())).orderBy("position")


def events_by(events: DataFrame, *columns: str) -> DataFrame:
    """One scan's worth of counts by several low-cardinality columns; the group reports are built from it."""
    return events.groupBy(*columns).agg(F.count("*").alias("n"))


def grouped_by_each(events: DataFrame, columns: Sequence[str], **counts: Column) -> DataFrame:
    """Counts by every one of some columns, and of all rows, in one pass (GROUPING SETS).

    `grouping` names the column a row is about ("" for the row about everything), `value` is its value as text, `n` the
    rows; `counts` are whole-number aggregates (an `n` among them takes the place of the number of rows). Map tasks combine, so a hot value costs one row per task.

    Reports take several parts of this frame. Names and values depend on a count and the numbers sit in one array, so a
    part's filter and columns stay above the grouping, all parts have it in common, and it runs once.
    """
    named = F.lit("")
    for c in columns:
        named = F.when(F.grouping(c) == 0, F.lit(c)).otherwise(named)
    value = F.coalesce(*[F.col(c).cast("string") for c in columns])
    whole = {"n": F.count("*"), **counts}
    sets = events.groupingSets([[c] for c in columns] + [[]], *columns)
    numbered = [c.cast("bigint").alias(name) for name, c in whole.items()]
    some = F.count("*") > 0
    cells = sets.agg(F.when(some, named).alias("grouping"), F.when(some, value).alias("value"), *numbered)
    cells = cells.select("grouping", "value", F.transform(F.array(*whole), lambda x: x).alias("numbers"))
    return cells.select("grouping", "value", *[F.get("numbers", F.lit(i)).alias(c) for i, c in enumerate(whole)])


def attack_patterns(events: DataFrame, dim_category: DataFrame) -> DataFrame:
    """Per category: count, share of categorised events, most frequent known country and tactic.

    One pass: totals are taken over the per-category rows (the uncategorised ones included), which are few.
    """
    cells = events_by(events, "category", "country_code")
    largest = F.min(
        F.when(F.col("country_code").isNotNull(), F.struct((-F.col("n")).alias("neg"), F.col("country_code")))
    )
    per_category = cells.groupBy("category").agg(F.sum("n").alias("n"), largest.alias("top"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = F.when(F.col("category").isNotNull(), F.col("n"))
    totals = per_category.withColumns(
        {
            "categorised": F.coalesce(F.sum(known).over(everything), F.lit(0)),
            "total": F.sum("n").over(everything),
        }
    ).filter(F.col("category").isNotNull())
    labelled = totals.join(dim_category.select("category", "tactic"), "category", "left")
    return labelled.select(
        "category",
        "n",
        safe_pct("n", "categorised").alias("pct_of_categorized"),
        F.col("top.country_code").alias("top_country"),
        (-F.col("top.neg")).alias("top_country_n"),
        "tactic",
        safe_pct("categorised", "total").alias("pct_categorized_of_total"),
    ).orderBy(F.col("n").desc(), "category")


def top_country_per_category(events: DataFrame) -> DataFrame:
    known = events.filter(F.col("category").isNotNull() & F.col("country_code").isNotNull())
    cells = events_by(known, "category", "country_code")
    order = Window.partitionBy("category").orderBy(F.col("n").desc(), "country_code")
    return cells.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def tactic_rollup(events: DataFrame, dim_category: DataFrame) -> DataFrame:
    """Categorised events per tactic with their share of all categorised events; unmapped ones are left out."""
    counted = events_by(events.filter(F.col("category").isNotNull()), "category")
    whole = counted.agg(F.sum("n").alias("whole")).scalar()
    mapped = counted.join(dim_category.select("category", "tactic"), "category")
    per_tactic = mapped.filter(F.col("tactic").isNotNull()).groupBy("tactic").agg(F.sum("n").alias("n"))
    return per_tactic.withColumn("pct_of_categorized", safe_pct("n", whole)).orderBy(F.col("n").desc(), "tactic")


def tactic_ips(events: DataFrame, dim_category: DataFrame) -> DataFrame:
    """Distinct addresses over the categories of the leading tactic."""
    top = tactic_rollup(events, dim_category).limit(1).select("tactic")
    chosen = dim_category.join(top, "tactic", "left_semi").select("category")
    hits = events.join(chosen, "category", "left_semi").select("ip").distinct()
    return hits.agg(F.count("*").alias("ip_count")).withColumn("tactic", top.scalar())
