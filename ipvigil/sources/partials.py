"""Additive partial results next to the event table: what reports need of a batch, written with it and merged when read.

A batch owns its partials as it owns its rows: a repeated batch replaces them. Three kinds are kept by day of load:
`cells` (rows per load time, country, category, risk level and source), `addresses` (rows per address and source) and
`sketches` (per category, theta and HLL sketches of its addresses). Counts add up and sketches unite over any batches and
days, so reports read these tables and never the events.

`merge_days` adds up closed days. A reader takes what was merged, once that is committed, and the batches of all later
days; batches of merged days stay for readers at work until `merge_days` is called again.
"""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ipvigil.operators.counts import as_of
from ipvigil.sources.tables import folders, is_finished, remove_folder

#: lg of the sketches' size: relative standard error 1 / sqrt(2^LG_K) = 0.8 % (theta), about as much for HLL; exact for
#: sets of under 2^LG_K addresses (theta).
LG_K = 14
SCHEMAS = {
    "cells": "loaded_at timestamp_ntz, country_code string, category string, risk_level string, source string, n long",
    "addresses": "ip string, source string, n long",
    "sketches": "category string, ips binary, ips_hll binary",
}


def _columns(kind: str) -> list[str]:
    return [c.split(" ")[0] for c in SCHEMAS[kind].split(", ")]


def _partial(rows: DataFrame, kind: str, day: Column) -> DataFrame:
    """The partials of events, by `load_date`; combined on the map side."""
    rows = rows.withColumn("load_date", day)
    if kind == "sketches":
        ip = F.col("ip")
        made = [F.theta_sketch_agg(ip, LG_K).alias("ips"), F.hll_sketch_agg(ip, LG_K).alias("ips_hll")]
        return rows.filter(ip.isNotNull()).groupBy("load_date", "category").agg(*made)
    keys = [c for c in _columns(kind) if c != "n"]
    return rows.groupBy("load_date", *keys).agg(F.count("*").alias("n"))


def _merged(rows: DataFrame, kind: str) -> DataFrame:
    if kind == "sketches":
        made = [F.theta_union_agg("ips", LG_K).alias("ips"), F.hll_union_agg("ips_hll").alias("ips_hll")]
        return rows.groupBy("category").agg(*made)
    keys = [c for c in _columns(kind) if c != "n"]
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"))


def _side_by_side[T](spark: SparkSession, make: Callable[[str], T]) -> list[T]:
    """What `make` returns for every kind. The kinds need nothing of each other, so one's last tasks leave no cores idle.

    Each thread has its own copy of the caller's job group and other properties; an error is raised once all have ended.
    """
    with ThreadPoolExecutor(len(SCHEMAS)) as pool:
        return [made.result() for made in [pool.submit(inheritable_thread_target(spark)(make), kind) for kind in SCHEMAS]]


def write_partials(rows: DataFrame, path: str, batch_id: int, run: str) -> None:
    """Write the partials of one loaded batch (columns of the event table); writing the batch again replaces them.

    Rows of a day meet before they are written, so a batch has one file per day (more where a day is large), not one per
    task and day.
    """
    own = {"run": F.lit(run), "batch_id": F.lit(batch_id).cast("long")}

    def write(kind: str) -> None:
        made = _partial(rows, kind, F.to_date("loaded_at")).withColumns(own).hint("rebalance", "load_date")
        writer = made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("load_date", "run", "batch_id").parquet(f"{path}/{kind}")

    _side_by_side(rows.sparkSession, write)


def _finished(spark: SparkSession, path: str, kind: str) -> list[str]:
    """The days before which a merge is committed, ascending."""
    made = [f for f in folders(spark, f"{path}/{kind}_merged") if is_finished(spark, f"{path}/{kind}_merged/{f}")]
    return sorted(f.removeprefix("before=") for f in made)


def _single(spark: SparkSession, path: str, kind: str, days: list[str]) -> DataFrame:
    """The batches' own partials of some days; only columns of the files, the folders' names hold others."""
    reader = spark.read.schema(SCHEMAS[kind]).option("basePath", f"{path}/{kind}")
    return reader.parquet(*(f"{path}/{kind}/load_date={d}" for d in days)).select(*_columns(kind))


def merge_days(spark: SparkSession, path: str, before: date) -> list[str]:
    """Merge the days before `before` (which get no more batches) and drop the batches of days merged by earlier calls.

    One job per kind, whose result counts once it is committed. Returns the days that were merged.
    """

    def merge(kind: str) -> list[str]:
        last = max(_finished(spark, path, kind), default="")
        days = [f.removeprefix("load_date=") for f in folders(spark, f"{path}/{kind}")]
        wanted = [d for d in days if last <= d < before.isoformat()]
        if wanted:
            target = f"{path}/{kind}_merged/before={before.isoformat()}"
            _merged(_single(spark, path, kind, wanted), kind).write.mode("overwrite").parquet(target)
        for day in days:
            if day < last:
                remove_folder(spark, f"{path}/{kind}/load_date={day}")
        return wanted

    return sorted(set().union(*_side_by_side(spark, merge)))


def read_partials(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All partials of a kind, not yet added up."""
    merged = _finished(spark, path, kind)
    days = [f.removeprefix("load_date=") for f in folders(spark, f"{path}/{kind}")]
    days = [d for d in days if not merged or d >= merged[-1]]
    rows = spark.createDataFrame([], SCHEMAS[kind])
    for end in merged:  # each folder by itself, so its name is not read as a column
        rows = rows.unionByName(spark.read.schema(SCHEMAS[kind]).parquet(f"{path}/{kind}_merged/before={end}"))
    return rows.unionByName(_single(spark, path, kind, days)) if days else rows


def pairs(addresses: DataFrame) -> DataFrame:
    """(ip, source, n), as `operators.addresses.source_counts` counts them from events.

    Partials are combined already, so they move once, by address, which is how `stats_of` needs them, too. An address has
    a row per source, open day and batch at most.
    """
    return addresses.repartition("ip").groupBy("ip", "source").agg(F.sum("n").alias("n"))


def count_by(cells: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per value, largest first; the NULL group is kept."""
    counted = cells.groupBy(column).agg(F.sum("n").alias(name))
    return counted.orderBy(F.col(name).desc(), F.col(column).asc_nulls_first())


def throughput(cells: DataFrame, minutes: int = 10, at: datetime | None = None) -> DataFrame:
    since = as_of(cells, at) - F.expr(f"INTERVAL {minutes} MINUTES")
    recent = cells.filter(F.col("loaded_at") > since)
    return recent.agg((F.coalesce(F.sum("n"), F.lit(0)) / F.lit(float(minutes))).alias("per_minute"))


def distinct_addresses(sketches: DataFrame) -> DataFrame:
    """One row: the estimated number of addresses by theta (`ip_count`) and by HLL (`ip_count_hll`), over any days.

    Both lie within three standard errors (2.4 %) of the exact number in 997 of 1,000 cases; theta is exact for fewer than
    2^LG_K addresses. `operators.counts.distinct_values` stays the exact way.
    """
    united = sketches.agg(F.theta_union_agg("ips", LG_K).alias("t"), F.hll_union_agg("ips_hll").alias("h"))
    return united.select(F.theta_sketch_estimate("t").alias("ip_count"), F.hll_sketch_estimate("h").alias("ip_count_hll"))


def tactic_addresses(sketches: DataFrame, dim_category: DataFrame) -> DataFrame:
    """(tactic, ip_count): estimated distinct addresses over the categories of every tactic."""
    mapped = sketches.join(dim_category.select("category", "tactic"), "category").filter(F.col("tactic").isNotNull())
    united = mapped.groupBy("tactic").agg(F.theta_union_agg("ips", LG_K).alias("t"))
    return united.select("tactic", F.theta_sketch_estimate("t").alias("ip_count"))
