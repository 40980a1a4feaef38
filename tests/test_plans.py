"""Plans keep the shape they were designed for."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from ipvigil.catalog import fixtures as X
from ipvigil.operators import addresses as A
from ipvigil.operators import counts, rankings
from ipvigil.operators.quality import throughput
from ipvigil.operators.scale import newest
from ipvigil.plans.briefing import briefing
from ipvigil.plans.health import pipeline_health
from ipvigil.plans.summary import summary
from ipvigil.sources import tables
from tests.conftest import SMALL

ROW_WORK = [
    "risk_level", "centroid", "event_time", "categories", "subnet24", "cloud_provider", "origin_verdict", "unusual_pct", "parse_message",
    "feed_tag", "new_ips_lists", "cidr_members", "attribution", "summary", "pipeline_health", "briefing", "repeat_offenders",
    "infra_clusters", "anomalies", "latency_pcts", "lorenz", "first_sighting", "dossier", "train_set", "split", "backfill",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ROW_WORK)
def test_no_python_rows_and_no_cross_joins(spark, name):
    text = plan(queries()[name](spark, SMALL))
    for bad in ("EvalPython", "FlatMapGroupsInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


@pytest.fixture
def stored(spark, events, tmp_path):
    path = str(tmp_path / "events")
    events.write.parquet(path)
    return tables.scan_events(spark, path)


def test_filters_and_columns_reach_the_scan(stored):
    text = plan(rankings.filter_history(stored, "AA", "high").select("ip"))
    assert "EqualTo(country_code,AA)" in text and "EqualTo(risk_level,high)" in text
    assert "ReadSchema: struct<ip:string,country_code:string,risk_level:string>" in text
    assert "ReadSchema: struct<country_code:string>" in plan(counts.count_by(stored, "country_code"))


def test_ranking_shuffles_narrow_rows(stored):
    text = plan(A.ip_stats(stored))
    assert "ReadSchema: struct<ip:string,source:string>" in text
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_first_n_is_trimmed_before_the_shuffle(stored):
    text = plan(A.ip_history(stored.select("ip", "loaded_at", "event_id")))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert plan(A.infra_clusters(stored)).count("FileScan") == 1


@pytest.mark.parametrize("name", ["summary", "pipeline_health", "briefing"])
def test_reports_run_nothing_while_they_are_planned(spark, stored, name):
    lookups = X.dim_category(spark), X.dim_tactic(spark)
    report = {"summary": summary, "pipeline_health": pipeline_health, "briefing": lambda e: briefing(e, None, *lookups)}[name]
    spark.sparkContext.setJobGroup(f"plan-{name}", name)
    report(stored)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"plan-{name}")
    spark.sparkContext.setJobGroup("", "")
    assert list(jobs) == []


def test_recent_reports_read_the_last_days_only(spark, events, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    path = str(tmp_path / "daily")
    daily = events.withColumn("load_date", F.to_date("loaded_at")).withColumns({"run": F.lit("r"), "batch_id": F.lit(0)})
    daily.write.partitionBy("load_date", "run", "batch_id").parquet(path)
    table = tables.scan_events(spark, path)
    assert table.columns[-1] == "load_date" and table.count() == events.count()
    for report in (counts.loaded_since(table, "24 HOURS"), newest(table, 50), throughput(table)):
        text = plan(report)
        assert re.search(r"PartitionFilters: \[[^\n]*\(load_date#\d+ >= (cast\()?Subquery", text)
    assert {r.event_id for r in newest(table, 50).collect()} == {r.event_id for r in newest(events, 50).collect()}
    assert counts.loaded_since(table, "24 HOURS").count() == counts.loaded_since(events, "24 HOURS").count()


def test_pages_are_found_by_a_bounded_sort(stored):
    assert "TakeOrderedAndProject" in plan(A.repeat_offenders(stored))
    assert "TakeOrderedAndProject" in plan(rankings.history_page(stored))
