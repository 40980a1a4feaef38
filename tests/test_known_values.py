"""Figures of the small event table that both engines agreed on beforehand."""

import pytest
from pyspark.sql import functions as F

from ipvigil.catalog import fixtures as X
from ipvigil.operators import addresses as A
from ipvigil.operators import concentration, counts, decisions, quality
from tests.conftest import SMALL


def test_offenders(events):
    row = A.offender_totals(events).first()
    assert (row.ips, row.repeat_ips, row.cross_source_ips) == (739, 204, 169)


def test_clusters(events):
    assert A.infra_clusters(events, limit=None).count() == 151


def test_quality(events):
    row = quality.quality_counters(events).first()
    assert (row.total, row.bad_country, row.bad_score, row.exact_duplicates) == (1000, 25, 4, 4)


def test_gini(events):
    assert concentration.gini(counts.count_by(events, "country_code")).first().gini == pytest.approx(0.3200, abs=1e-4)


def test_risk_levels(events):
    found = {r.risk_level: r.n for r in counts.count_by(events, "risk_level").collect()}
    assert found == {"critical": 170, "high": 92, "medium": 196, "low": 542}


def test_latency(events):
    row = quality.latency_percentiles(events).first()
    assert (round(row.p50, 3), round(row.p95, 3)) == (154.063, 288.050)
    approximate = quality.latency_percentiles(events, approximate=True).first()
    assert approximate.p50 == pytest.approx(row.p50, rel=0.02)


def test_attribution_rules(spark, events):
    rows = X.candidates(spark, SMALL, events)
    decided = decisions.attribution(rows, events, X.reputation(rows), X.geo(rows))
    found = {r.rule: r["count"] for r in decided.groupBy("rule").count().collect()}
    assert found == {0: 50, 1: 47, 2: 156, 3: 410, 4: 219, 6: 7}
    assert decided.filter(F.col("reason") == "").count() == 0


def test_attribution_of_a_repeated_address(spark, events):
    rows = X.candidates(spark, SMALL, events)
    twice = rows.unionByName(rows.withColumn("m", F.col("m") + 1))
    once, found = (decisions.attribution(asked, events, X.reputation(rows), X.geo(rows)) for asked in (rows, twice))
    assert found.count() == once.count() == found.select("ip").distinct().count()


def test_valid_geo(events):
    assert quality.pct_valid_geo(events).first().pct_valid_geo == pytest.approx(98.0)
