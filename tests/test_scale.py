"""Operators under skew, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ipvigil.operators import addresses as A
from ipvigil.operators import concentration, counts
from ipvigil.operators.scale import SCORE_WIDTHS, exact_percentiles, latest_per_key, newest, top_n_per_key, uniform_sample


@pytest.fixture(scope="module")
def skewed(spark):
    """9,000 rows over 1,500 addresses; one address holds a third, loaded in few batches so times tie."""
    hot = F.col("id") % 3 == 0
    return spark.range(9000, numPartitions=6).select(
        F.col("id").alias("event_id"),
        F.when(hot, F.lit("10.0.0.1")).otherwise(F.concat(F.lit("10.1."), (F.col("id") % 1500 / 250).cast("int").cast("string"), F.lit("."), (F.col("id") % 250).cast("string"))).alias("ip"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id % 37 AS INT) * 5)").alias("loaded_at"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("source"),
        (F.col("id") % 101).cast("double").alias("abuse_confidence_score"),
        F.when(F.col("id") % 7 > 0, F.lit("US")).alias("country_code"),
        F.lit("2024-01-01").alias("last_reported_at"),
        F.when(F.col("id") % 2 == 0, F.col("id") / 9000.0).alias("reoffense_probability"),
    )


def test_latest_answer_per_key(spark):
    rows = [("a", "old", "2024-01-01"), ("a", "new", "2024-03-01"), ("a", "mid", "2024-02-01"), ("b", None, None), (None, "x", "2024-01-01")]
    found = latest_per_key(spark.createDataFrame(rows, "k string, v string, landed_at string"), "k").collect()
    assert sorted((r.k, r.v) for r in found) == [("a", "new"), ("b", None)]
    untimed = latest_per_key(spark.createDataFrame([("a", 1), ("a", 5)], "k string, v int"), "k").collect()
    assert [(r.k, r.v) for r in untimed] == [("a", 5)]


def test_newest_rows_per_address_of_a_hot_address(skewed):
    rows = skewed.select("event_id", "ip", "loaded_at").toPandas()
    rows = rows.sort_values(["ip", "loaded_at", "event_id"], ascending=[True, False, False])
    expected = {(r.ip, r.event_id) for r in rows.groupby("ip").head(50).itertuples()}
    found = A.ip_history(skewed).collect()
    assert {(r.ip, r.event_id) for r in found} == expected
    assert len(found) == len(expected)
    hot = sorted((r for r in found if r.ip == "10.0.0.1"), key=lambda r: r["rank"])
    assert [r["rank"] for r in hot] == list(range(1, 51))
    assert hot == sorted(hot, key=lambda r: (r.loaded_at, r.event_id), reverse=True)


def test_top_n_keeps_rows_without_a_key(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a")], "event_id bigint, k string")
    found = top_n_per_key(rows, "k", [F.col("event_id")], 1, "event_id")
    assert sorted((r.k or "", r.event_id) for r in found.collect()) == [("", 1), ("a", 3)]


def test_newest_with_ties_and_missing_times(skewed):
    rows = skewed.withColumn("loaded_at", F.when(F.col("event_id") != 5, F.col("loaded_at")))
    found = [(r.loaded_at, r.event_id) for r in newest(rows, 600).collect()]
    every = [(r.loaded_at, r.event_id) for r in rows.select("loaded_at", "event_id").collect()]
    expected = sorted(every, key=lambda r: (r[0] is None, r[0], r[1]) if r[0] else (True, None, r[1]), reverse=True)[:600]
    assert found == expected


def test_newest_of_fewer_rows(skewed):
    assert newest(skewed, 100_000).count() == 9000


def test_uniform_sample_is_exact_and_repeatable(skewed):
    first = {r.event_id for r in uniform_sample(skewed, "event_id", 500, 1).collect()}
    assert len(first) == 500
    assert first == {r.event_id for r in uniform_sample(skewed.repartition(3), "event_id", 500, 1).collect()}
    assert first != {r.event_id for r in uniform_sample(skewed, "event_id", 500, 2).collect()}
    assert 4000 < np.mean(list(first)) < 5000
    assert uniform_sample(skewed, "event_id", 20_000, 1).count() == 9000


@pytest.mark.parametrize("kind", ["spread", "one value", "hot value", "negative", "single row"])
def test_exact_percentiles(spark, kind):
    rng = random.Random(3)
    values = {
        "spread": [rng.randrange(10**9) for _ in range(4000)],
        "one value": [77] * 1000,
        "hot value": [5] * 1500 + [rng.randrange(10**7) for _ in range(1500)],
        "negative": [rng.randrange(-(10**8), 10**8) for _ in range(1001)],
        "single row": [123456789],
    }[kind]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v bigint")
    shares = [0.0, 0.02, 0.5, 0.95, 1.0]
    found = {r.share: (r.value, r.n) for r in exact_percentiles(frame, "v", shares, (10**8, 10**4)).collect()}
    for share in shares:
        assert found[share][0] == pytest.approx(np.percentile(values, share * 100), rel=1e-12, abs=1e-6)
        assert found[share][1] == len(values)


def test_exact_percentiles_of_nothing(spark):
    assert exact_percentiles(spark.createDataFrame([], "v bigint"), "v", [0.5], (1000,)).collect() == []


def test_exact_percentiles_of_scores(spark):
    rng = random.Random(5)
    values = [-rng.random() for _ in range(2000)] + [-0.25] * 1000 + [-0.25 - 1e-9]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    shares = [i / 100 for i in range(101)]
    found = {r.share: r.value for r in exact_percentiles(frame, "v", shares, SCORE_WIDTHS).collect()}
    assert [found[s] for s in shares] == pytest.approx(np.percentile(values, [s * 100 for s in shares]).tolist(), abs=1e-12)


def test_pages_end_and_continue(skewed):
    with pytest.raises(ValueError):
        A.repeat_offenders(skewed, page=1_000_000)
    pages = [r for p in (1, 2, 3) for r in A.repeat_offenders(skewed, p, 7).collect()]
    last = pages[6]
    after = A.repeat_offenders(skewed, page_size=14, after=(last.source_count, last.report_count, last.ip)).collect()
    assert after == pages[7:]


def test_ranges_of_both_families(spark):
    ranges = ["2001:db8::/32", "::/0", "10.0.0.0/8", "2001:db8::1", "fe80::/10", "0.0.0.0/0", "bad/9", "1::2::3/4", "10.0.0.0/33", "::1/129"]
    ips = ["2001:DB8::1", "2001:db8:0:0:0:0:0:1", "2001:db9::", "10.2.3.4", "febf::1", "::1", "no", "1:2:3", None]
    found = A.cidr_members(
        spark.createDataFrame([(i,) for i in ips], "ip string"), spark.createDataFrame([(r,) for r in ranges], "cidr string")
    )
    import ipaddress

    want = set()
    for ip in ips[:6]:
        for r in ranges[:6]:
            net = ipaddress.ip_network(r)
            if ipaddress.ip_address(ip).version == net.version and ipaddress.ip_address(ip) in net:
                want.add((ip, r))
    assert {(r.ip, r.cidr) for r in found.collect()} == want


def brute_gini(counts_):
    x = sorted(counts_)
    n, s = len(x), sum(x)
    if not n or not s:
        return 0.0
    return 2 * sum(i * v for i, v in enumerate(x, 1)) / (n * s) - (n + 1) / n


@pytest.mark.parametrize(
    "sizes", [[], [0, 0, 0], [4, 4, 4], [0, 0, 0, 100], [1, 2, 3, 4, 5, 5, 5, 90], [7], list(range(1, 200)) * 3]
)
def test_gini_and_lorenz(spark, sizes):
    frame = spark.createDataFrame([(v,) for v in sizes], "n bigint")
    found = concentration.gini(frame).first()
    assert found.gini == pytest.approx(brute_gini(sizes), abs=1e-12)
    assert 0 <= found.gini <= 1
    points = sorted((r.position, r.pct_groups, r.pct_events) for r in concentration.lorenz(frame).collect())
    if not sum(sizes):
        assert points == []
        return
    assert points[0] == (0, 0.0, 0.0)
    assert points[-1][1:] == (100.0, 100.0)
    running = np.cumsum(sorted(sizes)) / sum(sizes) * 100
    assert [p[2] for p in points[1:]] == pytest.approx(list(running))
    assert [p[0] for p in points] == list(range(len(sizes) + 1))


def test_even_spread_has_no_concentration(spark):
    assert concentration.gini(spark.createDataFrame([(4,)] * 5, "n bigint")).first().gini == pytest.approx(0.0)
    assert concentration.gini(spark.createDataFrame([(0,), (0,), (0,), (100,)], "n bigint")).first().gini > 0.7


def test_pages_join_to_the_whole_ranking(skewed):
    pages = [r.ip for p in range(1, 5) for r in A.repeat_offenders(skewed, page=p, page_size=100).collect()]
    stats = A.ip_stats(skewed).filter("reports > 1").collect()
    expected = [r.ip for r in sorted(stats, key=lambda r: (-r.sources, -r.reports, r.ip))][:400]
    assert pages == expected


def test_page_size_is_bounded(skewed):
    assert A.repeat_offenders(skewed, page=0, page_size=1000).count() == 100
    assert A.repeat_offenders(skewed, page=1, page_size=0).count() == 1


def test_clusters_match_brute_force(skewed):
    rows = skewed.select("ip", "source", "abuse_confidence_score", "country_code").collect()
    blocks = {}
    for r in rows:
        blocks.setdefault(r.ip.rsplit(".", 1)[0] + ".0/24", []).append(r)
    expected = {}
    for subnet, inside in blocks.items():
        ips = sorted({r.ip for r in inside})
        if len(ips) >= 3:
            expected[subnet] = (len(ips), ips[:8], sorted({r.source for r in inside}), max(r.abuse_confidence_score for r in inside))
    found = {r.subnet: (r.ip_count, r.sample_ips, r.sources, r.max_score) for r in A.infra_clusters(skewed, limit=None).collect()}
    assert found == expected
    top = [r.subnet for r in A.infra_clusters(skewed, limit=2).collect()]
    assert top == [s for s, v in sorted(expected.items(), key=lambda kv: (-kv[1][0], kv[0]))][:2]


def test_text_that_is_no_address(spark, skewed):
    assert A.history_of(skewed, "not an address").count() == 0
    odd = spark.createDataFrame([("::1",), ("x",), ("300.1.1.1",)], "ip string")
    ranges = spark.createDataFrame([("0.0.0.0/0",), ("bad",), ("1.2.3.4/40",)], "cidr string")
    assert A.cidr_members(odd, ranges).count() == 0


def test_cidr_members_match_the_ranges(spark):
    import ipaddress

    rng = random.Random(5)
    ips = [str(ipaddress.ip_address(rng.randrange(2**32))) for _ in range(200)] + ["10.0.0.1", "10.0.0.5", "255.255.255.255", "0.0.0.0"]
    cidrs = ["0.0.0.0/0", "10.0.0.0/8", "10.0.0.0/30", "10.0.0.5", "10.0.0.4/31", "128.0.0.0/1", "255.255.255.255/32", "10.0.0.7/24"]
    found = A.cidr_members(
        spark.createDataFrame([(i,) for i in ips], "ip string"), spark.createDataFrame([(c,) for c in cidrs], "cidr string")
    ).collect()
    nets = {c: ipaddress.ip_network(c, strict=False) for c in cidrs}
    expected = sorted((i, c) for i in set(ips) for c, net in nets.items() if ipaddress.ip_address(i) in net)
    assert sorted((r.ip, r.cidr) for r in found) == expected


def test_first_sighting_breaks_ties_by_row(skewed):
    rows = skewed.select("ip", "loaded_at", "event_id", "source")
    pdf = rows.toPandas().sort_values(["ip", "loaded_at", "event_id"])
    expected = {r.ip: r.event_id for r in pdf.groupby("ip").head(1).itertuples()}
    assert {r.ip: r.event_id for r in A.first_sighting(rows).collect()} == expected


def test_top_k_share_sums_to_the_whole(skewed):
    sized = skewed.groupBy("ip").agg(F.count("*").alias("n"))
    rows = counts.top_k_share(sized, "ip").collect()
    assert [r.position for r in rows] == [1, 2, 3, 4, 5, 6]
    assert rows[0].grp == "10.0.0.1" and rows[-1].grp == "Other"
    assert sum(r.pct for r in rows) == pytest.approx(100.0)
    few = counts.top_k_share(sized.limit(2), "ip").collect()
    assert len(few) == 2


def test_reports_on_an_empty_table(skewed):
    none = skewed.filter("false")
    assert A.repeat_offenders(none).count() == 0
    assert A.infra_clusters(none).count() == 0
    assert counts.count_by(none, "source").count() == 0
    assert A.offender_totals(none).first().repeat_ips == 0
