import math

import pytest
from pyspark.sql import functions as F

from ipvigil.catalog.fixtures import CATEGORY_NAMES
from ipvigil.functions import columns as C
from ipvigil.operators import enrich, rankings


def one(spark, column, **values):
    names = {"s": "string", "d": "double", "b": "boolean", "l": "bigint"}
    ddl = ", ".join(f"{n} {names[n[0]]}" for n in values) or "x int"
    row = tuple(values.values()) or (1,)
    return spark.createDataFrame([row], ddl).select(column.alias("out")).first().out


@pytest.mark.parametrize(
    "score, level",
    [(None, "low"), (math.nan, "low"), (39.9, "low"), (40.0, "medium"), (70.0, "high"), (90.0, "critical"), (150.0, "critical")],
)
def test_risk_level(spark, score, level):
    assert one(spark, C.risk_level("d"), d=score) == level


def test_event_time_drops_fractions_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            text = one(spark, C.event_time("d").cast("string"), d=1704067207.9)
            assert text == "2024-01-01 00:00:07"
        assert one(spark, C.event_time("d"), d=None) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("category, expected", [(None, []), ("", []), ("SSH", ["SSH"])])
def test_categories(spark, category, expected):
    assert one(spark, C.categories("s"), s=category) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("1.2.3.4", True), ("999.1.2.3", True), ("1.2.3.4\n", False), ("1.2.3", False), ("::1", False), ("a1.2.3.4", False)],
)
def test_is_ipv4(spark, text, expected):
    assert one(spark, C.is_ipv4("s"), s=text) is expected


@pytest.mark.parametrize(
    "text, expected",
    [("0.0.0.0", 0), ("255.255.255.255", 2**32 - 1), ("1.2.3.4", 16909060), ("1.2.3.256", None), ("1.2.3", None),
     ("1.2.3.4.5", None), ("::1", None), ("not an address", None), (None, None), ("1.2.3.99999999999999999999", None)],
)
def test_ip_to_long(spark, text, expected):
    assert one(spark, C.ip_to_long("s"), s=text) == expected


BREAKS = [-0.6 + i * 0.003 for i in range(101)]


@pytest.mark.parametrize(
    "score, expected", [(None, None), (-0.7, 100), (-0.1, 0), (BREAKS[0], 99), (BREAKS[49], 50), (BREAKS[50] + 0.001, 49)]
)
def test_unusual_pct(spark, score, expected):
    assert one(spark, C.unusual_pct("d", BREAKS), d=score) == expected


@pytest.mark.parametrize("breaks", [None, []])
def test_unusual_pct_without_model(spark, breaks):
    assert one(spark, C.unusual_pct("d", breaks), d=-0.5) is None


def test_rarest_label(spark):
    assert one(spark, C.rarest_pct_label("l"), l=99) == 1
    assert one(spark, C.rarest_pct_label("l"), l=100) == 1
    assert one(spark, C.rarest_pct_label("l"), l=60) == 40


@pytest.mark.parametrize("part, whole, text", [(1, 8, "12.5"), (1, 3, "33.3"), (2, 3, "66.7"), (1, 1000, "0.1"), (35, 10000, "0.4"), (0, 5, "0.0")])
def test_tenths(spark, part, whole, text):
    assert one(spark, C.tenths_text(F.col("l1"), F.col("l2")), l1=part, l2=whole) == text


def test_safe_ratios(spark):
    assert one(spark, C.safe_pct("l1", "l2"), l1=5, l2=0) == 0.0
    assert one(spark, C.safe_pct("l1", "l2"), l1=1, l2=4) == 25.0
    assert one(spark, C.safe_rate("l1", "d2"), l1=5, d2=0.0) is None


@pytest.mark.parametrize("failed, total, status", [(0, 0, "pass"), (0, 10, "pass"), (1, 1000, "warn"), (1, 100, "fail"), (10, 10, "fail")])
def test_check_status(spark, failed, total, status):
    assert one(spark, C.check_status("l1", "l2"), l1=failed, l2=total) == status


@pytest.mark.parametrize("current, previous, delta", [(0.5, None, None), (0.5, 0.46, None), (0.5, 0.4, 0.1), (0.4, 0.5, -0.1)])
def test_trend_delta(spark, current, previous, delta):
    assert one(spark, C.trend_delta("d1", "d2"), d1=current, d2=previous) == delta


@pytest.mark.parametrize("first, last, scale, expected", [(0.5, 0.503, 100, "stable"), (0.5, 0.51, 100, "rising"), (0.5, 0.4, 100, "falling"), (None, 1.0, 1, "rising")])
def test_trend_direction(spark, first, last, scale, expected):
    assert one(spark, C.trend_direction("d1", "d2", scale), d1=first, d2=last) == expected


@pytest.mark.parametrize("urgent, total, tone", [(0, 3, "green"), (1, 4, "amber"), (1, 2, "red"), (0, 0, "green")])
def test_posture(spark, urgent, total, tone):
    assert one(spark, C.posture("l1", "l2"), l1=urgent, l2=total) == tone


@pytest.mark.parametrize(
    "text, provider",
    [("AS16509 Amazon.com, Inc.", "AWS"), ("AS15169 GOOGLE", "Google Cloud"), ("AS16276 OVH SAS", "OVH"), ("Novhost", None),
     ("AS8075 Azure via Google", "Google Cloud"), ("", None), (None, None)],
)
def test_cloud_provider(spark, text, provider):
    assert one(spark, C.cloud_provider("s"), s=text) == provider


@pytest.mark.parametrize(
    "flags, kind",
    [((True, True, True, True), "tor"), ((False, True, True, True), "proxy"), ((None, None, True, True), "hosting"),
     ((None, None, None, True), "mobile"), ((None, None, None, None), "residential")],
)
def test_origin(spark, flags, kind):
    assert one(spark, C.origin("b1", "b2", "b3", "b4"), b1=flags[0], b2=flags[1], b3=flags[2], b4=flags[3]) == kind


def test_risk_factors_keep_two_in_order(spark):
    factors = C.risk_factors("s1", "s2", "d", "s3", bulk_source="bulk")
    assert one(spark, factors, s1="bulk", s2=None, d=95.0, s3="critical") == ["bulk feed without category", "top score"]
    assert one(spark, factors, s1="other", s2="SSH", d=75.0, s3="high") == ["risk high"]
    assert one(spark, factors, s1=None, s2=None, d=None, s3=None) == []


def test_category_names(spark):
    reports = [[5, 24, 1]] + [[1, 2]] * 9 + [[3]]
    frame = spark.createDataFrame([([{"categories": c} for c in reports],), (None,)], "r array<struct<categories:array<int>>>")
    rows = [r.n for r in frame.select(C.category_names("r", CATEGORY_NAMES).alias("n")).collect()]
    assert rows == [["C05", "C01", "C02"], []]


def test_country_filter_text():
    assert C.country_filter("usa") == "US"


def test_cidr_reports_with_missing_fields(spark):
    ddl = (
        "data struct<networkAddress:string, netmask:string, reportedAddress:array<struct<ipAddress:string,"
        "abuseConfidenceScore:double,numReports:bigint,mostRecentReport:string>>>"
    )
    rows = [
        (("10.0.0.0", "255.255.255.0", [("10.0.0.1", 80.0, 3, "t"), ("10.0.0.2", None, None, None)]),),
        (("10.0.1.0", "255.255.255.0", []),),
        (("10.0.2.0", "255.255.255.0", None),),
    ]
    found = enrich.project_cidr_reports(spark.createDataFrame(rows, ddl)).orderBy("ip").collect()
    assert [(r.ip, r.abuse_confidence_score, r.total_reports) for r in found] == [("10.0.0.1", 80.0, 3), ("10.0.0.2", None, None)]


def rarity_of(spark, rows):
    ddl = "event_id bigint, source string, country_code string, category string"
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ddl)
    return {r.event_id: r for r in rankings.rarity(frame, frame).collect()}


def test_rarity_common_values_give_no_reason(spark):
    assert all(r.why is None for r in rarity_of(spark, [("a", "US", "SSH")] * 10).values())


def test_rarity_names_the_rarest_field(spark):
    found = rarity_of(spark, [("a", "US", "SSH")] * 99 + [("a", "FR", "SSH")])
    assert (found[99].rare_label, found[99].rare_value, found[99].why) == ("country", "FR", "country FR in 1.0% of events")
    assert found[0].why is None


def test_rarity_uncategorised_and_tiny(spark):
    found = rarity_of(spark, [("a", "US", "SSH")] * 1999 + [("a", "US", None)])
    assert found[1999].why == "category uncategorized in <0.1% of events"


def test_rarity_without_events(spark):
    ddl = "event_id bigint, source string, country_code string, category string"
    row = spark.createDataFrame([(1, "a", "US", None)], ddl)
    assert rankings.rarity(row, row.filter("false")).first().why is None
