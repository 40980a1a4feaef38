import random

import pytest
from pyspark.sql import functions as F

from ipvigil.constants import TEXT_FEEDS
from ipvigil.operators import addresses as A
from ipvigil.operators import enrich
from ipvigil.sources import exports, feeds


def test_text_lists_are_read_in_line_order(spark, tmp_path):
    lines = ["# header", "", "  1.1.1.2  # seen twice", "1.1.1.1", "\t1.1.1.3;x y", "   ", "#1.1.1.9", "1.1.1.2"]
    (tmp_path / "ssh.txt").write_text("\r\n".join(lines) + "\r\n")
    read = feeds.read_list(spark, str(tmp_path / "ssh.txt"), "blocklistde", "ssh").orderBy("pos")
    assert [r.ip for r in read.collect()] == ["1.1.1.2", "1.1.1.1", "1.1.1.3;x", "1.1.1.2"]
    tagged = feeds.tag(read, feeds.feed_table(spark, TEXT_FEEDS)).collect()
    assert {(r.category, r.abuse_confidence_score) for r in tagged} == {("SSH", 85.0)}


def test_positions_hold_over_splits(spark, tmp_path):
    count = 20_000
    (tmp_path / "big.txt").write_text("\n".join(f"10.{i // 65536}.{i // 256 % 256}.{i % 256}" for i in range(count)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = feeds.read_list(spark, str(tmp_path / "big.txt"), "s", "l")
        assert read.rdd.getNumPartitions() > 3
        none = spark.createDataFrame([], "ip string")
        assert [r.ip for r in feeds.new_ips(read, none, 300).collect()] == [f"10.0.{i // 256}.{i % 256}" for i in range(300)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bulk_payload(spark, tmp_path):
    (tmp_path / "bulk.json").write_text(
        '{"data": [{"ipAddress": "1.1.1.1", "countryCode": "US", "abuseConfidenceScore": 100, "lastReportedAt": "t"},'
        '\n {"ipAddress": "1.1.1.2", "abuseConfidenceScore": 24}, {"ipAddress": "1.1.1.3", "abuseConfidenceScore": 25}]}'
    )
    rows = feeds.read_bulk(spark, str(tmp_path / "bulk.json"), 1704067200.0).orderBy("ip").collect()
    assert [(r.ip, r.country_code, r.abuse_confidence_score, r.source, r.category) for r in rows] == [
        ("1.1.1.1", "US", 100.0, "abuseipdb", None),
        ("1.1.1.3", None, 25.0, "abuseipdb", None),
    ]


def greedy(entries, known, caps):
    seen, out = set(known), []
    for priority, cap in enumerate(caps, 1):
        taken = 0
        for ip in (e[0] for e in sorted(entries, key=lambda e: e[2]) if e[1] == priority):
            if taken == cap:
                break
            if ip in seen:
                continue
            seen.add(ip)
            out.append((ip, priority))
            taken += 1
    return sorted(out)


@pytest.mark.parametrize("caps", [[4] * 5, [1, 9, 2, 3, 5], [40]])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_new_ips_by_list_equals_the_greedy_walk(spark, caps, seed):
    rng = random.Random(seed)
    entries = [(f"10.0.0.{rng.randrange(60)}", rng.randrange(1, len(caps) + 1), pos) for pos in range(300)]
    known = [f"10.0.0.{i}" for i in range(0, 60, 9)]
    frame = spark.createDataFrame(entries, "ip string, priority int, pos bigint")
    found = feeds.new_ips_by_list(frame, spark.createDataFrame([(k,) for k in known], "ip string"), caps)
    assert sorted((r.ip, r.priority) for r in found.collect()) == greedy(entries, known, caps)


def test_new_ips_without_candidates(spark):
    frame = spark.createDataFrame([("1.1.1.1", 1, 1)], "ip string, priority int, pos bigint")
    assert feeds.new_ips_by_list(frame, frame.select("ip"), [40] * 5).count() == 0
    assert feeds.new_ips(frame, frame.select("ip")).count() == 0


def test_union_of_feeds_has_message_columns(spark):
    a = spark.createDataFrame([("1.1.1.1", "a")], "ip string, source string")
    b = spark.createDataFrame([("b", 3.0, "1.1.1.2")], "source string, abuse_confidence_score double, ip string")
    rows = feeds.union_feeds(a, b).orderBy("ip").collect()
    assert [(r.ip, r.source, r.abuse_confidence_score, r.category) for r in rows] == [
        ("1.1.1.1", "a", None, None), ("1.1.1.2", "b", 3.0, None),
    ]


def test_update_fills_missing_values_only(spark):
    rows = spark.createDataFrame([(1, None), (2, 0.5), (3, None)], "event_id bigint, s double")
    updates = spark.createDataFrame([(1, 0.9), (2, 0.1)], "event_id bigint, s double")
    found = {r.event_id: r.s for r in enrich.keyed_update(rows, updates, "event_id", "s").collect()}
    assert found == {1: 0.9, 2: 0.5, 3: None}


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "1.1.1.1", "a", 95.0, "US", "t"), (2, "1.1.1.1", "b", 95.0, "US", "t"), (3, "1.1.1.2", "a", 1.0, None, "t"),
         (4, "1.1.1.2", "a", 1.0, None, "t"), (5, "1.1.1.3", "a", 1.0, None, "t")],
        "event_id bigint, ip string, source string, abuse_confidence_score double, country_code string, last_reported_at string",
    )
    offenders = A.ip_stats(rows).filter("reports > 1")
    exports.write_blocklist(offenders, str(tmp_path / "deny"), "nginx")
    assert lines_of(tmp_path / "deny" / "header")[0].startswith("#")
    assert lines_of(tmp_path / "deny" / "rules") == ["deny 1.1.1.1;", "deny 1.1.1.2;"]
    exports.write_blocklist(offenders, str(tmp_path / "shell"), "iptables")
    assert lines_of(tmp_path / "shell" / "header")[0] == "#!/bin/sh"
    assert lines_of(tmp_path / "shell" / "rules")[0] == "iptables -A INPUT -s 1.1.1.1 -j DROP"
    exports.write_subnets(A.cluster_sizes(rows), str(tmp_path / "blocks"))
    assert lines_of(tmp_path / "blocks" / "rules") == ["deny 1.1.1.0/24;"]


def test_exports_hold_all_rows_in_order(spark, tmp_path):
    rows = spark.range(3000, numPartitions=5).selectExpr("concat('ip', lpad(id * 7 % 3000, 4, '0')) AS ip", "id % 50 AS reports", "id % 3 AS sources")
    exports.write_blocklist(rows, str(tmp_path / "all"))
    want = [f"deny {r.ip};" for r in sorted(rows.collect(), key=lambda r: (-r.sources, -r.reports, r.ip))]
    assert lines_of(tmp_path / "all" / "rules") == want


def lines_of(folder):
    """Lines of an export's files in the order of their names."""
    return [line for f in sorted(folder.glob("part-*")) for line in f.read_text().splitlines()]


def test_feed_csv_quotes(spark, tmp_path):
    feed = spark.createDataFrame([(1, 'a"b', None, "low", "t")], "event_id bigint, ip string, country_code string, risk_level string, event_time string")
    assert exports.feed_csv_lines(feed).first().line == '"a""b","","low","t"'
    exports.write_feed_csv(feed, str(tmp_path / "csv"))
    written = [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()]
    assert written == ['"ip","country_code","risk_level","timestamp"', '"a""b","","low","t"']


def test_location_fallback(spark):
    events = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0), ("c", 1.0, 2.0), ("d", 1.0, 2.0)], "ip string, latitude double, longitude double")
    geo = spark.createDataFrame(
        [("a", "success", 9.0, 8.0, "X", "US"), ("b", "fail", 9.0, 8.0, "X", "US"), ("c", "success", None, 8.0, "X", "US")],
        "ip string, status string, lat double, lon double, city string, countryCode string",
    )
    found = {r.ip: (r.latitude, r.longitude, r.city) for r in enrich.refine_location(events, geo).collect()}
    assert found == {"a": (9.0, 8.0, "X"), "b": (1.0, 2.0, None), "c": (1.0, 2.0, None), "d": (1.0, 2.0, None)}
    countries = enrich.fill_country(events.withColumn("country_code", F.lit(None).cast("string")), geo)
    assert {r.ip: r.country_code for r in countries.collect()} == {"a": "US", "b": None, "c": "US", "d": None}
