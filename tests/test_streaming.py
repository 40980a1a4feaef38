"""Streams give what the same rows give in one batch, however they are cut and however often they come."""

import json
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ipvigil.operators.enrich import enrich
from ipvigil.schema import DIM_COUNTRY, EVENT_COLUMNS, THREAT_EVENTS, conform
from ipvigil.sources import messages, tables
from ipvigil.streaming import jobs

MESSAGES = [
    {"ip": "1.1.1.1", "country_code": "US", "abuse_confidence_score": 95.0, "last_reported_at": "2024-01-01", "source": "a",
     "ingested_at": 1704067200.75, "category": "SSH"},
    {"ip": "1.1.1.2", "country_code": "XX", "abuse_confidence_score": 70.0, "last_reported_at": "2024-01-01", "source": "a",
     "ingested_at": 1704067201.0, "category": ""},
    {"ip": "1.1.1.3", "country_code": None, "abuse_confidence_score": None, "source": "b", "ingested_at": 1704067202.5},
    {"ip": "1.1.1.4", "country_code": "FR", "abuse_confidence_score": 40.0, "last_reported_at": "2024-01-02", "source": "b",
     "ingested_at": 1704067203.0, "category": None},
]
BROKEN = ['{"ip": "9.9.9.9", "coun', "not json"]


@pytest.fixture(scope="module")
def countries(spark):
    return spark.createDataFrame([("US", 38.0, -97.0, "United States"), ("FR", 46.0, 2.0, "France")], DIM_COUNTRY)


@pytest.fixture
def topic(tmp_path):
    """Three files, so three micro-batches with maxFilesPerTrigger=1."""
    folder = tmp_path / "topic"
    folder.mkdir()
    lines = [json.dumps(m) for m in MESSAGES]
    for i, part in enumerate([lines[:2], BROKEN + lines[2:3], lines[3:]]):
        (folder / f"part-{i}.txt").write_text("\n".join(part) + "\n")
    return str(folder)


def stream(spark, topic, countries, **options):
    return jobs.enriched_stream(messages.bus(spark, "text", path=topic, maxFilesPerTrigger="1"), countries, **options)


def keyed(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def test_parsing_modes(spark, topic):
    raw = messages.bus(spark, "text", streaming=False, path=topic)
    assert messages.valid(messages.parse_message(raw)).count() == 4
    kept = messages.parse_message(raw, on_malformed="keep")
    assert kept.count() == 6
    assert kept.filter("ip IS NULL AND source IS NULL").count() == 2
    assert sorted(r.value for r in messages.quarantined(messages.parse_message(raw)).collect()) == sorted(BROKEN)


def test_malformed_messages_become_low_risk_rows_if_kept(spark, topic, countries):
    raw = messages.bus(spark, "text", streaming=False, path=topic)
    rows = enrich(messages.parse_message(raw, on_malformed="keep"), countries).filter("ip IS NULL").collect()
    assert [(r.risk_level, r.latitude, r.longitude, r.categories) for r in rows] == [("low", 0.0, 0.0, [])] * 2


def test_enriched_columns(spark, topic, countries):
    raw = messages.bus(spark, "text", streaming=False, path=topic)
    rows = {r.ip: r for r in jobs.enriched_stream(raw, countries).collect()}
    assert (rows["1.1.1.1"].risk_level, rows["1.1.1.1"].latitude, rows["1.1.1.1"].categories) == ("critical", 38.0, ["SSH"])
    assert str(rows["1.1.1.1"].event_time) == "2024-01-01 00:00:00"
    assert (rows["1.1.1.2"].risk_level, rows["1.1.1.2"].latitude, rows["1.1.1.2"].categories) == ("high", 0.0, [])
    assert (rows["1.1.1.3"].risk_level, rows["1.1.1.3"].longitude) == ("low", 0.0)
    assert rows["1.1.1.4"].risk_level == "medium"


def test_table_sink_equals_the_batch_and_survives_replay(spark, topic, countries, tmp_path):
    table, metrics, bus = (str(tmp_path / n) for n in ("table", "metrics", "bus"))
    events = stream(spark, topic, countries)
    jobs.start_table_sink(events, table, metrics, str(tmp_path / "state"), bus=bus, interval=None).awaitTermination()
    once = messages.valid(jobs.enriched_stream(messages.bus(spark, "text", streaming=False, path=topic), countries))
    expected = keyed(once.select(*EVENT_COLUMNS).collect())
    loaded = tables.scan_events(spark, table)
    assert keyed(loaded.select(*EVENT_COLUMNS).collect()) == expected
    assert loaded.filter("reoffense_probability IS NOT NULL OR anomaly_score IS NOT NULL").count() == 0
    logged = {r.batch_id: r.batch_rows for r in jobs.read_metrics(spark, metrics).collect()}
    assert sorted(logged.values()) == [1, 1, 2] and set(logged) == {0, 1, 2}
    assert sorted(r.malformed_rows for r in jobs.read_metrics(spark, metrics).collect()) == [0, 0, 2]
    assert sorted(r.value for r in spark.read.parquet(f"{table}_quarantine").collect()) == sorted(BROKEN)
    sent = spark.read.parquet(bus)
    assert sent.filter("key IS NOT NULL").count() == 4
    assert sorted(json.loads(r.value)["malformed"] for r in sent.filter("key IS NULL").collect()) == sorted(BROKEN)
    assert sorted(r.event_id for r in loaded.select("event_id").collect()) == [0, 1, 2, 3]
    run = tables.folders(spark, metrics)[0].removeprefix("run=")

    # a completed batch that comes again changes nothing
    again = once.limit(1)
    jobs.load_batch(again, 1, run, table, metrics)
    assert keyed(tables.scan_events(spark, table).select(*EVENT_COLUMNS).collect()) == expected

    # an unfinished batch (rows written, no metrics row) is replaced
    day = tables.start_of(spark, f"{metrics}_started", 3, run, 1)[0].date()
    tables.write_batch(loaded.drop("load_date").limit(3), table, 3, run, day)
    jobs.load_batch(again, 3, run, table, metrics)
    assert tables.scan_events(spark, table).count() == 5
    assert tables.scan_events(spark, table, since=datetime(2024, 1, 1)).count() == 5
    later = tables.scan_events(spark, table, since=datetime(2999, 1, 1))
    assert later.count() == 0
    assert re.search(r"PartitionFilters: \[[^\n]*load_date#\d+ >= ", later._jdf.queryExecution().executedPlan().toString())
    # a restarted stream has nothing left to do; one with a new checkpoint loads everything, under new ids
    jobs.start_table_sink(events, table, metrics, str(tmp_path / "state"), interval=None).awaitTermination()
    assert tables.scan_events(spark, table).count() == 5
    jobs.start_table_sink(events, table, metrics, str(tmp_path / "state-2"), interval=None).awaitTermination()
    ids = sorted(r.event_id for r in tables.scan_events(spark, table).collect())
    assert ids == list(range(9))

    # days that are over become one folder each, once
    before = keyed(tables.scan_events(spark, table).collect())
    assert len(tables.compact_days(spark, table, date(9999, 1, 1))) == 1
    assert tables.compact_days(spark, table, date(9999, 1, 1)) == []
    assert keyed(tables.scan_events(spark, table).collect()) == before


def test_one_query_feeds_table_and_bus_format(spark, topic, countries, tmp_path):
    base = str(tmp_path)
    bus = {"format": "json", "path": f"{base}/bus"}
    jobs.start_table_sink(stream(spark, topic, countries), f"{base}/t", f"{base}/m", f"{base}/s", bus=bus, interval=None).awaitTermination()
    assert spark.read.schema("key string, value string").json(f"{base}/bus").count() == 6
    assert tables.scan_events(spark, f"{base}/t").count() == 4


def test_batches_started_at_the_same_moment_get_other_ids(spark, tmp_path, monkeypatch):
    log, put, inner = str(tmp_path / "log"), tables.put_text, []

    def interleaved(session, path, text, replace=False):
        if "_chain" in path and not inner:  # run "b" has read the chain; before it puts its link, "a" reserves all it needs
            inner.append(None)
            inner[0] = tables.start_of(spark, log, 0, "a", 5)
        return put(session, path, text, replace)

    monkeypatch.setattr(tables, "put_text", interleaved)
    first = tables.start_of(spark, log, 0, "b", 10)
    assert inner[0][1] == 0 and first[1] == 5
    assert tables.start_of(spark, log, 0, "b", 10) == first and tables.start_of(spark, log, 0, "a", 5) == inner[0]
    assert tables.start_of(spark, log, 1, "b", 3)[1] == 15


def test_a_reservation_reads_a_few_files_however_old_the_log_is(spark, tmp_path, monkeypatch):
    log, read, reads = str(tmp_path / "log"), tables.read_text, []
    for batch in range(30):
        assert tables.start_of(spark, log, batch, "r", 2)[1] == 2 * batch
    monkeypatch.setattr(tables, "read_text", lambda session, path: reads.append(path) or read(session, path))
    assert tables.start_of(spark, log, 30, "r", 2)[1] == 60 and len(reads) <= 5
    (tmp_path / "log" / "_last").unlink()  # a writer died before it noted the last link
    assert tables.start_of(spark, log, 0, "s", 1)[1] == 62


def test_compacted_days_keep_readers_and_unfinished_batches_whole(spark, tmp_path):
    path, metrics, day = str(tmp_path / "t"), str(tmp_path / "m"), date(2024, 1, 1)
    rows = spark.range(8000).selectExpr("id AS event_id", "concat('10.0.', id % 200, '.', id % 7) AS ip", "timestamp_ntz'2024-01-01 10:00:00' AS loaded_at")
    rows = conform(rows, THREAT_EVENTS)
    for batch in range(4):
        part = rows.filter(F.col("event_id") % 4 == batch)
        tables.write_batch(part, path, batch, "r", day)
        if batch:
            tables.write_batch(part.limit(1).select("event_id"), metrics, batch, "r")
    everything = lambda df: sorted(r.event_id for r in df.collect())
    assert tables.compact_days(spark, path, date(2024, 2, 1), metrics) == []  # batch 0 is not complete
    tables.write_batch(rows.limit(1).select("event_id"), metrics, 0, "r")
    reader = tables.scan_events(spark, path)
    assert tables.compact_days(spark, path, date(2024, 2, 1), metrics, row_group=20_000) == ["2024-01-01"]
    assert everything(reader) == everything(tables.scan_events(spark, path)) == list(range(8000))
    assert tables.compact_days(spark, path, date(2024, 2, 1), metrics) == []
    assert tables.folders(spark, f"{path}/load_date=2024-01-01") == ["run=compacted"]
    assert everything(tables.scan_events(spark, path)) == list(range(8000))

    import pyarrow.parquet as pq

    groups = opened = 0
    for file in (tmp_path / "t").rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.names.index("ip")
        for i in range(meta.num_row_groups):
            stats = meta.row_group(i).column(at).statistics
            groups += 1
            opened += stats.min <= "10.0.77.3" <= stats.max
    assert groups >= 4 and 1 <= opened <= 2
    one = tables.scan_events(spark, path).filter("ip = '10.0.77.3'")
    assert everything(one) == everything(rows.filter("ip = '10.0.77.3'"))


def test_unreadable_folders_are_errors(spark, tmp_path):
    bad = tmp_path / "m" / "run=r" / "batch_id=0"
    bad.mkdir(parents=True)
    assert not tables.batch_exists(spark, str(tmp_path / "m"), 0, "r")
    (bad / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        tables.batch_exists(spark, str(tmp_path / "m"), 0, "r")


def test_event_ids_are_dense_over_partitions(spark):
    rows = spark.range(1000, numPartitions=7).filter("id % 3 = 0").persist()
    ids = sorted(r.event_id for r in tables.with_event_ids(rows, 5).collect())
    assert ids == [5 + i for i in range(334)]
    rows.unpersist()


def test_empty_batch_leaves_no_trace(spark, topic, countries, tmp_path):
    none = enrich(messages.parse_message(messages.bus(spark, "text", streaming=False, path=topic)), countries).filter("false")
    jobs.load_batch(none, 0, "r", str(tmp_path / "t"), str(tmp_path / "m"))
    assert not (tmp_path / "t").exists() and not (tmp_path / "m").exists()


def test_failed_scoring_is_retried(spark, topic, countries, tmp_path):
    """The first run fails in the second batch; a new run from the same state completes the table."""
    calls = []

    def flaky(batch):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return batch

    args = (str(tmp_path / "table"), str(tmp_path / "metrics"), str(tmp_path / "state"))
    with pytest.raises(Exception):
        jobs.start_table_sink(stream(spark, topic, countries), *args, score=flaky, interval=None).awaitTermination()
    jobs.start_table_sink(stream(spark, topic, countries), *args, score=flaky, interval=None).awaitTermination()
    loaded = tables.scan_events(spark, args[0])
    assert sorted(r.ip for r in loaded.select("ip").collect()) == [m["ip"] for m in MESSAGES]


def test_outgoing_messages(spark, topic, countries, tmp_path):
    out = str(tmp_path / "out")
    jobs.start_bus_sink(stream(spark, topic, countries), str(tmp_path / "state"), fmt="json", path=out).awaitTermination()
    sent = {r.key: json.loads(r.value) for r in spark.read.schema("key string, value string").json(out).collect()}
    assert set(sent) == {None, *(m["ip"] for m in MESSAGES)} and sent[None]["malformed"] in BROKEN
    assert sent["1.1.1.1"]["categories"] == ["SSH"] and sent["1.1.1.2"]["categories"] == []
    assert "country_code" not in sent["1.1.1.3"]


def test_live_counts_and_feed_over_batches(spark, topic, countries, tmp_path):
    events = stream(spark, topic, countries)
    jobs.start_live_counts(events, str(tmp_path / "c"), str(tmp_path / "cs")).awaitTermination()
    found = {r.country_code: r.n for r in jobs.newest_state(spark.read.parquet(str(tmp_path / "c"))).collect()}
    assert found == {"US": 1, "XX": 1, "FR": 1}
    assert [len(tables.folders(spark, f"{tmp_path}/c/{f}")) for f in tables.folders(spark, str(tmp_path / "c"))] == [2]
    jobs.start_live_counts(events.filter("country_code = 'US'"), str(tmp_path / "c"), str(tmp_path / "cs2")).awaitTermination()
    assert [r.country_code for r in jobs.newest_state(spark.read.parquet(str(tmp_path / "c"))).collect()] == ["US"]
    jobs.start_live_feed(events, str(tmp_path / "f"), str(tmp_path / "fs"), rows=3).awaitTermination()
    feed = jobs.newest_state(spark.read.parquet(str(tmp_path / "f")))
    assert [r.ip for r in feed.orderBy(F.desc("event_time")).collect()] == ["1.1.1.4", "1.1.1.3", "1.1.1.2"]


def test_console_sink(spark, topic, countries):
    query = jobs.start_console_sink(stream(spark, topic, countries))
    query.awaitTermination()
    assert query.exception() is None


def test_tables_start_empty_and_accept_older_files(spark, tmp_path):
    base = str(tmp_path / "db")
    tables.create_tables(spark, base)
    path = f"{base}/threat_events"
    assert tables.scan_events(spark, path).count() == 0
    old = spark.createDataFrame([(1, "1.1.1.1", "US")], "event_id bigint, ip string, country_code string")
    old.write.mode("append").parquet(path)
    row = tables.scan_events(spark, path).first()
    assert (row.ip, row.category, row.anomaly_score) == ("1.1.1.1", None, None)
    assert tables.scan_events(spark, path, ["ip"]).columns == ["ip"]
