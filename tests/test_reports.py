"""Reports kept by streams and from partials give what the events give, however they are cut, restarted or merged."""

from datetime import date, datetime, timedelta
from threading import Barrier

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ipvigil.catalog import partial_reports, streams
from ipvigil.operators import addresses as A
from ipvigil.operators import counts
from ipvigil.plans.summary import summary, summary_of_partials
from ipvigil.schema import THREAT_EVENTS
from ipvigil.sources import partials, tables
from ipvigil.streaming import reports
from tests.conftest import SMALL

START = datetime(2024, 1, 1)


def event(i, minute, ip="1.1.1.1", source="a", reported="2024-01-01", score=None, category=None, country="AA"):
    row = dict.fromkeys(THREAT_EVENTS.names)
    row |= {"event_id": i, "ip": ip, "source": source, "last_reported_at": reported, "loaded_at": START + timedelta(minutes=minute)}
    return tuple((row | {"reoffense_probability": score, "category": category, "country_code": country, "risk_level": "low"}).values())


class Table:
    """An event table to which files are added; each is one micro-batch of the streams on it."""

    def __init__(self, spark, base):
        self.spark, self.base = spark, str(base)

    def load(self, *files):
        for rows in files:
            self.spark.createDataFrame(rows, THREAT_EVENTS).coalesce(1).write.mode("append").parquet(f"{self.base}/table")

    def stream(self):
        return reports.table_stream(self.spark, f"{self.base}/table", 1)

    def events(self):
        return tables.scan_events(self.spark, f"{self.base}/table")

    def out(self, schema):
        return self.spark.read.schema(schema).parquet(f"{self.base}/out")

    def places(self):
        return f"{self.base}/out", f"{self.base}/state"


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, tmp_path)


def minutes(table):
    found = reports.minute_counts(table.events(), table.out(reports.MINUTE_COUNTS)).collect()
    return {(r.minute - START).seconds // 60: (r.n, r.late) for r in found}


def test_minutes_close_once_and_late_rows_are_counted_apart(table):
    run = lambda: reports.start_minute_counts(table.stream(), *table.places(), delay="2 minutes").awaitTermination()
    table.load([event(0, 0), event(1, 0.5), event(2, 1)], [event(3, 0), event(4, 5)])
    run()
    assert minutes(table) == {0: (3, 0), 1: (1, 0)}
    table.load([event(5, 1, ip="late"), event(6, 4.2), event(7, 9)])  # minute 1 is closed, minute 4 is not
    run()
    assert minutes(table) == {0: (3, 0), 1: (1, 1), 4: (1, 0), 5: (1, 0)}
    run()
    assert minutes(table) == {0: (3, 0), 1: (1, 1), 4: (1, 0), 5: (1, 0)}


def test_duplicates_across_batches_and_a_restart(table):
    run = lambda: reports.start_unique_events(table.stream(), *table.places(), delay="1 hour").awaitTermination()
    table.load([event(0, 0), event(1, 1), event(2, 2, source=None)], [event(3, 3), event(4, 4, source=None)])
    run()
    table.load([event(5, 10), event(6, 11, ip="2.2.2.2")], [event(7, 200, ip="3.3.3.3")])
    run()
    table.load([event(8, 201)])
    run()
    unique = table.out("ip string, source string, last_reported_at string")
    found = {r.source: (r.unique_rows, r.duplicates) for r in reports.duplicates_by_source(table.events(), unique).collect()}
    # the tuple of row 0 passes again with row 8: its state went when the watermark was an hour past row 0
    assert found == {"a": (4, 3), None: (1, 1)}


def test_one_snapshot_per_hour(table):
    out, state = table.places()
    run = lambda: reports.start_hourly_snapshots(table.stream(), f"{table.base}/table", out, state).awaitTermination()
    first = [event(i, i, ip=f"1.1.1.{i % 3}", source="ab"[i % 2], country="ABC"[i % 3 // 2], category="c" if i % 4 == 0 else None) for i in range(12)]
    table.load(first, [event(20, 65), event(21, 75)])
    run()
    table.load([event(30, 200)])
    run()
    run()
    got = sorted(map(tuple, reports.snapshot_series(table.spark, out).collect()))
    want = reports.hourly_snapshots(table.events()).filter(F.col("recorded_at") < START + timedelta(hours=2))
    assert got == sorted(map(tuple, want.collect())) and [r[0].hour for r in got] == [0, 1]
    assert got[0][1:] == (0.167, 66.7, 25.0, 25.0)


@pytest.mark.parametrize("cuts", [[30], [1, 29], [5] * 6, [29, 1]])
def test_the_address_book_does_not_depend_on_the_cuts(table, cuts):
    rows = [event(i, (i * 7) % 11, ip=None if i % 13 == 0 else f"ip{i * i % 9}", score=None if i % 3 else i / 30) for i in range(30)]
    columns = THREAT_EVENTS.names
    run = lambda: reports.start_address_book(table.stream(), *table.places(), fold=2).awaitTermination()
    files, at = [], 0
    for n in cuts:
        files.append(rows[at : at + n])
        at += n
    table.load(*files[:2])
    run()
    for part in files[2:]:
        table.load(part)
        run()
    book = reports.address_book(table.spark, table.places()[0], columns)
    first = A.first_sighting(table.events().select(*columns))
    assert sorted(map(str, book.drop("latest_score", "since").collect())) == sorted(map(str, first.select(*book.drop("latest_score", "since").columns).collect()))
    latest = {r.ip: r.reoffense_probability for r in A.latest_score(table.events()).collect()}
    assert {r.ip: r.latest_score for r in book.collect() if r.latest_score is not None} == latest
    seen, since = set(), {}
    for number, part in enumerate(files):
        since |= {r[1]: number for r in part if r[1] not in seen}
        seen |= {r[1] for r in part}
    assert {r.ip: r.since for r in book.collect()} == since


def test_an_empty_book(spark, tmp_path):
    assert reports.address_book(spark, str(tmp_path / "none"), THREAT_EVENTS.names).collect() == []


@pytest.fixture
def loaded(spark, events, tmp_path):
    """Events in two batches with their partials, the older days merged."""
    base = str(tmp_path)
    for batch in (0, 1):
        rows = events.filter(F.col("event_id") % 2 == batch)
        tables.write_batch(rows, f"{base}/events", batch, "r")
        partials.write_partials(rows, f"{base}/partials", batch, "r")
    days = sorted(r[0] for r in events.select(F.to_date("loaded_at")).distinct().collect())
    merged = partials.merge_days(spark, f"{base}/partials", days[len(days) // 2])
    assert merged == [str(d) for d in days[: len(days) // 2]]
    return f"{base}/partials"


def test_partials_replace_and_merge(spark, events, loaded):
    read = lambda kind: partials.read_partials(spark, loaded, kind)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    for _ in range(3):
        assert same(A.stats_of(partials.pairs(read("addresses"))), A.ip_stats(events))
        assert same(summary_of_partials(read("cells"), read("addresses")), summary(events))
        assert same(partials.count_by(read("cells"), "source"), counts.count_by(events, "source"))
        # a batch that comes again replaces its partials of days that are open, and merging goes on
        last = events.filter(F.col("event_id") % 2 == 1)
        open_days = last.filter(F.to_date("loaded_at") >= F.lit(max(r[0] for r in events.select(F.to_date("loaded_at")).collect())))
        partials.write_partials(open_days, loaded, 1, "r")
        partials.merge_days(spark, loaded, date(2000, 1, 1))
    assert not set(tables.folders(spark, f"{loaded}/cells")) & {f"load_date={d}" for d in ("2024-01-01", "2024-01-02")}


def test_reports_read_partials_only(spark, loaded):
    read = lambda kind: partials.read_partials(spark, loaded, kind)
    files = summary_of_partials(read("cells"), read("addresses")).inputFiles()
    assert files and all("/partials/" in f for f in files)
    (closed,) = tables.folders(spark, f"{loaded}/cells_merged")
    days = {part for f in files for part in f.split("/") if part.startswith("load_date=")}
    assert days and min(days) >= closed.replace("before", "load_date")


def test_sketches_against_exact_counts(spark):
    rows = spark.range(300_000).select(
        F.concat(F.lit("ip"), F.col("id") % 120_000).alias("ip"), F.when(F.col("id") % 3 > 0, F.lit("c")).alias("category"), F.lit(0).alias("day")
    )
    parts = [partials._partial(rows.filter(F.col("id") % 4 == i), "sketches", F.lit(date(2024, 1, 1))) for i in range(4)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    found = partials.distinct_addresses(partials._merged(every.drop("load_date"), "sketches")).first()
    bound = 3 / 2 ** (partials.LG_K / 2)
    assert abs(found.ip_count / 120_000 - 1) < bound and abs(found.ip_count_hll / 120_000 - 1) < bound
    few = partials._partial(rows.limit(5000), "sketches", F.lit(date(2024, 1, 1)))
    assert partials.distinct_addresses(few).first().ip_count == rows.limit(5000).select("ip").distinct().count()


def test_batches_of_partials_are_read_by_themselves(spark, events, monkeypatch):
    """The events are derived once; every batch reads its own rows of what that has left."""
    write, read = partials.write_partials, []

    def noted(rows, path, batch_id, run):
        files = rows.select(F.input_file_name().alias("f"), "ip").distinct().collect()
        read.append((batch_id, {r.f.split("/")[-2] for r in files}, rows.count()))
        write(rows, path, batch_id, run)

    monkeypatch.setattr(partials, "write_partials", noted)
    partial_reports.written(spark, SMALL)
    size = {b: events.filter(F.col("event_id") % 3 == b).count() for b in range(3)}
    assert read == [(b, {f"batch={b}"}, size[b]) for b in (0, 1, 2, 0)]


def test_a_batch_has_one_file_of_partials_per_day(spark, events, tmp_path):
    """However many tasks there are; here 4 that are not merged for being small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        partials.write_partials(events, str(tmp_path), 0, "r")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for kind in partials.SCHEMAS:
        days = tables.folders(spark, f"{tmp_path}/{kind}")
        assert len(days) > 5 and all(len(list((tmp_path / kind / d).rglob("*.parquet"))) == 1 for d in days)


def test_parts_are_loaded_in_small_files_and_one_micro_batch_each(spark, tmp_path):
    sizes = [10, 1, 0, 7]
    rows = [event(100 * part + i, i) + (part,) for part, n in enumerate(sizes) for i in range(n)]
    frame = spark.createDataFrame(rows, StructType([*THREAT_EVENTS.fields, StructField("part", IntegerType())]))
    batches = []

    def start(stream):
        writer = stream.writeStream.foreachBatch(lambda b, _: batches.append(sorted(r.event_id for r in b.collect())))
        return writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()

    table = streams.loaded_in_parts(frame, str(tmp_path), start, file_rows=3)
    assert batches == [[100 * part + i for i in range(n)] for part, n in enumerate(sizes)]
    per_file = table.groupBy(F.input_file_name()).count().collect()
    assert table.count() == sum(sizes) and max(r["count"] for r in per_file) < 10


def test_partials_of_all_kinds_are_made_at_one_time(spark, events, loaded, monkeypatch):
    """Each kind's job waits for those of the others, has the caller's properties, and its error reaches the caller."""
    made, met, seen = {"_partial": partials._partial, "_merged": partials._merged}, Barrier(len(partials.SCHEMAS)), []

    def waiting(name):
        def make(rows, kind, *rest):
            met.wait(20)
            seen.append((name, kind, spark.sparkContext.getLocalProperty("spark.job.description")))
            return made[name](rows, kind, *rest)

        return make

    for name in made:
        monkeypatch.setattr(partials, name, waiting(name))
    spark.sparkContext.setJobDescription("a batch")
    try:
        partials.write_partials(events, f"{loaded}-2", 0, "r")
        merged = partials.merge_days(spark, f"{loaded}-2", date(9999, 1, 1))
        assert [f"load_date={d}" for d in merged] == tables.folders(spark, f"{loaded}-2/cells")
        assert sorted(seen) == sorted((name, kind, "a batch") for name in made for kind in partials.SCHEMAS)
        monkeypatch.setattr(partials, "_partial", lambda rows, kind, day: 1 / (kind != "addresses") and made["_partial"](rows, kind, day))
        with pytest.raises(ZeroDivisionError):
            partials.write_partials(events, f"{loaded}-3", 0, "r")
    finally:
        spark.sparkContext.setJobDescription(None)


def test_pairs_from_partials_move_once(spark, events, loaded):
    """By address, which serves the figures per address and source and those per address."""
    found = A.stats_of(partials.pairs(partials.read_partials(spark, loaded, "addresses")))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(str, found.collect())) == sorted(map(str, A.ip_stats(events).collect()))
