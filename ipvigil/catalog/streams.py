"""Streaming queries: the given events arrive as a stream, are drained, and the written result is returned."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ipvigil.catalog import fixtures as X
from ipvigil.catalog.registry import listed, query
from ipvigil.catalog.sql import BROKEN, DIM_COUNTRY, MESSAGES, over_events
from ipvigil.schema import EVENT_COLUMNS
from ipvigil.session import cut_lineage, shared_folder
from ipvigil.sources import messages, tables
from ipvigil.streaming import jobs, reports

ENRICHED = """,
enriched AS (
  SELECT m.event_id, m.ip, m.country_code, m.abuse_confidence_score,
    CASE WHEN m.abuse_confidence_score >= 90 THEN 'critical' WHEN m.abuse_confidence_score >= 70 THEN 'high'
      WHEN m.abuse_confidence_score >= 40 THEN 'medium' ELSE 'low' END AS risk_level,
    coalesce(d.latitude, 0) AS latitude, coalesce(d.longitude, 0) AS longitude, m.last_reported_at,
    make_timestamp(CAST(floor(m.ingested_at) AS BIGINT) * 1000000) AS event_time, m.source, m.category, coalesce(m.category, '') AS categories
  FROM messages m LEFT JOIN dim_country d ON m.country_code = d.country_code WHERE m.event_id % 500 <> 7
)"""
PARTS = (MESSAGES, DIM_COUNTRY, ENRICHED)
COLUMNS = ", ".join(EVENT_COLUMNS)


FILES = 3


def texts(spark, sf) -> DataFrame:
    return X.message_text(X.threat_events(spark, sf))


def topic(messages_: DataFrame, path: str) -> str:
    """Messages as a folder of several files; a stream takes one file per batch."""
    messages_.select("value").repartition(FILES).write.text(path)
    return path


def stream_of(spark, sf, path: str) -> DataFrame:
    raw = messages.bus(spark, "text", path=path, maxFilesPerTrigger="1")
    return jobs.enriched_stream(raw, X.dim_country(spark, sf))


def enriched_stream(spark, sf) -> DataFrame:
    return stream_of(spark, sf, topic(texts(spark, sf), shared_folder(spark, "topic")))


def drained(stream: DataFrame, base: str) -> DataFrame:
    """Write the stream to files until nothing is left, and read them."""
    writer = stream.writeStream.format("parquet").option("path", f"{base}/out")
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


EMPTY = """SELECT NULL AS ip, NULL AS country_code, NULL AS abuse_confidence_score, 'low' AS risk_level, 0 AS latitude,
  0 AS longitude, NULL AS last_reported_at, NULL AS event_time, NULL AS source, NULL AS category"""


@query(
    "stream_enrich",
    over_events(
        f"""SELECT {COLUMNS}, categories, CAST(NULL AS VARCHAR) AS malformed FROM enriched
        UNION ALL SELECT e.*, '' AS categories, text FROM ({EMPTY}) e, broken""",
        *PARTS, BROKEN,
    ),
)
def _(spark, sf):
    return listed(drained(enriched_stream(spark, sf), shared_folder(spark, "stream-enrich")), "categories")


@query(
    "src_bus",
    over_events(
        """SELECT source, count(*) AS n, CAST(0 AS BIGINT) AS malformed FROM enriched GROUP BY source
        UNION ALL SELECT NULL, count(*), count(*) FROM broken""",
        *PARTS, BROKEN,
    ),
)
def _(spark, sf):
    base = shared_folder(spark, "bus")
    raw = messages.bus(spark, "text", path=topic(texts(spark, sf), f"{base}/topic"), maxFilesPerTrigger="1")
    rows = drained(messages.parse_message(raw), base)
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("malformed").alias("malformed"))


@query(
    "sink_bus",
    over_events(
        """SELECT ip AS key, country_code, abuse_confidence_score, risk_level, latitude, source, categories, CAST(NULL AS VARCHAR) AS malformed
        FROM enriched UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, '', text FROM broken""",
        *PARTS, BROKEN,
    ),
)
def _(spark, sf):
    base = shared_folder(spark, "sink-bus")
    stream = enriched_stream(spark, sf)
    jobs.start_bus_sink(stream, f"{base}/state", fmt="json", path=f"{base}/topic").awaitTermination()
    sent = spark.read.schema("key string, value string").json(f"{base}/topic")
    body = F.from_json("value", stream.schema).alias("m")
    columns = ["country_code", "abuse_confidence_score", "risk_level", "latitude", "source", "categories", "malformed"]
    rows = listed(sent.select("key", body).select("key", *[f"m.{c}" for c in columns]), "categories")
    return rows.withColumn("categories", F.coalesce("categories", F.lit("")))


def _loaded(spark, sf, score=None, bus: bool = False, show=None) -> str:
    """Load all messages into one table, in the ways a table is loaded, and return its folder.

    A third comes from a stream in several batches, a third from a second stream with a new checkpoint, and a third in
    a batch of which an unfinished attempt has left other rows behind. Then the first batches come again.
    """
    base = shared_folder(spark, "sink-table")
    places = f"{base}/table", f"{base}/metrics"
    sent = f"{base}/bus" if bus else None
    part = F.col("event_id") % 3
    for i in range(2):
        stream = stream_of(spark, sf, topic(texts(spark, sf).filter(part == i), f"{base}/topic-{i}"))
        jobs.start_table_sink(stream, *places, f"{base}/state-{i}", score, sent, interval=None, show=show).awaitTermination()
    rest = jobs.enriched_stream(texts(spark, sf).filter(part == 2), X.dim_country(spark, sf))
    day = tables.start_of(spark, f"{places[1]}_started", 0, "by-hand", messages.valid(rest).count())[0].date()
    tables.write_batch(tables.scan_events(spark, places[0]).drop("load_date").limit(5), places[0], 0, "by-hand", day)
    jobs.load_batch(rest, 0, "by-hand", *places, score, sent)
    for run in tables.folders(spark, places[1]):
        again = jobs.enriched_stream(texts(spark, sf).limit(10), X.dim_country(spark, sf))
        jobs.load_batch(again, 0, run.removeprefix("run="), *places, score, sent)
    return base


@query("sink_table", over_events(f"SELECT {COLUMNS} FROM enriched", *PARTS))
def _(spark, sf):
    return tables.scan_events(spark, f"{_loaded(spark, sf)}/table").select(*EVENT_COLUMNS)


@query("compact_days", over_events(f"SELECT {COLUMNS} FROM enriched", *PARTS))
def _(spark, sf):
    """The same rows once the batches of all days are rewritten."""
    path = f"{_loaded(spark, sf)}/table"
    tables.compact_days(spark, path, date(9999, 1, 1))
    return tables.scan_events(spark, path).select(*EVENT_COLUMNS)


@query("event_ids", over_events("SELECT count(*) AS n, count(*) AS ids, CAST(0 AS BIGINT) AS least, count(*) - 1 AS most FROM enriched", *PARTS))
def _(spark, sf):
    """Ids are distinct and dense over all batches of all runs."""
    rows = tables.scan_events(spark, f"{_loaded(spark, sf)}/table")
    return rows.agg(
        F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.min("event_id").alias("least"), F.max("event_id").alias("most")
    )


@query("quarantine", over_events("SELECT text AS value FROM broken", MESSAGES, BROKEN))
def _(spark, sf):
    return spark.read.parquet(f"{_loaded(spark, sf)}/table_quarantine").select("value")


@query(
    "batch_metrics",
    over_events("SELECT (SELECT count(*) FROM enriched) AS batch_rows, (SELECT count(*) FROM broken) AS malformed_rows", *PARTS, BROKEN),
)
def _(spark, sf):
    logged = jobs.read_metrics(spark, f"{_loaded(spark, sf)}/metrics")
    return logged.agg(F.sum("batch_rows").alias("batch_rows"), F.sum("malformed_rows").alias("malformed_rows"))


@query(
    "stream_three_sinks",
    over_events(
        """SELECT 'table' AS sink, source, count(*) AS n FROM enriched GROUP BY source
        UNION ALL SELECT 'bus', source, count(*) FROM enriched GROUP BY source
        UNION ALL SELECT 'bus', NULL, count(*) FROM broken
        UNION ALL SELECT 'metrics', NULL, count(*) FROM enriched
        UNION ALL SELECT 'console', NULL, CAST(60 AS BIGINT)""",
        *PARTS, BROKEN,
    ),
)
def _(spark, sf):
    """Table, bus, metrics and console; the two streams' six batches show ten rows each."""
    lines = []
    base = _loaded(spark, sf, bus=True, show=lines.append)
    table = tables.scan_events(spark, f"{base}/table").groupBy("source").agg(F.count("*").alias("n"))
    sent = spark.read.schema("key string, value string").parquet(f"{base}/bus")
    bus = sent.groupBy(F.get_json_object("value", "$.source").alias("source")).agg(F.count("*").alias("n"))
    logged = jobs.read_metrics(spark, f"{base}/metrics").agg(F.sum("batch_rows").alias("n"))
    return (
        table.select(F.lit("table").alias("sink"), "source", "n")
        .unionByName(bus.select(F.lit("bus").alias("sink"), "source", "n"))
        .unionByName(logged.select(F.lit("metrics").alias("sink"), F.lit(None).cast("string").alias("source"), "n"))
        .unionByName(spark.range(1).select(F.lit("console").alias("sink"), F.lit(None).cast("string").alias("source"), F.lit(len(lines)).cast("long").alias("n")))
    )


@query(
    "stream_live_counts",
    over_events("SELECT country_code, count(*) AS n FROM enriched WHERE country_code IS NOT NULL GROUP BY country_code", *PARTS),
)
def _(spark, sf):
    """A stream over a part of the messages, then one with a new checkpoint over all: only the latter's counts stay."""
    base = shared_folder(spark, "live-counts")
    part = stream_of(spark, sf, topic(texts(spark, sf).filter("event_id % 4 = 0"), f"{base}/topic"))
    jobs.start_live_counts(part, f"{base}/counts", f"{base}/state-0").awaitTermination()
    jobs.start_live_counts(enriched_stream(spark, sf), f"{base}/counts", f"{base}/state-1").awaitTermination()
    return jobs.newest_state(spark.read.parquet(f"{base}/counts"))


@query(
    "live_feed",
    over_events(
        """SELECT ip, source, country_code, risk_level, event_time FROM enriched
        ORDER BY event_time DESC NULLS LAST, ip, source LIMIT 40""",
        *PARTS,
    ),
)
def _(spark, sf):
    base = shared_folder(spark, "live-feed")
    jobs.start_live_feed(enriched_stream(spark, sf), f"{base}/feed", f"{base}/state").awaitTermination()
    feed = jobs.newest_state(spark.read.parquet(f"{base}/feed"))
    return feed.select("ip", "source", "country_code", "risk_level", "event_time")


#: The table as it is loaded: four parts by load time, each one micro-batch; some rows come a part late.
ARRIVALS = """,
ends AS (SELECT min(epoch_us(loaded_at) // 1000000) AS low, max(epoch_us(loaded_at) // 1000000) AS high FROM te),
arrivals AS (
  SELECT te.*, least(3, (epoch_us(loaded_at) // 1000000 - low) * 4 // greatest(high - low, 1) + CASE WHEN event_id % 29 = 3 THEN 1 ELSE 0 END) AS part
  FROM te, ends)"""


def arrivals(spark, sf, late: bool = True) -> DataFrame:
    events = X.threat_events(spark, sf)
    second = F.unix_seconds(F.col("loaded_at").cast("timestamp"))
    ends = events.agg(F.min(second).alias("low"), F.max(second).alias("high"))
    low, high = (ends.select(c).scalar() for c in ("low", "high"))
    part = F.floor((second - low) * 4 / F.greatest(high - low, F.lit(1)))
    if late:
        part += (F.col("event_id") % 29 == 3).cast("int")
    return cut_lineage(events.withColumn("part", F.least(F.lit(3), part).cast("int")), "arrivals", "part")


#: Rows of a file that a part is loaded with, about.
FILE_ROWS = 250_000


def loaded_in_parts(rows: DataFrame, base: str, start, file_rows: int = FILE_ROWS) -> DataFrame:
    """Load the parts as files; `start` gets the table as a stream, and is stopped and started again after the second.

    All parts have the same number of files, as many as the largest needs, so a micro-batch of that many is one part.
    """
    spark, path = rows.sparkSession, f"{base}/table"
    largest = rows.groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    files = max(1, -(-largest // file_rows))
    for parts in ((0, 1), (2, 3)):
        for part in parts:
            loaded = rows.filter(F.col("part") == part).drop("part")
            loaded.repartition(files).write.mode("append").parquet(path)
            # tasks without rows write no file
            for _ in range(files * (part + 1) - len(tables.scan_events(spark, path).inputFiles())):
                loaded.limit(0).coalesce(1).write.mode("append").parquet(path)
        start(reports.table_stream(spark, path, files)).awaitTermination()
    return tables.scan_events(spark, path)


@query(
    "stream_minute_batches",
    over_events(
        """,
        marks AS (SELECT max(loaded_at) FILTER (part <= 1) - INTERVAL 10 MINUTE AS half, max(loaded_at) - INTERVAL 10 MINUTE AS whole FROM arrivals),
        judged AS (
          SELECT date_trunc('minute', loaded_at) AS minute, part >= 2 AND date_trunc('minute', loaded_at) + INTERVAL 1 MINUTE <= half AS late, whole
          FROM arrivals, marks),
        counted AS (
          SELECT minute, count(*) FILTER (NOT late) AS n, count(*) FILTER (late) AS late, minute + INTERVAL 1 MINUTE <= any_value(whole) AS closed
          FROM judged GROUP BY minute)
        SELECT minute, n, late FROM counted WHERE minute <= (SELECT max(minute) FROM counted WHERE closed AND n > 0)""",
        ARRIVALS,
    ),
)
def _(spark, sf):
    """Rows per minute of load, counted by the stream, and those that came after their minute was closed."""
    base = shared_folder(spark, "minute-batches")
    start = lambda rows: reports.start_minute_counts(rows, f"{base}/out", f"{base}/state")
    table = loaded_in_parts(arrivals(spark, sf), base, start)
    return reports.minute_counts(table, spark.read.schema(reports.MINUTE_COUNTS).parquet(f"{base}/out"))


@query(
    "stream_exact_duplicates",
    over_events(
        """,
        seen AS (SELECT * FROM arrivals UNION ALL SELECT * FROM arrivals WHERE event_id % 7 = 2)
        SELECT source, (SELECT count(*) FROM (SELECT DISTINCT ip, source, last_reported_at FROM te) u WHERE u.source IS NOT DISTINCT FROM s.source) AS unique_rows,
          count(*) - (SELECT count(*) FROM (SELECT DISTINCT ip, source, last_reported_at FROM te) u WHERE u.source IS NOT DISTINCT FROM s.source) AS duplicates
        FROM seen s GROUP BY source""",
        ARRIVALS,
    ),
)
def _(spark, sf):
    """Some rows are delivered again a part later, across micro-batches and the restart."""
    base = shared_folder(spark, "unique")
    rows = arrivals(spark, sf)
    again = rows.filter("event_id % 7 = 2").withColumn("part", F.least(F.lit(3), F.col("part") + 1))
    start = lambda x: reports.start_unique_events(x, f"{base}/out", f"{base}/state", delay="3650 days")
    table = loaded_in_parts(rows.unionByName(again), base, start)
    unique = spark.read.schema("ip string, source string, last_reported_at string").parquet(f"{base}/out")
    return reports.duplicates_by_source(table, unique)


@query(
    "stream_snapshot",
    over_events(
        """,
        hours AS (SELECT *, date_trunc('hour', loaded_at) AS recorded_at FROM te),
        by_country AS (SELECT recorded_at, country_code, count(*) AS n, count(category) AS c FROM hours GROUP BY ALL),
        steps AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY recorded_at ORDER BY n, country_code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM by_country),
        figures AS (SELECT recorded_at, sum(2 * before + n) AS area, count(*) AS groups, sum(n) AS total, max(n) AS first, sum(c) AS c FROM steps GROUP BY 1),
        crossed AS (
          SELECT recorded_at, count(*) AS k FROM (
            SELECT recorded_at, ip FROM hours WHERE source <> '' GROUP BY ALL HAVING count(DISTINCT source) > 1) GROUP BY 1)
        SELECT recorded_at, round(1 - CAST(area AS DOUBLE) / (CAST(groups AS DOUBLE) * CAST(total AS DOUBLE)), 3) AS gini_coefficient,
          round(CAST(first AS DOUBLE) * 100 / total, 1) AS top_country_pct, round(CAST(coalesce(k, 0) AS DOUBLE) * 100 / total, 1) AS cross_source_pct,
          round(CAST(c AS DOUBLE) * 100 / total, 1) AS categorized_pct
        FROM figures LEFT JOIN crossed USING (recorded_at)
        WHERE recorded_at + INTERVAL 1 HOUR <= (SELECT max(loaded_at) FROM te) - INTERVAL 1 DAY"""
    ),
)
def _(spark, sf):
    """One row per closed hour, over several micro-batches and a restart."""
    base = shared_folder(spark, "hourly")

    def start(rows):
        return reports.start_hourly_snapshots(rows, f"{base}/table", f"{base}/out", f"{base}/state", delay="1 day")

    loaded_in_parts(arrivals(spark, sf, late=False), base, start)
    return reports.snapshot_series(spark, f"{base}/out")


BOOK = ["ip", "loaded_at", "event_id", "source", "country_code", "abuse_confidence_score", "risk_level", "category", "reoffense_probability"]


@query(
    "stream_addresses",
    over_events(
        """,
        numbered AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY loaded_at, event_id) AS rn FROM arrivals),
        known AS (
          SELECT ip, count(*) AS report_count, arg_max(reoffense_probability, (loaded_at, event_id)) AS latest_score, CAST(min(part) AS BIGINT) AS since
          FROM arrivals GROUP BY ip)
        SELECT ip, loaded_at, event_id, source, country_code, abuse_confidence_score, risk_level, category, reoffense_probability, report_count, latest_score, since
        FROM numbered JOIN known USING (ip) WHERE rn = 1""",
        ARRIVALS,
    ),
)
def _(spark, sf):
    """First sighting, number of rows, newest score and the batch that brought each address, with a fold in between."""
    base = shared_folder(spark, "addresses")
    start = lambda rows: reports.start_address_book(rows.select(*BOOK), f"{base}/out", f"{base}/state", fold=2)
    loaded_in_parts(arrivals(spark, sf), base, start)
    return reports.address_book(spark, f"{base}/out", BOOK)
