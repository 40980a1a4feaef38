"""Streaming jobs: enrich messages, write them to the table and the outgoing bus, count live events."""

import time
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from ipvigil.constants import LIVE_FEED_ROWS, TABLE_TRIGGER
from ipvigil.operators.enrich import enrich
from ipvigil.operators.rankings import live_feed
from ipvigil.schema import EVENT_COLUMNS, PIPELINE_METRICS, conform
from ipvigil.sources.messages import parse_message, quarantined, to_bus, valid
from ipvigil.sources.partials import write_partials
from ipvigil.sources.tables import batch_exists, folders, remove_folder, start_of, with_event_ids, write_batch

Scorer = Callable[[DataFrame], DataFrame]

#: Rows of a batch that the console sink shows.
SHOWN = 10


def trigger_of(interval: str | None) -> dict:
    """Processing-time trigger, or drain what is there and stop."""
    return {"processingTime": interval} if interval else {"availableNow": True}


def enriched_stream(raw: DataFrame, dim_country: DataFrame, on_malformed: str = "mark") -> DataFrame:
    return enrich(parse_message(raw, on_malformed), dim_country)


def without_models(events: DataFrame) -> DataFrame:
    """Score columns are NULL while no model is available."""
    missing = [c for c in ("reoffense_probability", "anomaly_score") if c not in events.columns]
    return events.withColumns({c: F.lit(None).cast("double") for c in missing}) if missing else events


def run_of(batch: DataFrame) -> str:
    """The id of the streaming query that a batch comes from: fixed per checkpoint, new with a new checkpoint."""
    run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not run:
        raise ValueError("not inside a streaming query")
    return run


def load_batch(
    batch: DataFrame,
    batch_id: int,
    run: str,
    table: str,
    metrics: str,
    score: Scorer | None = None,
    bus: str | Mapping[str, str] | None = None,
    quarantine: str | None = None,
    partials: str | None = None,
    show: Callable[[str], None] | None = None,
) -> None:
    """Write one micro-batch to the table (and as JSON messages to `bus`) and log rows and write time.

    `bus` is a folder, in which a replaced batch replaces its messages, or the options of a writer, with its `format`
    (kafka, say): such messages are sent once more if a batch has to be repeated.

    `partials` is where additive results of the batch go (`sources.partials`), which reports read instead of the events.
    `show` gets the first SHOWN rows of the batch as text (print, say): the console as a further sink of the same read.

    `run` names the checkpoint that `batch_id` belongs to. Malformed messages go to `quarantine` (by default next to
    the table) and are counted in the metrics row. That row is written last: a batch that has one is complete and is
    skipped when it comes again, an unfinished one is replaced. Scores are computed by the executors; rows never pass
    the driver. Empty batches leave no trace.
    """
    spark = batch.sparkSession
    if batch_exists(spark, metrics, batch_id, run):
        return
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        good = valid(batch)
        broken = F.count("malformed") if "malformed" in batch.columns else F.lit(0)
        every, bad = batch.agg(F.count("*"), broken).first()
        rows = every - bad
        if rows == bad == 0:
            return
        loaded_at, first_id = start_of(spark, f"{metrics}_started", batch_id, run, rows)
        numbered = with_event_ids(good, first_id)
        scored = without_models(score(numbered) if score else numbered)
        stamped = scored.withColumn("loaded_at", F.lit(loaded_at).cast("timestamp_ntz"))
        start = time.monotonic()
        if rows:
            write_batch(stamped.drop("categories"), table, batch_id, run, loaded_at.date())
            if partials:
                write_partials(stamped, partials, batch_id, run)
        elapsed = (time.monotonic() - start) * 1000.0
        if bad:
            write_batch(quarantined(batch), quarantine or f"{table}_quarantine", batch_id, run, loaded_at.date())
        if isinstance(bus, str):
            write_batch(to_bus(batch, [*EVENT_COLUMNS, "categories"]), bus, batch_id, run)
        elif bus:
            to_bus(batch, [*EVENT_COLUMNS, "categories"]).write.options(**bus).format(bus["format"]).mode("append").save()
        if show:
            for line in good.select(*EVENT_COLUMNS).limit(SHOWN).collect():
                show(" ".join(f"{k}={v}" for k, v in line.asDict().items()))
        row = spark.range(1).select(
            F.lit(rows).cast("bigint").alias("batch_rows"),
            F.lit(elapsed).alias("write_duration_ms"),
            F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz").alias("recorded_at"),
            F.lit(bad).cast("bigint").alias("malformed_rows"),
        )
        write_batch(row, metrics, batch_id, run)
    finally:
        batch.unpersist()


def start_table_sink(
    events: DataFrame,
    table: str,
    metrics: str,
    checkpoint: str,
    score: Scorer | None = None,
    bus: str | Mapping[str, str] | None = None,
    interval: str | None = TABLE_TRIGGER,
    quarantine: str | None = None,
    partials: str | None = None,
    show: Callable[[str], None] | None = None,
) -> StreamingQuery:
    """One query feeds table, quarantine, metrics and, if asked, bus, partials and console: the source is read and parsed once."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        load_batch(batch, batch_id, run_of(batch), table, metrics, score, bus, quarantine, partials, show)

    writer = events.writeStream.foreachBatch(handle).outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger_of(interval)).start()


def start_bus_sink(events: DataFrame, checkpoint: str, fmt: str = "kafka", interval: str | None = None, **options: str) -> StreamingQuery:
    """Enriched events as keyed JSON messages."""
    messages = to_bus(events, [*EVENT_COLUMNS, "categories"])
    if fmt == "kafka":
        options = {k.replace("_", "."): v for k, v in options.items()}
    writer = messages.writeStream.format(fmt).options(**options).outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger_of(interval)).start()


def start_console_sink(events: DataFrame, rows: int = 10, interval: str | None = None) -> StreamingQuery:
    writer = events.writeStream.format("console").outputMode("append")
    return writer.option("truncate", "false").option("numRows", rows).trigger(**trigger_of(interval)).start()


def live_counts(events: DataFrame) -> DataFrame:
    """Running number of events per known country."""
    return events.filter(F.col("country_code") != "").groupBy("country_code").agg(F.count("*").alias("n"))


def replace_state(batch: DataFrame, path: str, batch_id: int) -> None:
    """Keep `batch` as the newest state at `path`; of older states only the last stays, for readers at work."""
    spark, run = batch.sparkSession, run_of(batch)
    written = datetime.now(timezone.utc).replace(tzinfo=None)
    write_batch(batch.withColumn("written_at", F.lit(written).cast("timestamp_ntz")), path, batch_id, run)
    for other in folders(spark, path):
        if other != f"run={run}":
            remove_folder(spark, f"{path}/{other}")
    for old in folders(spark, f"{path}/run={run}"):
        if int(old.removeprefix("batch_id=")) < batch_id - 1:
            remove_folder(spark, f"{path}/run={run}/{old}")


def start_live_counts(events: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keep the running counts at `path`; every trigger replaces them. One row per country is written."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        replace_state(batch, path, batch_id)

    writer = live_counts(valid(events)).writeStream.foreachBatch(handle).outputMode("complete")
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger_of(interval)).start()


def start_live_feed(
    events: DataFrame, path: str, checkpoint: str, rows: int = LIVE_FEED_ROWS, interval: str | None = None
) -> StreamingQuery:
    """Keep the newest events of the stream at `path`: each batch is merged with the few rows kept before it."""
    kept = [*EVENT_COLUMNS, "categories"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        pool, spark = batch.select(*kept), batch.sparkSession
        base = f"{path}/run={run_of(batch)}"
        numbers = [int(f.removeprefix("batch_id=")) for f in folders(spark, base)]
        before = [n for n in numbers if n < batch_id]
        if before:
            pool = pool.unionByName(spark.read.schema(pool.schema).parquet(f"{base}/batch_id={max(before)}"))
        replace_state(live_feed(pool, rows), path, batch_id)

    writer = valid(events).writeStream.foreachBatch(handle).outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger_of(interval)).start()


def newest_state(states: DataFrame) -> DataFrame:
    """The rows of the state that was written last."""
    last = states.agg(F.max("written_at").alias("w")).scalar()
    return states.filter(F.col("written_at") == last).drop("batch_id", "run", "written_at")


def read_metrics(spark, path: str) -> DataFrame:
    return conform(spark.read.option("mergeSchema", "true").parquet(path), PIPELINE_METRICS)
