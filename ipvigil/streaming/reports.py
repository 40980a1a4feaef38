"""Reports kept up to date by streams over the event table: state and small results instead of reading the table again.

The loaded table is the source, so a row counts once it is loaded. Watermarks bound the state of everything that closes
(minutes, hours, duplicates); the address book has one state row per address and forgets none. Every result is written by
micro-batch into a folder of its own, so a repeated batch replaces what it has written and adds nothing.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ipvigil.functions.columns import safe_pct
from ipvigil.schema import BRIEFING_SNAPSHOTS, THREAT_EVENTS
from ipvigil.sources.tables import folders, is_finished, remove_folder, scan_events, write_batch
from ipvigil.streaming.jobs import run_of, trigger_of

#: How long the newest row may be ahead of a row that still counts.
DELAY = "10 minutes"
TUPLE = ["ip", "source", "last_reported_at"]
#: After so many micro-batches the changes of the address book are folded into one table.
FOLD = 50


def table_stream(spark: SparkSession, table: str, files_per_batch: int | None = None) -> DataFrame:
    """The event table as a stream of the files that are loaded."""
    reader = spark.readStream.schema(THREAT_EVENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(table).select(*THREAT_EVENTS.names)


def _written(rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str, interval: str | None) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(handle).outputMode(mode)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger_of(interval)).start()


def _appended(rows: DataFrame, path: str, checkpoint: str, interval: str | None) -> StreamingQuery:
    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id, run_of(batch))

    return _written(rows, handle, checkpoint, "append", interval)


def closed_windows(events: DataFrame, size: str, time: str = "loaded_at", delay: str = DELAY) -> DataFrame:
    """(start, n) of every window that the watermark has passed, once; rows that come later are not counted any more."""
    at = events.filter(F.col(time).isNotNull()).select(F.col(time).cast("timestamp").alias("at")).withWatermark("at", delay)
    counted = at.groupBy(F.window("at", size).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def start_minute_counts(
    events: DataFrame, path: str, checkpoint: str, time: str = "loaded_at", delay: str = DELAY, interval: str | None = None
) -> StreamingQuery:
    """Rows per minute of `time` at `path`, each minute written once, when it is closed."""
    return _appended(closed_windows(events, "1 minute", time, delay), path, checkpoint, interval)


MINUTE_COUNTS = "start timestamp_ntz, n long"


def minute_counts(events: DataFrame, closed: DataFrame, time: str = "loaded_at") -> DataFrame:
    """(minute, n, late) of the closed minutes: rows that were counted in time, and rows of the table that came after that."""
    minute = F.date_trunc("minute", F.col(time)).cast("timestamp_ntz")
    loaded = events.groupBy(minute.alias("minute")).agg(F.count("*").alias("loaded"))
    last = closed.agg(F.max("start").alias("m")).scalar()
    both = loaded.filter(F.col("minute") <= last).join(closed.select(F.col("start").alias("minute"), "n"), "minute", "left")
    n = F.coalesce("n", F.lit(0))
    return both.select("minute", n.alias("n"), (F.col("loaded") - n).alias("late"))


def unique_events(events: DataFrame, time: str = "loaded_at", delay: str = "1 day") -> DataFrame:
    """The first row of every (ip, source, last_reported_at) within `delay`; NULL counts as a value. The state of a tuple
    goes `delay` after its first row; rows without a time pass none on."""
    at = events.filter(F.col(time).isNotNull()).withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", delay)
    return at.dropDuplicatesWithinWatermark(TUPLE).drop("at")


def start_unique_events(
    events: DataFrame, path: str, checkpoint: str, time: str = "loaded_at", delay: str = "1 day", interval: str | None = None
) -> StreamingQuery:
    return _appended(unique_events(events, time, delay).select(*TUPLE), path, checkpoint, interval)


def duplicates_by_source(events: DataFrame, unique: DataFrame) -> DataFrame:
    """(source, unique_rows, duplicates) of the rows a stream has seen and those that it has passed on."""
    seen = events.groupBy("source").agg(F.count("*").alias("seen"))
    kept = unique.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("unique_rows"))
    both = seen.join(kept, F.col("source").eqNullSafe(F.col("of")), "left")
    n = F.coalesce("unique_rows", F.lit(0))
    return both.select("source", n.alias("unique_rows"), (F.col("seen") - n).alias("duplicates"))


def hour_of(time: str = "loaded_at") -> Column:
    return F.date_trunc("hour", F.col(time)).cast("timestamp_ntz")


def hourly_snapshots(events: DataFrame, time: str = "loaded_at") -> DataFrame:
    """The figures of `plans.briefing.snapshot` for the rows of each hour; recorded_at is the hour's start.

    Counts combine on the map side; the ordered frame of an hour holds one row per country.
    """
    rows = events.filter(F.col(time).isNotNull()).withColumn("recorded_at", hour_of(time))
    by_country = rows.groupBy("recorded_at", "country_code").agg(F.count("*").alias("n"), F.count("category").alias("categorised"))
    rising = Window.partitionBy("recorded_at").orderBy("n", "country_code").rowsBetween(Window.unboundedPreceding, -1)
    steps = by_country.withColumn("before", F.coalesce(F.sum("n").over(rising), F.lit(0)))
    hours = steps.groupBy("recorded_at").agg(
        F.sum((F.col("before") * 2 + F.col("n")).cast("decimal(38,0)")).alias("area"), F.count("*").alias("groups"),
        F.sum("n").alias("total"), F.max("n").alias("first"), F.sum("categorised").alias("categorised"),
    )
    pairs = rows.filter("source <> ''").groupBy("recorded_at", "ip").agg(F.min("source").alias("a"), F.max("source").alias("b"))
    cross = pairs.filter("a <> b").groupBy("recorded_at").agg(F.count("ip").alias("cross"))
    made = hours.join(cross, "recorded_at", "left").withColumn("cross", F.coalesce("cross", F.lit(0)))
    uneven = F.lit(1.0) - F.col("area").cast("double") / (F.col("groups").cast("double") * F.col("total").cast("double"))
    return made.select(
        "recorded_at", F.round(uneven, 3).alias("gini_coefficient"), F.round(safe_pct("first", "total"), 1).alias("top_country_pct"),
        F.round(safe_pct("cross", "total"), 1).alias("cross_source_pct"), F.round(safe_pct("categorised", "total"), 1).alias("categorized_pct"),
    )


def start_hourly_snapshots(
    events: DataFrame, table: str, path: str, checkpoint: str, delay: str = DELAY, interval: str | None = None
) -> StreamingQuery:
    """One snapshot row per hour at `path`, when the hour is closed; of the table only the closed hours' days are read."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        ends = batch.agg(F.min("start").alias("low"), F.max("start").alias("high")).first()
        if ends.low is None:
            return
        rows = scan_events(batch.sparkSession, table)
        if "load_date" in rows.columns:
            rows = rows.filter(F.col("load_date").between(F.lit(ends.low.date()), F.lit(ends.high.date())))
        hours = batch.select(F.col("start").alias("recorded_at"))
        write_batch(hourly_snapshots(rows).join(hours, "recorded_at", "left_semi"), path, batch_id, run_of(batch))

    return _written(closed_windows(events, "1 hour", delay=delay), handle, checkpoint, "append", interval)


def snapshot_series(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BRIEFING_SNAPSHOTS).parquet(path).select(*BRIEFING_SNAPSHOTS.names)


def addresses(events: DataFrame) -> DataFrame:
    """Per address: its first row under (loaded_at, event_id), its number of rows and its newest repeat-offence probability.

    On a stream the three are keyed state that every row updates, so they do not depend on how the rows are cut or ordered.
    """
    rest = [c for c in events.columns if c not in ("ip", "loaded_at", "event_id")]
    scored = F.when(F.col("reoffense_probability").isNotNull(), F.struct("loaded_at", "event_id", "reoffense_probability"))
    grouped = events.groupBy("ip").agg(
        F.min(F.struct("loaded_at", "event_id", *rest)).alias("first"), F.count("*").alias("report_count"), F.max(scored).alias("latest")
    )
    return grouped.select("ip", "first", "report_count", F.col("latest.reoffense_probability").alias("latest_score"))


def _newest(changes: DataFrame, columns: list[str]) -> DataFrame:
    """Per address (NULL is one, too) the row of the newest micro-batch, and the micro-batch that brought it first."""
    values = [c for c in columns if c != "ip"]
    kept = changes.groupBy("ip").agg(F.max_by(F.struct(*values), "batch_id").alias("r"), F.min("since").alias("since"))
    return kept.select("ip", *(F.col(f"r.{c}").alias(c) for c in values), "since")


def _changes(spark: SparkSession, path: str, run: str, schema: StructType, upto: int | None = None) -> tuple[DataFrame | None, int]:
    """The last finished fold with all changes since, and the fold's number (-1: none)."""
    folds = [int(f.removeprefix("upto=")) for f in folders(spark, f"{path}/folds/{run}")]
    folds = [n for n in folds if (upto is None or n <= upto) and is_finished(spark, f"{path}/folds/{run}/upto={n}")]
    last = max(folds, default=-1)
    numbers = [int(f.removeprefix("batch_id=")) for f in folders(spark, f"{path}/changes/{run}")]
    places = [f"{path}/changes/{run}/batch_id={n}" for n in numbers if n > last and (upto is None or n <= upto)]
    places += [f"{path}/folds/{run}/upto={last}"] if folds else []
    # each folder is named by itself, so its name is not read as a column
    return (spark.read.schema(schema).parquet(*places) if places else None), last


def start_address_book(events: DataFrame, path: str, checkpoint: str, fold: int = FOLD, interval: str | None = None) -> StreamingQuery:
    """Keep `addresses` at `path`: every micro-batch writes the addresses it has changed.

    Every `fold` batches the changes are merged with the fold before; what an older fold holds goes, the last one stays for
    readers at work. A new checkpoint starts a new book. An address is never forgotten, so the state should lie on disk
    (`build_session` asks for RocksDB).
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, run = batch.sparkSession, f"run={run_of(batch)}"
        number = F.lit(batch_id).cast("long")
        stamped = batch.withColumns({"batch_id": number, "since": number})
        write_batch(stamped, f"{path}/changes", batch_id, run.removeprefix("run="))
        for other in folders(spark, f"{path}/changes"):
            if other != run:
                remove_folder(spark, f"{path}/changes/{other}")
                remove_folder(spark, f"{path}/folds/{other}")
        if batch_id % fold != fold - 1:
            return
        rows, last = _changes(spark, path, run, stamped.schema, batch_id)
        if last == batch_id:
            return
        merged = _newest(rows, batch.columns).withColumn("batch_id", number).select(*stamped.columns)
        merged.write.mode("overwrite").parquet(f"{path}/folds/{run}/upto={batch_id}")
        for old in folders(spark, f"{path}/folds/{run}"):
            if int(old.removeprefix("upto=")) < last:
                remove_folder(spark, f"{path}/folds/{run}/{old}")
        for old in folders(spark, f"{path}/changes/{run}"):
            if int(old.removeprefix("batch_id=")) <= last:
                remove_folder(spark, f"{path}/changes/{run}/{old}")

    return _written(addresses(events), handle, checkpoint, "update", interval)


def address_book(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(ip, first.*, report_count, latest_score, since) as the stream has left them; `columns` are those of its events.

    `since` is the micro-batch that brought the address: those of a batch were unknown before it.
    """
    empty = spark.createDataFrame([], THREAT_EVENTS).select(*columns)
    schema = addresses(empty).schema.add("batch_id", "long").add("since", "long")
    rows = None
    for run in folders(spark, f"{path}/changes"):
        rows, _ = _changes(spark, path, run, schema)
    book = _newest(spark.createDataFrame([], schema) if rows is None else rows, schema.names[:-2])
    return book.select("ip", "first.*", "report_count", "latest_score", "since")
