"""The event table on storage: reading, loading by batch, and companion tables."""

import uuid
from datetime import date, datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ipvigil.constants import MODEL_SEED, REPLAY_POOL_SIZE
from ipvigil.operators.scale import uniform_sample
from ipvigil.schema import BRIEFING_SNAPSHOTS, PIPELINE_METRICS, THREAT_EVENTS, conform

#: Bytes of a row group in rewritten days.
ROW_GROUP = 32 << 20

TABLES = {
    "threat_events": THREAT_EVENTS,
    "pipeline_metrics": PIPELINE_METRICS,
    "briefing_snapshots": BRIEFING_SNAPSHOTS,
}


def create_tables(spark: SparkSession, base: str) -> None:
    """Create the tables that are missing, empty and with their declared columns."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{base}/{name}")


def scan_events(
    spark: SparkSession, path: str, columns: list[str] | None = None, since: datetime | None = None
) -> DataFrame:
    """The event table with its declared columns: no file is opened to learn them, and files written before a
    column existed read as NULL there.

    A table in daily folders keeps `load_date`, the day of `loaded_at`, as its last column; reports on the newest
    events use it to read the last days' folders alone. `since` keeps rows loaded from that time on.
    """
    rows = spark.read.schema(THREAT_EVENTS).parquet(path)
    if {"load_date", "run"} <= set(rows.columns):
        # of a day either the batches or what `compact_days` has made of them; both are whole folders
        rewritten = F.col("load_date").cast("string").isin(compacted_days(spark, path))
        rows = rows.filter(rewritten == (F.col("run") == "compacted"))
    if since is not None:
        if "load_date" in rows.columns:
            rows = rows.filter(F.col("load_date") >= F.lit(since.date()))
        rows = rows.filter(F.col("loaded_at") >= F.lit(since).cast("timestamp_ntz"))
    if "load_date" in rows.columns:
        rows = rows.withColumn("load_date", F.col("load_date").cast("date"))
    return rows.select(*(columns or [c for c in (*THREAT_EVENTS.names, "load_date") if c in rows.columns]))


def scan_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int, partitions: int, **options) -> DataFrame:
    """The same table in a relational database, read in parallel ranges of a numeric column."""
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=table,
        partitionColumn=partition_column,
        lowerBound=str(lower),
        upperBound=str(upper),
        numPartitions=str(partitions),
        **options,
    )
    return reader.load()


def batch_path(path: str, batch_id: int, run: str, day: date | None = None) -> str:
    base = f"{path}/load_date={day.isoformat()}" if day else path
    return f"{base}/run={run}/batch_id={batch_id}"


def write_batch(rows: DataFrame, path: str, batch_id: int, run: str, day: date | None = None) -> None:
    """Load one batch; loading the same batch again replaces it.

    The batch owns its folder, so no other file is touched and no reader sees it twice. `run` names the checkpoint
    whose batch numbers are meant: every checkpoint counts from 0.
    """
    rows.write.mode("overwrite").parquet(batch_path(path, batch_id, run, day))


def stored(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """The files at `path`, None if there is no such folder; any other trouble is an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def batch_exists(spark: SparkSession, path: str, batch_id: int, run: str, schema: StructType = PIPELINE_METRICS) -> bool:
    """Whether a batch was written; a folder without rows is what an unfinished attempt has left."""
    rows = stored(spark, batch_path(path, batch_id, run), schema)
    return rows is not None and not rows.isEmpty()


def _link(log: str, n: int) -> str:
    return f"{log}/_chain/{n:012d}"


def start_of(spark: SparkSession, log: str, batch_id: int, run: str, rows: int) -> tuple[datetime, int]:
    """Load time (UTC) and first event_id of a batch, noted before its first attempt, so that a retry gets the same.

    Ids follow those of all batches of all runs. Each reserved range is a link of a chain of small files, of which the next
    one is put in place only if it is not there yet; of two writers that want the same link one goes on to the next. The
    number of the last link is kept beside the chain, so a reservation reads a few files however old the log is. A writer
    that dies between link and note leaves a gap in the ids.

    Putting a file in place if it is absent is atomic on HDFS; object stores need a committer or table service for that.
    """
    own = f"{batch_path(log, batch_id, run)}/note"
    while (noted := read_text(spark, own)) is None:
        last = int(read_text(spark, f"{log}/_last") or 0)
        while (link := read_text(spark, _link(log, last + 1))) is not None:
            last += 1
        link = read_text(spark, _link(log, last)) if last else "0"
        first = int(link.split(" ")[0])
        loaded_at = datetime.now(timezone.utc).replace(tzinfo=None)
        if put_text(spark, _link(log, last + 1), f"{first + rows} {run} {batch_id}"):
            put_text(spark, f"{log}/_last", str(last + 1), replace=True)
            put_text(spark, own, f"{loaded_at.isoformat()} {first}")
    loaded_at, first = noted.split(" ")
    return datetime.fromisoformat(loaded_at), int(first)


def with_event_ids(batch: DataFrame, first_id: int) -> DataFrame:
    """Number the rows of a persisted batch from `first_id` on, without sorting or collecting them.

    Only the partition sizes (one row each) are summed in order.
    """
    place = F.monotonically_increasing_id()
    tagged = batch.withColumns({"part": F.shiftright(place, 33), "place": place.bitwiseAND((1 << 33) - 1)})
    sizes = tagged.groupBy("part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = tagged.join(F.broadcast(offsets), "part")
    event_id = F.lit(first_id).cast("bigint") + F.col("before") + F.col("place")
    return numbered.select(event_id.alias("event_id"), *batch.columns)


def _storage(spark: SparkSession, path: str):
    """The file system of a path and the path itself, of the public Hadoop API."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    files, place = _storage(spark, path)
    if not files.exists(place):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(place) if f.isDirectory())


def is_finished(spark: SparkSession, path: str) -> bool:
    """Whether what was written to a folder was committed."""
    files, place = _storage(spark, f"{path}/_SUCCESS")
    return files.exists(place)


def remove_folder(spark: SparkSession, path: str) -> None:
    files, place = _storage(spark, path)
    files.delete(place, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file; None if it is not there."""
    files, place = _storage(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Put a small file in place at once, complete; without `replace` only if there is none: False if there was one."""
    jvm = spark._jvm.org.apache.hadoop.fs
    files, ready = _storage(spark, f"{path}.{uuid.uuid4().hex}")
    stream = files.create(ready, False)
    stream.write(text.encode())
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, int(replace))
    if replace:
        options[0] = jvm.Options.Rename.OVERWRITE
    try:
        context = jvm.FileContext.getFileContext(files.makeQualified(ready).toUri(), spark._jsc.hadoopConfiguration())
        context.rename(files.makeQualified(ready), files.makeQualified(jvm.Path(path)), options)
    except Py4JJavaError as e:
        files.delete(ready, False)
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def compacted_days(spark: SparkSession, path: str) -> list[str]:
    """The days (yyyy-mm-dd) that readers take in their rewritten form."""
    return (read_text(spark, f"{path}/_compacted") or "").split()


def compact_days(spark: SparkSession, path: str, before: date, metrics: str | None = None, row_group: int = ROW_GROUP) -> list[str]:
    """Rewrite every day before `before` (a day that gets no more batches) from one folder per batch to one folder.

    Its files are sorted by address, in row groups of `row_group` bytes with a Bloom filter of the addresses, so a look-up of
    one address opens few of them. A day counts as rewritten once it stands in a list that `scan_events` follows; until then
    its batches count. They are removed by the next call, for readers at work. With `metrics`, days with a batch that is
    not complete are left for later. Returns the days it rewrote.
    """
    listed, done = compacted_days(spark, path), []
    for name in folders(spark, path):
        day, folder = name.removeprefix("load_date="), f"{path}/{name}"
        if name == day or day >= before.isoformat():
            continue
        runs = [r for r in folders(spark, folder) if r != "run=compacted"]
        if day in listed:
            for run in runs:
                remove_folder(spark, f"{folder}/{run}")
            continue
        batches = [f"{run}/{batch}" for run in runs for batch in folders(spark, f"{folder}/{run}")]
        if metrics and not all(is_finished(spark, f"{metrics}/{b}") for b in batches):
            continue
        reader = spark.read.schema(THREAT_EVENTS).option("basePath", folder)
        rows = reader.parquet(*(f"{folder}/{b}" for b in batches)).select(*THREAT_EVENTS.names)
        rows = rows.repartitionByRange("ip").sortWithinPartitions("ip", "loaded_at", "event_id")
        writer = rows.write.mode("overwrite").option("parquet.block.size", row_group)
        writer.option("parquet.bloom.filter.enabled#ip", "true").parquet(f"{folder}/run=compacted/batch_id=0")
        done.append(day)
        put_text(spark, f"{path}/_compacted", "\n".join([*listed, *done]), replace=True)
    return done


def append_snapshot(row: DataFrame, path: str) -> None:
    conform(row, BRIEFING_SNAPSHOTS).coalesce(1).write.mode("append").parquet(path)


def replay_pool(events: DataFrame, n: int = REPLAY_POOL_SIZE, seed: int = MODEL_SEED) -> DataFrame:
    """A uniform sample of the events since the first categorised one, in order of report time."""
    since = events.filter(F.col("category").isNotNull()).agg(F.min("last_reported_at").alias("t")).scalar()
    eligible = events.filter(F.col("last_reported_at") >= since)
    return uniform_sample(eligible, "event_id", n, seed).orderBy("last_reported_at", "event_id")
