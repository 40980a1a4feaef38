"""Blocklist feeds: parsing of landed payloads and the choice of new addresses."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ipvigil.constants import BULK_MIN_SCORE, BULK_SOURCE, FEED_SAMPLE_SIZE, MODEL_SEED, NEW_IPS_PER_SOURCE
from ipvigil.operators.scale import uniform_sample
from ipvigil.schema import BULK_PAYLOAD, DIM_FEED, RAW_MESSAGE, conform


def bulk_entries(payloads: DataFrame, min_score: float = BULK_MIN_SCORE, source: str = BULK_SOURCE) -> DataFrame:
    """Messages from bulk payloads (data: array of entries); entries below the confidence bound are left out.

    `payloads` needs the columns data and ingested_at.
    """
    entries = payloads.select(F.explode("data").alias("e"), "ingested_at")
    kept = entries.filter(F.col("e.abuseConfidenceScore") >= min_score)
    return kept.select(
        F.col("e.ipAddress").alias("ip"),
        F.col("e.countryCode").alias("country_code"),
        F.col("e.abuseConfidenceScore").cast("double").alias("abuse_confidence_score"),
        F.col("e.lastReportedAt").alias("last_reported_at"),
        F.lit(source).alias("source"),
        F.col("ingested_at").cast("double").alias("ingested_at"),
        F.lit(None).cast("string").alias("category"),
    )


def read_bulk(spark: SparkSession, path: str, ingested_at: float, **options) -> DataFrame:
    payloads = spark.read.schema(BULK_PAYLOAD).json(path, multiLine=True)
    return bulk_entries(payloads.withColumn("ingested_at", F.lit(ingested_at)), **options)


def list_entries(lines: DataFrame, text: str = "value") -> DataFrame:
    """Address per usable line: blank and '#' lines dropped, first word kept."""
    word = F.regexp_extract(F.col(text), r"^\s*(\S+)", 1)
    return lines.withColumn("ip", word).filter((F.col("ip") != "") & ~F.col("ip").startswith("#")).drop(text)


def read_list(spark: SparkSession, path: str, source: str, list_name: str) -> DataFrame:
    """A landed text list with `pos`, which sorts in line order: by file, by split, and inside a split."""
    lines = spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("pos"),
    )
    return list_entries(lines).withColumns({"source": F.lit(source), "list_name": F.lit(list_name)})


def feed_table(spark: SparkSession, feeds: list[tuple]) -> DataFrame:
    return spark.createDataFrame(feeds, DIM_FEED)


def tag(entries: DataFrame, dim_feed: DataFrame) -> DataFrame:
    """Category and score of the list an address came from."""
    labels = dim_feed.select("source", "list_name", "category", F.col("score").alias("abuse_confidence_score"))
    return entries.join(labels, ["source", "list_name"])


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """All producers write the same messages; columns a feed lacks are NULL."""
    return reduce(DataFrame.unionByName, [conform(f, RAW_MESSAGE) for f in feeds])


def known_ips(events: DataFrame, source: str) -> DataFrame:
    return events.filter(F.col("source") == source).select("ip").distinct()


def new_ips(entries: DataFrame, known: DataFrame, n: int = NEW_IPS_PER_SOURCE) -> DataFrame:
    """The first n addresses in list order that are not known yet. One shuffle by address serves both steps."""
    first = entries.groupBy("ip").agg(F.min("pos").alias("pos"))
    return first.join(known.select("ip"), "ip", "left_anti").orderBy("pos").limit(n)


def new_ips_by_list(entries: DataFrame, known: DataFrame, caps: list[int]) -> DataFrame:
    """New addresses over prioritised lists (priority 1..len(caps)), at most caps[i] from list i.

    An address counts as taken only when chosen, so one cut off in an early list may still come in by a later
    one. List i can lose at most the addresses chosen before it, which bounds how many of its entries can
    matter; the greedy choice then runs over that small array in one expression.
    """
    reach = [sum(caps[: i + 1]) for i in range(len(caps))]
    priority = F.col("priority")
    first = entries.filter(priority.between(1, len(caps))).groupBy("ip", "priority").agg(F.min("pos").alias("pos"))
    unknown = first.join(known.select("ip"), "ip", "left_anti")
    order = Window.partitionBy("priority").orderBy("pos", "ip")
    depth = F.element_at(F.array(*[F.lit(r) for r in reach]), priority)
    close = unknown.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(reach)).filter(
        F.col("rank") <= depth
    )
    candidates = close.agg(
        F.sort_array(F.collect_list(F.struct("priority", "rank", "ip", "pos"))).alias("c")
    )
    limits = F.array(*[F.lit(c) for c in caps])
    empty = F.filter("c", lambda e: F.lit(False))

    def take(chosen, e):
        open_slot = F.size(F.filter(chosen, lambda x: x["priority"] == e["priority"])) < F.element_at(limits, e["priority"])
        unseen = ~F.exists(chosen, lambda x: x["ip"] == e["ip"])
        return F.when(open_slot & unseen, F.concat(chosen, F.array(e))).otherwise(chosen)

    return candidates.select(F.inline(F.aggregate("c", empty, take))).select("ip", "priority", "pos")


def sample(entries: DataFrame, row_id: str, n: int = FEED_SAMPLE_SIZE, seed: int = MODEL_SEED) -> DataFrame:
    return uniform_sample(entries, row_id, n, seed)
