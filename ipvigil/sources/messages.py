"""The raw message stream: where it is read from and how a message is parsed."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ipvigil.schema import RAW_MESSAGE

VALUE_SCHEMA = "value string"
PARSED = StructType([*RAW_MESSAGE.fields, StructField("_corrupt", StringType())])


def bus(spark: SparkSession, fmt: str = "kafka", streaming: bool = True, schema=None, **options: str) -> DataFrame:
    """A frame with a text column `value` per message, read from the earliest position.

    fmt="kafka" needs the public Kafka connector on the class path; any file format works without it, with
    options such as path and maxFilesPerTrigger.
    """
    reader = (spark.readStream if streaming else spark.read).format(fmt)
    if fmt == "kafka":
        options = {"startingOffsets": "earliest", **{k.replace("_", "."): v for k, v in options.items()}}
    elif fmt != "text":
        reader = reader.schema(schema or VALUE_SCHEMA)
    loaded = reader.options(**options).load()
    return loaded.withColumn("value", F.col("value").cast("string")) if "value" in loaded.columns else loaded


def parse_message(raw: DataFrame, on_malformed: str = "mark", keep: Sequence[str] = ()) -> DataFrame:
    """Typed message columns from JSON text, after the columns of `raw` named in `keep`. No message is lost.

    Text that is no valid message becomes a row of NULLs. on_malformed="mark" adds a column `malformed` with that text
    (NULL for valid messages), by which the sinks tell such rows apart; "keep" leaves the column out.
    """
    # through explode the text is parsed once, however many columns and filters use the result
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = raw.select("*", F.explode(F.array(F.from_json("value", PARSED, options))).alias("data"))
    rows = parsed.select(*keep, "data.*", "value", F.col("data").isNull().alias("_empty"))
    if on_malformed == "mark":
        broken = F.col("_empty") | F.col("_corrupt").isNotNull()
        rows = rows.withColumn("malformed", F.when(broken, F.coalesce("value", F.lit(""))))
    return rows.drop("_corrupt", "_empty", *([] if "value" in keep else ["value"]))


def quarantined(rows: DataFrame) -> DataFrame:
    """The text of the malformed messages among marked rows."""
    return rows.filter(F.col("malformed").isNotNull()).select(F.col("malformed").alias("value"))


def valid(rows: DataFrame) -> DataFrame:
    """Marked rows without the malformed ones; frames that are not marked pass as they are."""
    return rows.filter(F.col("malformed").isNull()).drop("malformed") if "malformed" in rows.columns else rows


def to_bus(events: DataFrame, columns: list[str]) -> DataFrame:
    """Outgoing messages: address as key, the named columns as JSON; malformed text goes on without a key."""
    body = F.to_json(F.struct(*columns))
    if "malformed" in events.columns:
        body = F.when(F.col("malformed").isNull(), body).otherwise(F.to_json(F.struct("malformed")))
    return events.select(F.col("ip").alias("key"), body.alias("value"))
