"""Training rows, model features and the stratified split."""

import math
from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ipvigil.constants import CATEGORICAL_FEATURES, MODEL_SEED, NUMERIC_FEATURES, TEST_SHARE
from ipvigil.functions.columns import country_bucket, fill_feature_defaults
from ipvigil.operators.addresses import first_sighting

SIGHTING = ["source", "country_code", "abuse_confidence_score", "risk_level", "category"]


def train_set(events: DataFrame) -> DataFrame:
    """What was known at the first sighting of each address, and whether it came back."""
    first = first_sighting(events.select("ip", "loaded_at", "event_id", *SIGHTING))
    return first.select("ip", *SIGHTING, (F.col("report_count") > 1).cast("int").alias("reoffended"))


def features(rows: DataFrame, top_countries: Sequence[str]) -> DataFrame:
    bucketed = rows.withColumn("country_bucket", country_bucket("country_code", top_countries))
    return fill_feature_defaults(bucketed)


def encoder() -> Pipeline:
    """One-hot columns and the score as one vector; a value not seen in training is all zeros.

    The indexer brings the distinct values of each feature to the driver: lists of feeds, categories, 15 countries and
    four levels, which do not grow with the events.
    """
    indexed = [f"{c}_index" for c in CATEGORICAL_FEATURES]
    hot = [f"{c}_hot" for c in CATEGORICAL_FEATURES]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=CATEGORICAL_FEATURES, outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
            VectorAssembler(inputCols=[*hot, *NUMERIC_FEATURES], outputCol="features"),
        ]
    )


def class_weights(rows: DataFrame, label: str = "reoffended") -> DataFrame:
    """Add `weight` = rows / (classes * rows of the class)."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    whole = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, F.lit(whole / (len(counts) * n))).otherwise(weight)
    return rows.withColumn("weight", weight)


MODEL_COLUMNS = [*CATEGORICAL_FEATURES, *NUMERIC_FEATURES]


def combine(rows: DataFrame, label: str = "reoffended", weight: str = "weight") -> DataFrame:
    """One row per combination of features and label, its weight summed.

    For a model whose loss is a weighted sum over rows this is the same training set, and its size depends on
    the feature values in use, not on the number of addresses.
    """
    return rows.groupBy(*MODEL_COLUMNS, label).agg(F.sum(weight).alias(weight))


def score_rows(
    rows: DataFrame, top_countries: Sequence[str], score: Callable[[DataFrame], DataFrame], column: str
) -> DataFrame:
    """Add a model's score to `rows`, row by row where they lie: one pass, no shuffle, the same plan at any size."""
    kept = [F.col(c) for c in rows.columns if c != column]
    packed = rows.select(F.struct(*kept).alias("row"), *kept)
    prepared = features(packed, top_countries).select("row", *MODEL_COLUMNS)
    return score(prepared).select("row.*", column)


def split_sizes(counted: DataFrame, label: str, share: float = TEST_SHARE) -> DataFrame:
    """(label, n, test_n): the test share rounded up overall, divided over classes by largest remainder."""
    whole = counted.agg(F.sum("n").alias("n")).scalar().cast("decimal(18,0)")
    wanted = F.ceil(F.round(whole.cast("double") * F.lit(share), 9)).cast("decimal(18,0)")
    product = (F.col("wanted") * F.col("n").cast("decimal(18,0)")).cast("decimal(37,0)")
    quota = counted.withColumn("wanted", wanted).withColumn("rest", (product % whole).cast("decimal(37,0)"))
    quota = quota.withColumn("base", ((product - F.col("rest")) / whole).cast("bigint"))
    order = Window.orderBy(F.col("rest").desc(), F.col(label))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = quota.withColumn("place", F.row_number().over(order)).withColumn(
        "left", F.col("wanted").cast("bigint") - F.sum("base").over(everything)
    )
    extra = (F.col("place") <= F.col("left")).cast("bigint")
    return placed.select(label, "n", (F.col("base") + extra).cast("bigint").alias("test_n"))


def stratified_split(
    rows: DataFrame, key: str = "ip", label: str = "reoffended", share: float = TEST_SHARE, seed: int = MODEL_SEED
) -> DataFrame:
    """Add is_test with exact class sizes, the same on every run.

    Rows are ordered by a hash and counted per hash prefix and class; only the prefix that contains the cut is
    ordered row by row, so no task sorts a whole class.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    marked = rows.withColumn("draw", digest).withColumn("bucket", F.substring("draw", 1, 4))
    counted = marked.groupBy(label, "bucket").agg(F.count("*").alias("rows"))
    sizes = split_sizes(counted.groupBy(label).agg(F.sum("rows").alias("n")), label, share)
    running = Window.partitionBy(label).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("upto", F.sum("rows").over(running)).join(F.broadcast(sizes), label)
    # one row per class
    cut = upto.filter((F.col("upto") >= F.col("test_n")) & (F.col("upto") - F.col("rows") < F.col("test_n"))).select(
        label, F.col("bucket").alias("cut"), (F.col("test_n") - F.col("upto") + F.col("rows")).alias("remaining")
    )
    near = marked.join(F.broadcast(cut), label, "left")
    decided = near.filter(F.col("cut").isNull() | (F.col("bucket") != F.col("cut"))).withColumn(
        "is_test", F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False))
    )
    order = Window.partitionBy(label).orderBy("draw", key)
    at_cut = near.filter(F.col("bucket") == F.col("cut")).withColumn(
        "is_test", F.row_number().over(order) <= F.col("remaining")
    )
    return decided.unionByName(at_cut).drop("draw", "bucket", "cut", "remaining")


def path_normaliser(n: float) -> float:
    """Average path length of an unsuccessful search among n points (Liu, Ting, Zhou 2008)."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n
