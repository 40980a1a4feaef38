"""Building blocks that keep an operator safe when one key, or one answer, is very large."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


SLICES = 64


def latest_per_key(rows: DataFrame, key: str, time: str = "landed_at") -> DataFrame:
    """One row per key: the one with the largest `time` if there is such a column, ties by the other columns.

    Landed lookup answers repeat a key every time it is looked up; joining them as they are would multiply rows.
    Map tasks keep one row per key, so a key that is looked up very often costs one row per task.
    """
    rest = [c for c in rows.columns if c not in (key, time)]
    order = [time, *rest] if time in rows.columns else rest
    kept = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order)).alias("latest"))
    return kept.select(key, *[F.col("latest")[c].alias(c) for c in order if c != time])


def top_n_per_key(
    df: DataFrame, key: str, order: Sequence[Column], n: int, row_id: str, slices: int = SLICES
) -> DataFrame:
    """The first `n` rows of every key under a total order, numbered in `rank`.

    Every key is cut in slices by a hash of the row id. Map tasks and then slices are trimmed to n rows, and only what
    is left of a key meets in one task: n rows per slice at most, however hot the key is.
    """

    def ranked(rows: DataFrame, *partition: str) -> DataFrame:
        window = Window.partitionBy(*partition).orderBy(*order)
        return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)

    sliced = df.withColumn("slice", F.pmod(F.xxhash64(row_id), F.lit(slices)))
    return ranked(ranked(sliced, key, "slice").drop("slice", "rank"), key)


def ordered_head(df: DataFrame, coarse: Column, order: Sequence[Column], n: int, descending: bool = False) -> DataFrame:
    """The first `n` rows under `order`, for an n too large to keep in every task of a very large scan.

    `coarse` must never decrease along the order (never increase if descending) and take few distinct values.
    Rows are counted per coarse value, which yields the last value that can still contribute; only rows up to
    there are sorted.
    """
    marked = df.withColumn("coarse", coarse)
    direction = F.col("coarse").desc_nulls_first() if descending else F.col("coarse").asc_nulls_first()
    counted = marked.groupBy("coarse").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy(direction).rowsBetween(Window.unboundedPreceding, -1))
    needed = counted.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < n)
    limit = needed.agg((F.min if descending else F.max)("coarse").alias("limit")).scalar()
    within = F.col("coarse") >= limit if descending else F.col("coarse") <= limit
    return marked.filter(F.col("coarse").isNull() | within).orderBy(*order).limit(n).drop("coarse")


def newest(df: DataFrame, n: int, time: str = "loaded_at", row_id: str = "event_id") -> DataFrame:
    """The newest `n` rows; equal times are ordered by row id.

    A table in daily folders (`load_date`, the day of `time`) is counted by day first, which reads no column, and only
    the folders of the last days that hold n rows are read.
    """
    order = [F.col(time).desc_nulls_first(), F.col(row_id).desc()]
    if "load_date" in df.columns:
        days = df.groupBy("load_date").agg(F.count("*").alias("rows"))
        later = F.sum("rows").over(Window.orderBy(F.desc("load_date")).rowsBetween(Window.unboundedPreceding, -1))
        needed = days.withColumn("later", F.coalesce(later, F.lit(0))).filter(F.col("later") < n)
        df = df.filter(F.col("load_date") >= needed.agg(F.min("load_date").alias("d")).scalar())
    return ordered_head(df, F.date_trunc("hour", F.col(time)).cast("timestamp_ntz"), order, n, descending=True)


def uniform_sample(df: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """Exactly min(n, rows) rows, uniform without replacement and the same on every run."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")).cast("binary"))
    drawn = df.withColumn("draw", digest)
    head = ordered_head(drawn, F.substring("draw", 1, 4), [F.col("draw"), F.col(row_id)], n)
    return head.drop("draw")


#: Bucket widths for scores between -1 and 1.
SCORE_WIDTHS = (1e-3, 1e-6)


def exact_percentiles(df: DataFrame, value: str, shares: Sequence[float], widths: Sequence[float]) -> DataFrame:
    """Interpolated percentiles of a numeric column as rows (share, value, n), exact at any size.

    The ranks are located level by level: values are counted in buckets of widths[0], then only those in a bucket that
    holds a rank in buckets of widths[1], and so on down to single values. Each level is one scan of one column; what
    is counted joins the distinct buckets that are looked for, so a row counts once however many ranks share its bucket.
    """
    values = df.select(F.col(value).alias("v")).filter("v IS NOT NULL")

    def bucket(width: float | None) -> Column:
        return F.floor(F.col("v") / F.lit(width)) if width else F.col("v")

    counted = values.groupBy(bucket(widths[0]).alias("bucket")).agg(F.count("*").alias("rows"))
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    total = counted.agg(F.sum("rows").alias("n")).scalar()
    ends = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.lit(side).alias("side")) for s in shares for side in ("low", "high")])
    placed = counted.withColumn("upto", F.sum("rows").over(running)).withColumn("n", total)
    wanted = placed.select("bucket", "rows", "upto", "n", F.explode(ends).alias("w")).select("bucket", "rows", "upto", "n", "w.*")
    position = F.col("share") * (F.col("n") - 1)
    rank = F.when(F.col("side") == "low", F.floor(position)).otherwise(F.ceil(position))
    wanted = wanted.withColumns({"rank": rank.cast("bigint"), "fraction": position - F.floor(position)})

    def hit(rows: DataFrame) -> DataFrame:
        """Two rows per share: the bucket its rank lies in, and the rank inside that bucket."""
        before = F.col("upto") - F.col("rows")
        inside = rows.filter((F.col("rank") >= before) & (F.col("rank") < F.col("upto")))
        return inside.withColumn("rank", F.col("rank") - before).drop("upto", "rows")

    located = hit(wanted)
    per_bucket = Window.partitionBy("outer").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    for outer, inner in zip(widths, [*widths[1:], None]):
        sought = located.select(F.col("bucket").alias("outer")).distinct()
        near = values.withColumn("outer", bucket(outer)).join(F.broadcast(sought), "outer")
        finer = near.groupBy("outer", bucket(inner).alias("bucket")).agg(F.count("*").alias("rows"))
        finer = finer.withColumn("upto", F.sum("rows").over(per_bucket))
        located = hit(F.broadcast(located.withColumnRenamed("bucket", "outer")).join(finer, "outer")).drop("outer")
    found = located.groupBy("share", "n").agg(
        F.max(F.when(F.col("side") == "low", F.col("bucket"))).alias("low"),
        F.max(F.when(F.col("side") == "high", F.col("bucket"))).alias("high"),
        F.max("fraction").alias("fraction"),
    )
    return found.select("share", (F.col("low") + (F.col("high") - F.col("low")) * F.col("fraction")).alias("value"), "n")
