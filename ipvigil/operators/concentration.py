"""How unevenly events spread over groups."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 65_536


def _histogram(counted: DataFrame, n: str) -> DataFrame:
    """(size, groups of that size, groups before, events before), by rising size.

    N events can form at most sqrt(2 N) groups of different size, so the ordered pass stays small however
    many groups there are.
    """
    sizes = counted.groupBy(F.col(n).cast("bigint").alias("size")).agg(F.count("*").alias("groups"))
    wide = sizes.withColumn("mass", F.col("size").cast("decimal(20,0)") * F.col("groups").cast("decimal(18,0)"))
    earlier = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    return wide.select(
        "size",
        "groups",
        F.col("mass").cast("decimal(38,0)").alias("mass"),
        F.coalesce(F.sum("groups").over(earlier), F.lit(0)).alias("groups_before"),
        F.coalesce(F.sum("mass").over(earlier), F.lit(0)).cast("decimal(38,0)").alias("mass_before"),
    )


def gini(counted: DataFrame, n: str = "n") -> DataFrame:
    """One row (gini, groups): 0 for evenly spread groups, towards 1 when one owns all; 0 without events.

    The doubled area under the Lorenz curve is summed in whole numbers, so the answer does not depend on the
    order of summation.
    """
    steps = _histogram(counted, n)
    doubled = F.col("groups") * (F.col("mass_before") * 2 + F.col("mass"))
    sums = steps.agg(
        F.sum(doubled.cast("decimal(38,0)")).alias("area"),
        F.sum("groups").alias("groups"),
        F.sum("mass").alias("mass"),
    )
    scale = F.col("groups").cast("double") * F.col("mass").cast("double")
    value = F.lit(1.0) - F.try_divide(F.col("area").cast("double"), scale)
    return sums.select(F.coalesce(value, F.lit(0.0)).alias("gini"), F.coalesce("groups", F.lit(0)).alias("groups"))


def lorenz(counted: DataFrame, n: str = "n") -> DataFrame:
    """Points (position, pct_groups, pct_events) from (0, 0) to (100, 100), one per group and the origin.

    Groups of equal size lie on one straight segment, so the points follow from the size histogram without
    sorting the groups. Long segments are cut into chunks that spread over the cluster.
    """
    steps = _histogram(counted, n)
    whole = steps.agg(F.sum("groups").alias("g"), F.sum("mass").alias("m"))
    chunks = steps.withColumn(
        "first", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("groups"), F.lit(CHUNK).cast("bigint")))
    ).repartition("size", "first")
    last = F.least(F.col("first") + (CHUNK - 1), F.col("groups"))
    points = chunks.withColumn("j", F.explode(F.sequence("first", last)))
    position = F.col("groups_before") + F.col("j")
    events = F.col("mass_before") + (F.col("j") * F.col("size")).cast("decimal(38,0)")
    groups_total = whole.select("g").scalar().cast("double")
    events_total = whole.select("m").scalar().cast("double")
    curve = points.filter(events_total > 0).select(
        position.cast("bigint").alias("position"),
        (position.cast("double") * 100.0 / groups_total).alias("pct_groups"),
        (events.cast("double") * 100.0 / events_total).alias("pct_events"),
    )
    origin = whole.filter("m > 0").select(
        F.lit(0).cast("bigint").alias("position"), F.lit(0.0).alias("pct_groups"), F.lit(0.0).alias("pct_events")
    )
    return origin.unionByName(curve)
