"""Isolation forest (Liu, Ting, Zhou 2008) as Spark jobs: trees grow in parallel, rows are scored where they lie."""

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ipvigil.constants import CONTAMINATION, ISOLATION_SAMPLE, ISOLATION_TREES, MODEL_SEED
from ipvigil.ml.features import encoder, features, path_normaliser, score_rows
from ipvigil.operators.counts import top_country_codes
from ipvigil.operators.scale import SCORE_WIDTHS, exact_percentiles, uniform_sample
from ipvigil.session import cut_lineage

NODE = "tree_id int, node int, feature int, threshold double, path double"


def _grow(seed: int, max_depth: int):
    """Grower of one tree from at most a few hundred sampled rows. Node k has the children 2k+1 and 2k+2."""

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "event_id"])
        tree_id = int(rows["tree_id"].iloc[0])
        points = np.array(rows["x"].tolist(), dtype=float)
        rng = np.random.default_rng([seed, tree_id])
        nodes = []
        open_nodes = [(0, 0, points)]
        while open_nodes:
            node, depth, inside = open_nodes.pop()
            low, high = inside.min(axis=0), inside.max(axis=0)
            varying = np.flatnonzero(high > low)
            if depth == max_depth or varying.size == 0:
                nodes.append((tree_id, node, -1, 0.0, depth + path_normaliser(len(inside))))
                continue
            feature = int(rng.choice(varying))
            threshold = float(rng.uniform(low[feature], high[feature]))
            left = inside[:, feature] <= threshold
            nodes.append((tree_id, node, feature, threshold, 0.0))
            open_nodes.append((2 * node + 1, depth + 1, inside[left]))
            open_nodes.append((2 * node + 2, depth + 1, inside[~left]))
        return pd.DataFrame(nodes, columns=["tree_id", "node", "feature", "threshold", "path"])

    return grow


def sample_trees(encoded: DataFrame, trees: int, sample: int, seed: int) -> tuple[DataFrame, int]:
    """(rows per tree, sample size). Each tree draws from a fixed-size uniform pool, whatever the table holds."""
    pool = cut_lineage(uniform_sample(encoded, "event_id", trees * sample, seed), "pool")
    size = pool.count()
    per_tree = min(sample, size)
    spread = 1 << 20
    keep = min(spread, int(spread * 2.0 * per_tree / max(size, 1)) + 1)
    drawn = pool.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn(
        "draw", F.xxhash64("event_id", "tree_id")
    )
    likely = drawn.filter(F.pmod("draw", F.lit(spread)) < keep)
    order = Window.partitionBy("tree_id").orderBy("draw", "event_id")
    chosen = likely.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_tree).drop("rank")
    return chosen, per_tree


@dataclass
class IsolationModel:
    encoder: PipelineModel
    nodes: DataFrame
    sample: int
    trees: int
    top_countries: list[str]
    scorer: object = field(default=None, repr=False)

    def encoded(self, prepared: DataFrame) -> DataFrame:
        """Rows with model features plus the numeric vector `x`."""
        return self.encoder.transform(prepared).withColumn("x", vector_to_array("features"))

    def score(self, events: DataFrame, column: str = "anomaly_score") -> DataFrame:
        """Add the anomaly score in (-1, 0): the lower, the stranger. The trees travel to the rows."""
        if self.scorer is None:
            self.scorer = self._scorer()

        def anomaly(prepared: DataFrame) -> DataFrame:
            return self.encoded(prepared).withColumn(column, self.scorer("x"))

        return score_rows(events, self.top_countries, anomaly, column)

    def _scorer(self):
        # at most trees * (4 * sample) nodes, whatever the table holds
        table = self.nodes.toPandas()
        slots = int(table["node"].max()) + 1
        feature = np.full((self.trees, slots), -1, dtype=np.int32)
        threshold = np.zeros((self.trees, slots))
        path = np.zeros((self.trees, slots))
        at = (table["tree_id"].to_numpy(), table["node"].to_numpy())
        feature[at], threshold[at], path[at] = table["feature"], table["threshold"], table["path"]
        model = SparkSession.active().sparkContext.broadcast((feature, threshold, path))
        trees, normaliser = self.trees, path_normaliser(self.sample) or 1.0

        @F.pandas_udf("double")
        def anomaly(vectors: pd.Series) -> pd.Series:
            if len(vectors) == 0:
                return pd.Series([], dtype=float)
            feature, threshold, path = model.value
            points, back = np.unique(np.stack(vectors.to_numpy()), axis=0, return_inverse=True)
            every = np.arange(len(points))
            length = np.zeros(len(points))
            for t in range(trees):
                node = np.zeros(len(points), dtype=np.int64)
                while True:
                    f = feature[t, node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    right = points[every, np.maximum(f, 0)] > threshold[t, node]
                    node = np.where(inner, 2 * node + 1 + right, node)
                length += path[t, node]
            scores = -np.exp2(-(length / trees) / normaliser)
            return pd.Series(np.round(scores, 4)[back.reshape(-1)])

        return anomaly

    def save(self, path: str) -> None:
        self.encoder.write().overwrite().save(f"{path}/encoder")
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        settings = SparkSession.active().createDataFrame(
            [(self.sample, self.trees, self.top_countries)], "sample int, trees int, top_countries array<string>"
        )
        settings.write.mode("overwrite").json(f"{path}/settings")

    @staticmethod
    def load(path: str) -> "IsolationModel":
        spark = SparkSession.active()
        s = spark.read.schema("sample int, trees int, top_countries array<string>").json(f"{path}/settings").first()
        nodes = spark.read.schema(NODE).parquet(f"{path}/nodes")
        return IsolationModel(PipelineModel.load(f"{path}/encoder"), nodes, s.sample, s.trees, list(s.top_countries))


def fit(
    events: DataFrame, trees: int = ISOLATION_TREES, sample: int = ISOLATION_SAMPLE, seed: int = MODEL_SEED
) -> IsolationModel:
    """Grow `trees` trees, each from its own sample. The node table is small and kept in the shared folder."""
    rows = events.select("event_id", "source", "country_code", "category", "risk_level", "abuse_confidence_score")
    top = top_country_codes(rows)
    prepared = features(rows, top)
    model = IsolationModel(encoder().fit(prepared), None, sample, trees, top)
    encoded = model.encoded(prepared).select("event_id", "x")
    drawn, model.sample = sample_trees(encoded, trees, sample, seed)
    depth = int(np.ceil(np.log2(max(model.sample, 2))))
    grown = drawn.groupBy("tree_id").applyInPandas(_grow(seed, depth), NODE)
    model.nodes = cut_lineage(grown, "forest")
    return model


def anomaly_rate(events: DataFrame, column: str = "anomaly_score", contamination: float = CONTAMINATION) -> DataFrame:
    """Share of rows below the contamination quantile (exact for scores of any precision), and whether it is close
    to the target."""
    cutoff = exact_percentiles(events, column, [contamination], SCORE_WIDTHS).agg(F.max("value").alias("q")).scalar()
    scored = events.filter(F.col(column).isNotNull())
    sums = scored.agg(F.count_if(F.col(column) < cutoff).alias("below"), F.count("*").alias("scored"))
    rate = F.round(F.try_divide(F.col("below").cast("double"), F.col("scored").cast("double")), 4)
    return sums.select(
        "scored",
        "below",
        rate.alias("observed_rate"),
        (F.abs(F.lit(contamination) - rate) < 0.01).alias("calibrated"),
    )
