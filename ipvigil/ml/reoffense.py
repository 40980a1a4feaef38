"""Will an address come back? Two classifiers on first-sighting features."""

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ipvigil.constants import FOREST_BINS, FOREST_DEPTH, FOREST_TREES, LR_ITERATIONS, MODEL_SEED, NUMERIC_FEATURES
from ipvigil.functions.columns import safe_pct
from ipvigil.ml.features import (
    MODEL_COLUMNS,
    class_weights,
    combine,
    encoder,
    features,
    score_rows,
    stratified_split,
    train_set,
)
from ipvigil.operators.counts import top_country_codes
from ipvigil.operators.scale import exact_percentiles
from ipvigil.session import cut_lineage, shared_folder


def logistic_regression(n: int) -> LogisticRegression:
    """L2-regularised with unit strength against the summed loss of n rows; the intercept is not penalised."""
    return LogisticRegression(
        labelCol="reoffended", weightCol="weight", maxIter=LR_ITERATIONS, regParam=1.0 / max(n, 1), standardization=False
    )


def random_forest(trees: int = FOREST_TREES, depth: int = FOREST_DEPTH) -> RandomForestClassifier:
    """Every row keeps the node it has reached in each tree, so a level does not walk down from the roots again."""
    return RandomForestClassifier(
        labelCol="reoffended", weightCol="weight", numTrees=trees, maxDepth=depth, seed=MODEL_SEED, maxMemoryInMB=512, cacheNodeIds=True
    )


class FlatForest:
    """The trees of a forest as arrays: children, split and class-1 share of every node, root first.

    A one-hot column is split by its set of values (0, 1), the score by a threshold; both become "greater than" here.
    """

    def __init__(self, nodes: pd.DataFrame):
        """`nodes` (tree, id, feature, threshold, left, right, share) with ids from 0 in each tree, -1 for no feature."""
        nodes = nodes.sort_values(["tree", "id"])
        self.first = nodes.groupby("tree", sort=True)["id"].size().cumsum().shift(fill_value=0).to_numpy()
        base = np.repeat(self.first, np.diff([*self.first, len(nodes)]))
        self.feature, self.threshold, self.share = (nodes[c].to_numpy() for c in ("feature", "threshold", "share"))
        self.left, self.right = (nodes[c].to_numpy() + base for c in ("left", "right"))
        # the features in use with their thresholds in order, and each node's place in both
        inner = self.feature >= 0
        self.used = np.unique(self.feature[inner])
        self.cuts = [np.unique(self.threshold[self.feature == f]) for f in self.used]
        self.column = np.where(inner, np.searchsorted(self.used, self.feature), -1)
        self.cut = np.zeros(len(nodes), dtype=np.int64)
        for at, cuts in enumerate(self.cuts):
            self.cut[self.column == at] = np.searchsorted(cuts, self.threshold[self.column == at])

    @staticmethod
    def of(model: RandomForestClassificationModel, folder: str) -> "FlatForest":
        """From a fitted model, by the files it is saved as; they hold at most trees * 2^(depth + 1) nodes."""
        model.write().overwrite().save(folder)
        data = SparkSession.active().read.parquet(f"{folder}/data")
        split = F.col("nodeData.split")
        value = F.when(split["numCategories"] == -1, F.get(split["leftCategoriesOrThreshold"], F.lit(0)))
        # two values: those with 0 on the left are parted at 0.5, those with 1 on the left the other way round
        swapped = (split["numCategories"] != -1) & ~F.array_contains(split["leftCategoriesOrThreshold"], F.lit(0.0))
        stats = F.col("nodeData.impurityStats")
        left, right = F.col("nodeData.leftChild"), F.col("nodeData.rightChild")
        rows = data.select(
            F.col("treeID").alias("tree"), F.col("nodeData.id").alias("id"),
            F.when(left < 0, -1).otherwise(split["featureIndex"]).alias("feature"), F.coalesce(value, F.lit(0.5)).alias("threshold"),
            F.when(swapped, right).otherwise(left).alias("left"), F.when(swapped, left).otherwise(right).alias("right"),
            (stats[1] / (stats[0] + stats[1])).alias("share"),
        )
        return FlatForest(rows.toPandas())

    def places(self, points: np.ndarray) -> np.ndarray:
        """For each used feature, how many of its thresholds lie below a row's value; for NaN, none."""
        most = max((len(cuts) for cuts in self.cuts), default=0)
        found = np.zeros((len(points), len(self.used)), dtype=np.uint8 if most < 256 else np.int32)
        for at, (feature, cuts) in enumerate(zip(self.used, self.cuts)):
            values = points[:, feature]
            found[:, at] = np.where(np.isnan(values), 0, np.searchsorted(cuts, values))
        return found

    def shares(self, points: np.ndarray) -> np.ndarray:
        """The mean class-1 share over the trees for each row of `points`; rows that no split tells apart are walked once."""
        if not len(self.used):
            return np.full(len(points), self.share[self.first].mean() if len(self.first) else 0.0)
        places, back = np.unique(self.places(points), axis=0, return_inverse=True)
        every, total = np.arange(len(places)), np.zeros(len(places))
        for root in self.first:
            node = np.full(len(places), root)
            while True:
                column = self.column[node]
                inner = column >= 0
                if not inner.any():
                    break
                right = places[every, np.maximum(column, 0)] > self.cut[node]
                node = np.where(inner, np.where(right, self.right[node], self.left[node]), node)
            total += self.share[node]
        return (total / max(len(self.first), 1))[back.reshape(-1)]


def forest_column(forest: FlatForest):
    """A column function from feature vectors (as arrays) to probabilities."""
    sent = SparkSession.active().sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def probability(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype=float)
        return pd.Series(sent.value.shares(np.stack(vectors.to_numpy())))

    return probability


@dataclass
class ReoffenseModel:
    pipeline: PipelineModel
    top_countries: list[str]
    scorer: object = field(default=None, repr=False)

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.pipeline.transform(features(rows, self.top_countries))

    def score(self, events: DataFrame) -> DataFrame:
        """Add reoffense_probability; the other columns stay as they were."""
        return score_rows(events, self.top_countries, self._probability, "reoffense_probability")

    def _probability(self, prepared: DataFrame) -> DataFrame:
        """A forest is evaluated from arrays that travel to the rows, any other model by its own transform."""
        *stages, last = self.pipeline.stages
        if not isinstance(last, RandomForestClassificationModel):
            found = vector_to_array(F.col("probability"))[1]
            return self.pipeline.transform(prepared).withColumn("reoffense_probability", F.round(found, 4))
        if self.scorer is None:
            self.scorer = forest_column(FlatForest.of(last, shared_folder(prepared.sparkSession, "flat-forest")))
        encoded = PipelineModel(stages).transform(prepared)
        return encoded.withColumn("reoffense_probability", F.round(self.scorer(vector_to_array("features")), 4))

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.active()
        settings = spark.createDataFrame([(json.dumps({"top_countries": self.top_countries}),)], "value string")
        settings.write.mode("overwrite").text(f"{path}/settings")

    @staticmethod
    def load(path: str) -> "ReoffenseModel":
        spark = SparkSession.active()
        settings = json.loads(spark.read.text(f"{path}/settings").first().value)
        return ReoffenseModel(PipelineModel.load(f"{path}/pipeline"), settings["top_countries"])


@dataclass
class Training:
    """Outcome of a training run; the frames stay lazy."""

    models: dict[str, ReoffenseModel]
    test: DataFrame
    sizes: DataFrame


#: Bucket widths for the percentiles of numeric features, and the end of the names of their places.
FEATURE_WIDTHS, PLACE = (1.0, 1e-3), "_place"


def cuts_of(rows: DataFrame, column: str, most: int = FOREST_BINS) -> list[float]:
    """At most `most` - 1 bounds that part the rows into groups of about equal size by a column, found from all rows.

    A bound lies midway between the two values it parts. Up to `most` values are all told apart.
    """
    few = [r[0] for r in rows.select(column).distinct().limit(most + 1).collect()]
    if len(few) > most:
        found = exact_percentiles(rows, column, [i / most for i in range(1, most)], FEATURE_WIDTHS)
        few = {r.value for r in found.collect() if math.isfinite(r.value)}
    wanted = sorted(few)
    value = F.col(column)
    sides = [F.struct(F.max(F.when(value <= w, value)).alias("low"), F.min(F.when(value > w, value)).alias("high")) for w in wanted]
    pairs = rows.agg(F.array(*sides).alias("sides")).first().sides if wanted else []
    parted = {(s.low, s.high) for s in pairs if s.low is not None and s.high is not None}
    middles = ((low, (low + high) / 2, high) for low, high in parted)
    return sorted(middle if low <= middle < high else low for low, middle, high in middles)


def placed_encoder(cuts: dict[str, list[float]]) -> list:
    """The stages of `encoder`, but a numeric feature enters as its place: the number of its cuts that it exceeds."""
    *stages, assembler = encoder().getStages()
    above = {c: [f"CAST({c} > double('{cut!r}') AS INT)" for cut in found] or ["0"] for c, found in cuts.items()}
    places = ", ".join(f"CAST({' + '.join(terms)} AS DOUBLE) AS {c}{PLACE}" for c, terms in above.items())
    inputs = [c + PLACE if c in cuts else c for c in assembler.getInputCols()]
    return [*stages, SQLTransformer(statement=f"SELECT *, {places} FROM __THIS__"), VectorAssembler(inputCols=inputs, outputCol="features")]


def fit(prepared: DataFrame, classifier, top_countries: list[str], cuts: dict[str, list[float]] | None = None) -> ReoffenseModel:
    """Fit on rows that have their features and weights; see `placed_encoder` for `cuts`."""
    stages = [*(placed_encoder(cuts) if cuts else encoder().getStages()), classifier]
    return ReoffenseModel(Pipeline(stages=stages).fit(prepared), top_countries)


CLASSIFIERS = ("logistic_regression", "random_forest")
#: Rows in a partition that a model is fitted on, the partitions up to which this holds, and the most rows in one.
PART_ROWS, PARTS, MOST_ROWS = 1 << 14, 64, 1 << 18


def spread(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """`n` rows dealt by key, in order, so that small rows with much work each occupy all cores, alike on every run.

    Every partition of a forest's rows sends figures of all nodes, so there are few; none grows with the table.
    """
    parts = max(min(PARTS, 1 + n // PART_ROWS), 1 + n // MOST_ROWS)
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys)


@dataclass
class Prepared:
    """What both classifiers are fitted on: the split lies in the shared folder, `fitting` is lazy."""

    split: DataFrame
    fitting: DataFrame
    count: int
    top_countries: list[str]

    def training(self, models: dict[str, ReoffenseModel]) -> Training:
        sizes = self.split.groupBy("is_test", "reoffended").agg(F.count("*").alias("n"))
        return Training(models, self.split.filter("is_test"), sizes)


def prepare(events: DataFrame) -> Prepared:
    """80 % of the addresses for fitting, the rest for evaluation."""
    rows = train_set(events)
    top = top_country_codes(rows)
    split = cut_lineage(stratified_split(rows), "split")
    fitting = class_weights(features(split.filter(~F.col("is_test")), top)).select("ip", *MODEL_COLUMNS, "reoffended", "weight")
    return Prepared(split, fitting, fitting.count(), top)


def all_rows_bins(n: int) -> int:
    """The `maxBins` with which Spark looks for splits in all of n rows.

    It looks at maxBins^2 rows, 10,000 at least, drawn at random where there are more; the square is a 32-bit integer.
    """
    return min(max(FOREST_BINS, math.isqrt(max(n, 1) - 1) + 1), 46_340)


def fit_one(given: Prepared, name: str, trees: int = FOREST_TREES, depth: int = FOREST_DEPTH) -> ReoffenseModel:
    """Fit one of CLASSIFIERS on all training rows, whatever their number; the linear model reads them combined.

    The forest splits numeric features at bounds found from all rows, too. They enter as places among at most
    FOREST_BINS, so a large `maxBins` makes no histogram wider. Rows are kept only while they are used.
    """
    forest = name == "random_forest"
    if forest:
        rows, classifier = spread(given.fitting, given.count, "ip").drop("ip"), random_forest(trees, depth)
        classifier = classifier.setMaxBins(all_rows_bins(given.count))
    else:
        rows, classifier = spread(combine(given.fitting), given.count, *MODEL_COLUMNS, "reoffended"), logistic_regression(given.count)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return fit(rows, classifier, given.top_countries, {c: cuts_of(rows, c) for c in NUMERIC_FEATURES} if forest else None)
    finally:
        rows.unpersist()


def train(events: DataFrame, trees: int = FOREST_TREES, depth: int = FOREST_DEPTH) -> Training:
    """Fit both classifiers; see `prepare` and `fit_one`."""
    given = prepare(events)
    return given.training({name: fit_one(given, name, trees, depth) for name in CLASSIFIERS})


def confusion(predicted: DataFrame, label: str = "reoffended", prediction: str = "prediction") -> DataFrame:
    """One row tn, fp, fn, tp."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return predicted.agg(
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(y & p).alias("tp"),
    )


def confusion_pct(matrix: DataFrame) -> DataFrame:
    cells = ["tn", "fp", "fn", "tp"]
    whole = sum((F.col(c) for c in cells), F.lit(0))
    return matrix.select(*cells, *[safe_pct(c, whole).alias(f"{c}_pct") for c in cells])


def evaluate(model: ReoffenseModel, test: DataFrame) -> DataFrame:
    """One row of quality figures on held-out addresses."""
    predicted = model.predict(test)
    auc = BinaryClassificationEvaluator(labelCol="reoffended", numBins=0).evaluate(predicted)
    c = F.col
    whole = c("tn") + c("fp") + c("fn") + c("tp")
    return confusion(predicted).select(
        F.try_divide((c("tn") + c("tp")).cast("double"), whole.cast("double")).alias("accuracy"),
        F.coalesce(F.try_divide(c("tp").cast("double"), (c("tp") + c("fp")).cast("double")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(c("tp").cast("double"), (c("tp") + c("fn")).cast("double")), F.lit(0.0)).alias("recall"),
        F.coalesce(
            F.try_divide((c("tp") * 2).cast("double"), (c("tp") * 2 + c("fp") + c("fn")).cast("double")), F.lit(0.0)
        ).alias("f1"),
        F.lit(auc).alias("roc_auc"),
        "tn",
        "fp",
        "fn",
        "tp",
    )


def importance(model: ReoffenseModel, sample: DataFrame, n: int = 15) -> DataFrame:
    """The n features that matter most to a tree model, by the names of their one-hot columns."""
    spark = sample.sparkSession
    metadata = model.predict(sample).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"].removesuffix(PLACE) for group in metadata.values() for a in group}
    weights = model.pipeline.stages[-1].featureImportances.toArray()
    rows = [(names[i], round(float(w), 4)) for i, w in enumerate(weights)]
    frame = spark.createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.col("importance").desc(), "feature").limit(n)
