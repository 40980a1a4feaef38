import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ipvigil.catalog import fixtures as X
from ipvigil.catalog import models
from ipvigil.catalog.all import QUERIES
from ipvigil.ml import features as feat
from ipvigil.ml import isolation, jobs, reoffense
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def labelled(spark):
    """3,000 first sightings; addresses of source 'a' come back."""
    return spark.range(3000, numPartitions=3).select(
        F.concat(F.lit("ip"), F.col("id").cast("string")).alias("ip"),
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("source"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("K"), (F.col("id") % 20).cast("string"))).alias("country_code"),
        (F.col("id") % 100).cast("double").alias("abuse_confidence_score"),
        F.lit("low").alias("risk_level"),
        F.when(F.col("id") % 2 == 0, "SSH").alias("category"),
        (F.col("id") % 3 == 0).cast("int").alias("reoffended"),
    )


def test_split_sizes_round_up_and_keep_shares(spark):
    counted = spark.createDataFrame([(0, 15530), (1, 9036)], "y int, n bigint")
    assert {r.y: r.test_n for r in feat.split_sizes(counted, "y").collect()} == {0: 3107, 1: 1807}
    huge = spark.createDataFrame([(0, 7 * 10**11), (1, 3 * 10**11)], "y int, n bigint")
    assert {r.y: r.test_n for r in feat.split_sizes(huge, "y").collect()} == {0: 14 * 10**10, 1: 6 * 10**10}
    odd = spark.createDataFrame([(0, 333333333333), (1, 666666666667)], "y int, n bigint")
    assert {r.y: r.test_n for r in feat.split_sizes(odd, "y").collect()} == {0: 66666666667, 1: 133333333333}


@pytest.mark.parametrize("share", [0.2, 0.0003, 0.5])
def test_split_is_exact_and_repeatable(labelled, share):
    first = feat.stratified_split(labelled, share=share)
    sizes = {(r.reoffended, r.is_test): r["count"] for r in first.groupBy("reoffended", "is_test").count().collect()}
    assert sum(sizes.values()) == 3000
    assert sum(n for (_, t), n in sizes.items() if t) == int(np.ceil(round(3000 * share, 9)))
    if share >= 0.2:
        assert sizes[(1, True)] == round(1000 * share)
    again = feat.stratified_split(labelled.repartition(5), share=share)
    assert {r.ip for r in first.filter("is_test").collect()} == {r.ip for r in again.filter("is_test").collect()}


def test_weights_balance_the_classes(labelled):
    sums = {r.reoffended: r.w for r in feat.class_weights(labelled).groupBy("reoffended").agg(F.sum("weight").alias("w")).collect()}
    assert sums[0] == pytest.approx(1500) and sums[1] == pytest.approx(1500)


def test_unseen_values_encode_to_zero(labelled):
    rows = feat.features(labelled, ["K1", "K2"])
    model = feat.encoder().fit(rows)
    odd = rows.limit(1).withColumns({c: F.lit("never seen") for c in feat.CATEGORICAL_FEATURES}).withColumn("abuse_confidence_score", F.lit(7.0))
    vector = model.transform(odd).first().features.toArray()
    assert vector[-1] == 7.0 and not vector[:-1].any()


@pytest.mark.parametrize("classifier", ["lr", "rf"])
def test_classifiers_learn_and_persist(spark, labelled, classifier, tmp_path):
    top = [f"K{i}" for i in range(1, 16)]
    split = feat.stratified_split(labelled)
    prepared = feat.class_weights(feat.features(split.filter("NOT is_test"), top))
    estimator = reoffense.logistic_regression(2400) if classifier == "lr" else reoffense.random_forest(20, 5)
    model = reoffense.fit(prepared, estimator, top)
    row = reoffense.evaluate(model, split.filter("is_test")).first()
    assert row.accuracy > 0.99 and row.roc_auc > 0.99
    assert row.tn + row.fp + row.fn + row.tp == 600
    if classifier == "rf":
        top = reoffense.importance(model, labelled).collect()
        assert top[0].feature.startswith("source") and len(top) == 15
    model.save(str(tmp_path / "m"))
    again = reoffense.ReoffenseModel.load(str(tmp_path / "m"))
    a = {r.ip: r.reoffense_probability for r in model.score(labelled).collect()}
    scored = again.score(labelled)
    assert scored.columns == [*labelled.columns, "reoffense_probability"]
    assert {r.ip: r.reoffense_probability for r in scored.collect()} == a
    assert scored.filter("category IS NULL").count() == 1500


def test_combined_rows_train_the_same_linear_model(labelled):
    noisy = labelled.withColumn("reoffended", F.when(F.xxhash64("ip") % 4 == 0, 1 - F.col("reoffended")).otherwise(F.col("reoffended")))
    top = [f"K{i}" for i in range(1, 16)]
    prepared = feat.class_weights(feat.features(noisy, top))
    combined = feat.combine(prepared)
    assert combined.count() < 3000
    scores = []
    for rows in (prepared, combined):
        model = reoffense.fit(rows, reoffense.logistic_regression(3000), top)
        scores.append({r.ip: r.reoffense_probability for r in model.score(labelled).collect()})
    assert max(abs(scores[0][ip] - scores[1][ip]) for ip in scores[0]) < 1e-3


def test_scoring_keeps_rows_and_columns_and_shuffles_nothing(labelled):
    def score(rows):
        return rows.withColumn("s", F.length("country_bucket") + F.col("abuse_confidence_score") + F.length("category"))

    scored = feat.score_rows(labelled, ["K1", "K10"], score, "s")
    assert scored.count() == 3000 and scored.columns == [*labelled.columns, "s"]
    assert sorted(r.ip for r in scored.collect()) == sorted(r.ip for r in labelled.collect())


@pytest.fixture(scope="module")
def planted(spark):
    """2,000 ordinary events and ten strange ones."""
    strange = F.col("id") >= 2000
    return spark.range(2010, numPartitions=4).select(
        F.col("id").alias("event_id"),
        F.when(strange, F.concat(F.lit("odd"), (F.col("id") % 3).cast("string"))).otherwise("a").alias("source"),
        F.when(strange, "ZZ").otherwise("US").alias("country_code"),
        F.when(strange, "SSH").otherwise("Spam").alias("category"),
        F.when(strange, "critical").otherwise("low").alias("risk_level"),
        F.when(strange, F.lit(99.0)).otherwise((F.col("id") % 20).cast("double")).alias("abuse_confidence_score"),
    )


def test_strange_events_get_the_lowest_scores(spark, planted, tmp_path):
    model = isolation.fit(planted)
    assert model.sample == 256
    assert model.nodes.select("tree_id").distinct().count() == 100
    scored = model.score(planted)
    rows = sorted(scored.collect(), key=lambda r: r.anomaly_score)
    assert {r.event_id for r in rows[:10]} == set(range(2000, 2010))
    assert all(-1 < r.anomaly_score < 0 for r in rows)
    assert scored.columns == [*planted.columns, "anomaly_score"]
    model.save(str(tmp_path / "f"))
    again = {r.event_id: r.anomaly_score for r in isolation.IsolationModel.load(str(tmp_path / "f")).score(planted).collect()}
    assert again == {r.event_id: r.anomaly_score for r in rows}
    same = isolation.fit(planted.repartition(7))
    assert {r.event_id: r.anomaly_score for r in same.score(planted).collect()} == again


def test_forest_on_few_and_equal_rows(planted):
    few = isolation.fit(planted.limit(3), trees=5)
    assert few.sample == 3
    equal = planted.withColumns({c: F.lit("x") for c in ("source", "country_code", "category", "risk_level")}).withColumn(
        "abuse_confidence_score", F.lit(1.0)
    )
    flat = isolation.fit(equal, trees=5).score(equal)
    assert flat.select("anomaly_score").distinct().count() == 1


def test_anomaly_rate(spark):
    rows = spark.range(1000).select((-F.col("id") / 1000).alias("anomaly_score"))
    found = isolation.anomaly_rate(rows).first()
    assert (found.scored, found.below, found.calibrated) == (1000, 20, True)


def test_backfill_scores_missing_rows_only(spark, planted):
    model = isolation.fit(planted, trees=10)
    events = planted.withColumn("anomaly_score", F.when(F.col("event_id") % 2 == 0, F.lit(-0.1)))
    filled = jobs.backfill(events, "anomaly_score", model.score)
    assert filled.columns == events.columns
    assert filled.filter("anomaly_score IS NULL").count() == 0
    assert filled.filter("event_id % 2 = 0 AND anomaly_score <> -0.1").count() == 0


def test_missing_models_leave_scores_out(planted):
    assert jobs.stream_scorer(None, None)(planted).columns == planted.columns


def test_train_set_uses_the_first_sighting_only(spark):
    rows = spark.createDataFrame(
        [("a", "t1", 2, "s2", 90.0), ("a", "t1", 1, "s1", 10.0), ("b", "t0", 3, "s3", 50.0)],
        "ip string, loaded_at string, event_id bigint, source string, abuse_confidence_score double",
    ).withColumns({c: F.lit("x") for c in ("country_code", "risk_level", "category")})
    found = {r.ip: (r.source, r.abuse_confidence_score, r.reoffended) for r in feat.train_set(rows).collect()}
    assert found == {"a": ("s1", 10.0, 1), "b": ("s3", 50.0, 0)}


def test_path_normaliser():
    assert feat.path_normaliser(1) == 0 and feat.path_normaliser(2) == 1
    assert feat.path_normaliser(256) == pytest.approx(10.244, abs=1e-3)


def test_report_joins_quality_and_coverage(spark, events):
    metrics = spark.createDataFrame([("m", 0.5)], "model string, accuracy double")
    row = jobs.model_report(metrics, events).first()
    assert (row.model, row.total, row.reoffense_scored, row.anomaly_scored) == ("m", 1000, 1000, 950)
    assert X.CATEGORY_NAMES[1] == "C01"


def test_flat_forest_gives_what_the_transform_gives(spark, labelled, tmp_path):
    top = [f"K{i}" for i in range(1, 16)]
    noisy = labelled.withColumn("reoffended", F.when(F.xxhash64("ip") % 5 == 0, 1 - F.col("reoffended")).otherwise(F.col("reoffended")))
    prepared = feat.class_weights(feat.features(noisy, top))
    model = reoffense.fit(prepared, reoffense.random_forest(trees=15, depth=8), top)
    forest = reoffense.FlatForest.of(model.pipeline.stages[-1], str(tmp_path / "forest"))
    from pyspark.ml.functions import vector_to_array

    rows = model.predict(noisy).select(vector_to_array("features").alias("x"), vector_to_array("probability")[1].alias("p")).collect()
    points = np.array([r.x for r in rows])
    assert forest.shares(points) == pytest.approx([r.p for r in rows], abs=1e-9)
    assert forest.shares(points[:0]).shape == (0,)
    scored = model.score(noisy).orderBy("ip").collect()
    slow = model.predict(noisy).select("ip", F.round(vector_to_array("probability")[1], 4).alias("p")).orderBy("ip").collect()
    assert [r.reoffense_probability for r in scored] == pytest.approx([r.p for r in slow], abs=1.1e-4)


def test_a_constant_model_has_no_area_under_its_curve(spark, labelled):
    top = [f"K{i}" for i in range(1, 16)]
    blind = labelled.withColumns({c: F.lit("same") for c in ("source", "country_code", "risk_level", "category")}).withColumn("abuse_confidence_score", F.lit(1.0))
    model = reoffense.fit(feat.class_weights(feat.features(blind, top)), reoffense.random_forest(trees=3, depth=3), top)
    assert reoffense.evaluate(model, labelled).first().roc_auc == pytest.approx(0.5, abs=0.05)


def test_a_linear_model_is_fitted_without_growing_a_forest(spark, monkeypatch):
    grown = []
    forest = reoffense.random_forest
    monkeypatch.setattr(reoffense, "random_forest", lambda *given: grown.append(given) or forest(3, 2))
    models._fitted.cache_clear()
    assert QUERIES["fit_lr"](spark, SMALL).first().sound and not grown
    assert QUERIES["fit_rf"](spark, SMALL).first().sound and len(grown) == 1
    models._fitted.cache_clear()


def test_forest_rows_keep_their_nodes_and_are_spread(spark):
    assert reoffense.random_forest().getCacheNodeIds()
    rows = spark.range(100_000, numPartitions=1).selectExpr("CAST(id AS string) AS ip")
    dealt = [reoffense.spread(rows.repartition(n), 100_000, "ip") for n in (1, 5)]
    parts = [d.select(F.spark_partition_id().alias("p"), "ip").collect() for d in dealt]
    assert len({r.p for r in parts[0]}) == 7 and parts[0] == parts[1]


def test_shares_follow_every_split(rng=np.random.default_rng(5)):
    """Rows that lie between the same thresholds are walked once, with the result of a walk of their own."""
    nodes = [n for t in range(6) for n in (
        (t, 0, 0, 0.5, 1, 2, 0.0), (t, 1, 1, 10.0 * t, 3, 4, 0.0), (t, 2, -1, 0.5, -1, -1, 0.25 * t), (t, 3, -1, 0.5, -1, -1, 0.5), (t, 4, -1, 0.5, -1, -1, 0.75)
    )]
    forest = reoffense.FlatForest(pd.DataFrame(nodes, columns=["tree", "id", "feature", "threshold", "left", "right", "share"]))
    points = np.column_stack([rng.integers(0, 2, 500), rng.uniform(-5, 60, 500)]).astype(float)
    points[:4, 1] = [10.0, 50.0, np.nan, np.inf]
    walked = [np.mean([0.25 * t if x > 0.5 else (0.75 if y > 10.0 * t else 0.5) for t in range(6)]) for x, y in points]
    assert np.allclose(forest.shares(points), walked) and len(np.unique(forest.places(points), axis=0)) <= 14
