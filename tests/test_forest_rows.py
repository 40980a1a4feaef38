"""The forest counts every training row and finds its bounds from all of them."""

import dataclasses

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from ipvigil.catalog import models
from ipvigil.catalog.all import QUERIES
from ipvigil.ml import features as feat
from ipvigil.ml import reoffense
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def many(spark):
    """The training rows of the small table, said to be 5,000,000: more than a forest once grew on."""
    given = reoffense.prepare(models.unscored(spark, SMALL))
    return dataclasses.replace(given, count=5_000_000)


@pytest.mark.parametrize("name", ["evaluate", "fit_rf", "importance", "model_registry", "model_report", "score_reoffense"])
def test_a_forest_grows_on_all_rows_of_any_number(spark, monkeypatch, many, name):
    fitted, forest, fit = [], reoffense.random_forest, reoffense.fit

    def watched(rows, classifier, *more):
        fitted.append((rows.count(), isinstance(classifier, RandomForestClassifier)))
        return fit(rows, classifier, *more)

    monkeypatch.setattr(reoffense, "random_forest", lambda *given: forest(3, 2))
    monkeypatch.setattr(reoffense, "fit", watched)
    monkeypatch.setattr(models, "_prepared", lambda *key: many)
    models._fitted.cache_clear()
    assert QUERIES[name](spark, SMALL).first() is not None
    models._fitted.cache_clear()
    assert [n for n, grown in fitted if grown] == [many.fitting.count()]


def test_bounds_come_from_all_rows(spark):
    rows = spark.range(40_000, numPartitions=4).select(F.when(F.col("id") == 7, 900.0).otherwise((F.col("id") % 4).cast("double")).alias("v"))
    assert reoffense.cuts_of(rows, "v") == [0.5, 1.5, 2.5, 451.5]
    steps = spark.range(64_000, numPartitions=4).select((F.col("id") * 0.25).alias("v"))
    assert reoffense.cuts_of(steps, "v") == pytest.approx([i * 500 - 0.125 for i in range(1, 32)], abs=0.26)
    heavy = spark.range(6_400, numPartitions=4).select(F.greatest(F.col("id") - 3200, F.lit(0)).cast("double").alias("v"))
    assert len(reoffense.cuts_of(heavy, "v")) == 16 and reoffense.cuts_of(heavy, "v")[0] == 0.5
    odd = spark.createDataFrame([(float("-inf"),), (0.0,), (-0.0,), (5e-324,), (float("inf"),)], "v double")
    assert reoffense.cuts_of(odd, "v") == [float("-inf"), 0.0, 5e-324]
    assert reoffense.cuts_of(steps.limit(1), "v") == [] and reoffense.cuts_of(steps.filter("false"), "v") == []


def test_a_bound_that_parts_one_row_is_found(spark):
    """The only row of its class has a score of its own, which 10,000 rows drawn of 40,000 mostly lack; the next one has 3 like others."""
    alone = F.col("id") == 7
    rows = spark.range(40_000, numPartitions=4).select(
        F.col("id").cast("string").alias("ip"), F.lit("a").alias("source"), F.lit("US").alias("country_code"), F.lit("low").alias("risk_level"),
        F.lit("SSH").alias("category"), F.when(alone, 90.0).otherwise((F.col("id") % 4).cast("double")).alias("abuse_confidence_score"),
        alone.cast("int").alias("reoffended"),
    )
    fitting = feat.class_weights(feat.features(rows, ["US"])).select("ip", *feat.MODEL_COLUMNS, "reoffended", "weight")
    model = reoffense.fit_one(reoffense.Prepared(rows, fitting, 40_000, ["US"]), "random_forest", 12, 2)
    found = {r.ip: r.reoffense_probability for r in model.score(rows.filter("ip IN ('7', '11')")).collect()}
    assert found["7"] > found["11"] + 0.2
    slow = model.predict(rows.filter("ip = '7'")).first()
    assert slow.abuse_confidence_score == 90.0 and slow.probability[1] == pytest.approx(found["7"], abs=1e-4)
    assert reoffense.importance(model, rows, 1).first().feature == "abuse_confidence_score"


def test_all_rows_are_looked_at_for_splits():
    for n in (0, 1, 1024, 10_001, 3_504_192, 2**31 - 100_000):
        assert reoffense.all_rows_bins(n) ** 2 >= n and reoffense.all_rows_bins(n) ** 2 < 2**31
    assert reoffense.all_rows_bins(5) == 32 and reoffense.all_rows_bins(10**12) ** 2 < 2**31


def test_partitions_of_a_forest_are_bounded_in_rows(spark):
    rows = spark.range(1000).selectExpr("CAST(id AS string) AS ip")
    assert reoffense.spread(rows, 10**6, "ip").rdd.getNumPartitions() == 62
    assert reoffense.spread(rows, 4 * 10**6, "ip").rdd.getNumPartitions() == 64
    assert reoffense.spread(rows, 64 * 10**6, "ip").rdd.getNumPartitions() == 245
