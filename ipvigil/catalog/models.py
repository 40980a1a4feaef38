"""Training, scoring and model reports."""

from functools import lru_cache, reduce
from operator import and_

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ipvigil.catalog import fixtures as X
from ipvigil.catalog.joins import FIRST
from ipvigil.catalog.registry import query
from ipvigil.catalog.scalars import TOP_15
from ipvigil.catalog.sql import DIM_COUNTRY, MESSAGES, over_events
from ipvigil.catalog.streams import ENRICHED, _loaded
from ipvigil.constants import CATEGORICAL_FEATURES, CONTAMINATION, ISOLATION_TREES
from ipvigil.ml import features as feat
from ipvigil.ml import isolation, jobs, reoffense
from ipvigil.operators import addresses as A
from ipvigil.operators import counts
from ipvigil.session import cut_lineage, shared_folder
from ipvigil.sources import tables


def unscored(spark, sf):
    return X.threat_events(spark, sf).drop("reoffense_probability", "anomaly_score")


@lru_cache(maxsize=8)
def _prepared(app: str, sf: str, version) -> reoffense.Prepared:
    return reoffense.prepare(unscored(SparkSession.active(), sf))


@lru_cache(maxsize=16)
def _fitted(app: str, sf: str, version, name: str) -> reoffense.ReoffenseModel:
    return reoffense.fit_one(_prepared(app, sf, version), name)


@lru_cache(maxsize=8)
def _forest(app: str, sf: str, version) -> isolation.IsolationModel:
    return isolation.fit(unscored(SparkSession.active(), sf))


def _version(spark, sf):
    """When the events' files were last changed: a changed table is not answered from an older model."""
    files = X.table(spark, sf, "events").select("_metadata.file_modification_time", "_metadata.file_size")
    return tuple(files.distinct().agg(F.max("file_modification_time"), F.sum("file_size")).first())


def trained(spark, sf, *names: str) -> reoffense.Training:
    """Each model is fitted once per session and folder, for the first query that needs it."""
    key = spark.sparkContext.applicationId, sf, _version(spark, sf)
    return _prepared(*key).training({name: _fitted(*key, name) for name in names})


def forest(spark, sf) -> isolation.IsolationModel:
    return _forest(spark.sparkContext.applicationId, sf, _version(spark, sf))


@query(
    "train_set",
    over_events(
        "SELECT ip, source, country_code, abuse_confidence_score, risk_level, category, CAST(report_count > 1 AS INT) AS reoffended FROM firsts",
        FIRST,
    ),
)
def _(spark, sf):
    return feat.train_set(X.threat_events(spark, sf))


@query(
    "ml_features",
    over_events(
        """SELECT event_id, source, CASE WHEN country_code IN (SELECT country_code FROM top) THEN country_code ELSE 'OTHER' END AS country_bucket,
          coalesce(category, 'UNKNOWN') AS category, risk_level, coalesce(abuse_confidence_score, 0) AS abuse_confidence_score FROM te""",
        TOP_15,
    ),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    rows = feat.features(events, counts.top_country_codes(events))
    return rows.select("event_id", *CATEGORICAL_FEATURES, "abuse_confidence_score")


SPLIT = """,
classes AS (SELECT CAST(report_count > 1 AS INT) AS reoffended, count(*) AS n FROM firsts GROUP BY 1),
quota AS (
  SELECT reoffended, n, (SELECT sum(n) FROM classes) AS whole, CAST(ceil(round((SELECT sum(n) FROM classes) * CAST(0.2 AS DOUBLE), 9)) AS BIGINT) AS wanted
  FROM classes
),
shares AS (
  SELECT reoffended, n, wanted, wanted * n // whole AS base,
    row_number() OVER (ORDER BY wanted * n - (wanted * n // whole) * whole DESC, reoffended) AS place FROM quota
),
test_sizes AS (
  SELECT reoffended, n, CAST(base + CASE WHEN place <= wanted - (SELECT sum(base) FROM shares) THEN 1 ELSE 0 END AS BIGINT) AS test_n FROM shares
)"""


@query(
    "split",
    over_events(
        """SELECT reoffended, false AS is_test, n - test_n AS n FROM test_sizes
        UNION ALL SELECT reoffended, true, test_n FROM test_sizes""",
        FIRST,
        SPLIT,
    ),
)
def _(spark, sf):
    split = feat.stratified_split(feat.train_set(X.threat_events(spark, sf)))
    return split.groupBy("reoffended", "is_test").agg(F.count("*").alias("n"))


FEATURES = """,
prepared AS (
  SELECT event_id, source, CASE WHEN country_code IN (SELECT country_code FROM top) THEN country_code ELSE 'OTHER' END AS country_bucket,
    coalesce(category, 'UNKNOWN') AS category, risk_level, coalesce(abuse_confidence_score, 0) AS score FROM te)"""


def _places(feature: str) -> str:
    return f"(SELECT {feature}, row_number() OVER (ORDER BY count(*) DESC, {feature}) - 1 AS at FROM prepared GROUP BY {feature})"


ENCODED = f"""
SELECT event_id, s.at AS source, c.at AS country_bucket, k.at AS category, r.at AS risk_level, score AS abuse_confidence_score,
  (SELECT count(DISTINCT source) + count(DISTINCT country_bucket) + count(DISTINCT category) + count(DISTINCT risk_level) + 1 FROM prepared) AS width
FROM prepared JOIN {_places("source")} s USING (source) JOIN {_places("country_bucket")} c USING (country_bucket)
  JOIN {_places("category")} k USING (category) JOIN {_places("risk_level")} r USING (risk_level)"""


@query("encode", over_events(ENCODED, TOP_15, FEATURES))
def _(spark, sf):
    """The place of the one in each one-hot block, read from the encoded vector."""
    events = X.threat_events(spark, sf)
    rows = feat.features(events, counts.top_country_codes(events))
    model = feat.encoder().fit(rows)
    sizes = [len(labels) for labels in model.stages[0].labelsArray]
    encoded = model.transform(rows).withColumn("x", vector_to_array("features"))
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    ones = [
        (F.array_position(F.slice("x", start + 1, size), F.lit(1.0)) - 1).alias(name)
        for name, start, size in zip(CATEGORICAL_FEATURES, starts, sizes)
    ]
    return encoded.select("event_id", *ones, F.element_at("x", -1).alias("abuse_confidence_score"), F.size("x").cast("bigint").alias("width"))


def _figures(run, name: str):
    """Rows of the test set, and whether all figures of a model are shares and fit together."""
    found = reoffense.evaluate(run.models[name], run.test)
    shares = [F.col(c).between(0, 1) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")]
    tested = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    fits = F.abs(F.col("accuracy") * tested - F.col("tn") - F.col("tp")) < 1e-6
    return found.select(
        F.lit(name).alias("model"), tested.alias("tested"), (F.col("fn") + F.col("tp")).alias("positive"), reduce(and_, shares, fits).alias("sound")
    )


TESTED = "SELECT '{}' AS model, CAST(sum(test_n) AS BIGINT) AS tested, CAST(sum(CASE WHEN reoffended = 1 THEN test_n END) AS BIGINT) AS positive, true AS sound FROM test_sizes"


@query("fit_lr", over_events(TESTED.format("logistic_regression"), FIRST, SPLIT))
def _(spark, sf):
    return _figures(trained(spark, sf, "logistic_regression"), "logistic_regression")


@query("fit_rf", over_events(TESTED.format("random_forest"), FIRST, SPLIT))
def _(spark, sf):
    return _figures(trained(spark, sf, "random_forest"), "random_forest")


@query(
    "evaluate",
    over_events(f"{TESTED.format('logistic_regression')} UNION ALL {TESTED.format('random_forest')}", FIRST, SPLIT),
)
def _(spark, sf):
    run = trained(spark, sf, *reoffense.CLASSIFIERS)
    return _figures(run, "logistic_regression").unionByName(_figures(run, "random_forest"))


@query(
    "confusion_pct",
    over_events(
        """,
    predicted AS (
      SELECT f.report_count > 1 AS y, te.reoffense_probability >= 0.5 AS p FROM firsts f JOIN te ON f.event_id = te.event_id
    ),
    cells AS (
      SELECT count(*) FILTER (WHERE NOT y AND NOT p) AS tn, count(*) FILTER (WHERE NOT y AND p) AS fp,
        count(*) FILTER (WHERE y AND NOT p) AS fn, count(*) FILTER (WHERE y AND p) AS tp, CAST(count(*) AS DOUBLE) AS whole FROM predicted
    )
    SELECT tn, fp, fn, tp, CAST(tn AS DOUBLE) * 100 / whole AS tn_pct, CAST(fp AS DOUBLE) * 100 / whole AS fp_pct,
      CAST(fn AS DOUBLE) * 100 / whole AS fn_pct, CAST(tp AS DOUBLE) * 100 / whole AS tp_pct FROM cells""",
        FIRST,
    ),
)
def _(spark, sf):
    first = A.first_sighting(X.threat_events(spark, sf).select("ip", "loaded_at", "event_id", "reoffense_probability"))
    rows = first.select(
        (F.col("report_count") > 1).cast("int").alias("reoffended"),
        (F.col("reoffense_probability") >= 0.5).cast("double").alias("prediction"),
    )
    return reoffense.confusion_pct(reoffense.confusion(rows))


@query(
    "importance",
    over_events(
        """SELECT count(DISTINCT source) + count(DISTINCT b) + count(DISTINCT c) + count(DISTINCT risk_level) + 1 >= 15 AS enough, 15 AS named,
          true AS shares, true AS ordered
        FROM (SELECT source, risk_level, coalesce(category, 'UNKNOWN') AS c, country_code AS b FROM firsts) f""",
        FIRST,
    ),
)
def _(spark, sf):
    run = trained(spark, sf, "random_forest")
    top = reoffense.importance(run.models["random_forest"], run.test)
    listed_ = top.agg(F.collect_list("importance").alias("v"), F.count("*").alias("named"))
    return listed_.select(
        (F.col("named") >= 15).alias("enough"),
        F.col("named").cast("int").alias("named"),
        (F.aggregate("v", F.lit(0.0), lambda a, x: a + x).between(0.3, 1.001) & F.forall("v", lambda x: x.between(0, 1))).alias("shares"),
        (F.col("v") == F.reverse(F.array_sort("v"))).alias("ordered"),
    )


SCORED = "SELECT count(*) AS n, count(*) AS scored, true AS in_range FROM te"


def _scored(rows, column: str, low: float, high: float):
    return rows.agg(
        F.count("*").alias("n"), F.count(column).alias("scored"), F.bool_and(F.col(column).between(low, high)).alias("in_range")
    )


@query("score_reoffense", over_events(SCORED))
def _(spark, sf):
    return _scored(trained(spark, sf, "random_forest").models["random_forest"].score(unscored(spark, sf)), "reoffense_probability", 0, 1)


FIXED_FOREST = [(0, 50.0, 0.25, 0.75), (1, 80.0, 0.1, 0.9)]


@query(
    "score_reoffense_fixed",
    over_events(
        "SELECT event_id, round(("
        + " + ".join(f"CASE WHEN score > {t} THEN CAST({b} AS DOUBLE) ELSE CAST({a} AS DOUBLE) END" for _, t, a, b in FIXED_FOREST)
        + ") / 2, 4) AS reoffense_probability FROM prepared",
        TOP_15,
        FEATURES,
    ),
)
def _(spark, sf):
    """A forest of two fixed trees that ask for the abuse score, evaluated from its arrays."""
    rows = [n for t, cut, a, b in FIXED_FOREST for n in ((t, 0, 0, cut, 1, 2, 0.5), (t, 1, -1, 0.5, -1, -1, a), (t, 2, -1, 0.5, -1, -1, b))]
    fixed = reoffense.FlatForest(pd.DataFrame(rows, columns=["tree", "id", "feature", "threshold", "left", "right", "share"]))
    events = X.threat_events(spark, sf).select("event_id", F.array(F.coalesce("abuse_confidence_score", F.lit(0.0))).alias("x"))
    return events.select("event_id", F.round(reoffense.forest_column(fixed)("x"), 4).alias("reoffense_probability"))


@query(
    "models_on_signal",
    over_events(
        """SELECT model, true AS area, true AS beats_chance, true AS names_the_cause FROM
        (SELECT 'logistic_regression' AS model UNION ALL SELECT 'random_forest') m WHERE (SELECT count(*) FROM te) > 0"""
    ),
)
def _(spark, sf):
    """Addresses first seen in two of the feeds come back, but for one in ten: both models must find that out.

    The area under the curve is 0.9 at best; a model that answers a constant has 0.5.
    """
    rows = feat.train_set(unscored(spark, sf))
    cause = F.col("source").isin("click", "error")
    label = F.when(F.pmod(F.xxhash64("ip"), F.lit(10)) == 0, ~cause).otherwise(cause).cast("int")
    split = cut_lineage(feat.stratified_split(rows.withColumn("reoffended", label)), "signal")
    top = counts.top_country_codes(rows)
    fitting, test = split.filter(~F.col("is_test")), split.filter("is_test")
    prepared = feat.class_weights(feat.features(fitting, top)).persist()
    classifiers = {"logistic_regression": reoffense.logistic_regression(prepared.count()), "random_forest": reoffense.random_forest(20, 5)}
    out = []
    for name, classifier in classifiers.items():
        model = reoffense.fit(prepared, classifier, top)
        found = reoffense.evaluate(model, test)
        named = F.lit(name != "random_forest" or reoffense.importance(model, test, 1).first().feature.startswith("source"))
        out.append(found.select(
            F.lit(name).alias("model"), (F.col("roc_auc") > 0.8).alias("area"), (F.col("accuracy") > 0.8).alias("beats_chance"),
            named.alias("names_the_cause"),
        ))
    prepared.unpersist()
    return out[0].unionByName(out[1])


@query("iforest_on_signal", over_events("SELECT count(*) AS planted, true AS found FROM te WHERE event_id % 200 = 17"))
def _(spark, sf):
    """One event in 200 gets a feed, country and category of its own: nine in ten of them score below half of all events.

    A model that answers a constant puts none of them there, one that guesses half of them.
    """
    odd = F.col("event_id") % 200 == 17
    strange = {c: F.when(odd, F.lit("ODD")).otherwise(F.col(c)) for c in ("source", "country_code", "category")}
    events = unscored(spark, sf).withColumns(strange)
    scored = cut_lineage(isolation.fit(events).score(events).select("event_id", "anomaly_score"), "signal-scores")
    middle = scored.agg(F.percentile_approx("anomaly_score", 0.5, 10_000)).scalar()
    low = F.count_if(odd & (F.col("anomaly_score") < middle))
    return scored.agg(F.count_if(odd).alias("planted"), low.alias("low")).select("planted", (F.col("low") >= 0.9 * F.col("planted")).alias("found"))


@query("fit_iforest", over_events(f"SELECT CAST({ISOLATION_TREES} AS BIGINT) AS trees, true AS binary FROM (SELECT count(*) FROM te) t"))
def _(spark, sf):
    """A tree is complete if it has one leaf more than inner nodes, and every node but the root has its parent."""
    nodes = forest(spark, sf).nodes
    parent = F.floor((F.col("node") - 1) / 2)
    inner = nodes.filter("feature >= 0").select("tree_id", F.col("node").alias("parent"))
    rooted = nodes.withColumn("parent", parent).join(inner, ["tree_id", "parent"], "left_semi")
    lost = nodes.filter("node > 0").count() - rooted.count()
    shape = nodes.groupBy("tree_id").agg((F.count_if(F.col("feature") < 0) - F.count_if(F.col("feature") >= 0)).alias("more"))
    return shape.agg(F.count("*").alias("trees"), (F.bool_and(F.col("more") == 1) & F.lit(lost == 0)).alias("binary"))


FIXED_TREES = [(0, 50.0, 1.0, 3.0), (1, 80.0, 2.0, 1.5)]


@query(
    "score_anomaly",
    over_events(
        "SELECT event_id, round(-pow(2, -(("
        + " + ".join(f"CASE WHEN score <= {t} THEN {a} ELSE {b} END" for _, t, a, b in FIXED_TREES)
        + f") / 2) / CAST({feat.path_normaliser(256)!r} AS DOUBLE)), 4) AS anomaly_score FROM prepared",
        TOP_15,
        FEATURES,
    ),
)
def _(spark, sf):
    """Two fixed trees that each ask for the abuse score."""
    events = unscored(spark, sf)
    top = counts.top_country_codes(events)
    rows = feat.features(events, top)
    encoder = feat.encoder().fit(rows)
    last = sum(len(labels) for labels in encoder.stages[0].labelsArray)
    nodes = [n for t, cut, a, b in FIXED_TREES for n in ((t, 0, last, cut, 0.0), (t, 1, -1, 0.0, a), (t, 2, -1, 0.0, b))]
    model = isolation.IsolationModel(encoder, spark.createDataFrame(nodes, isolation.NODE), 256, len(FIXED_TREES), top)
    return model.score(events).select("event_id", "anomaly_score")


@query("score_anomaly_fitted", over_events(SCORED))
def _(spark, sf):
    return _scored(forest(spark, sf).score(unscored(spark, sf)), "anomaly_score", -1, 0)


@query(
    "anomaly_rate",
    over_events(
        """SELECT scored, below, round(CAST(below AS DOUBLE) / scored, 4) AS observed_rate,
          abs(0.02 - round(CAST(below AS DOUBLE) / scored, 4)) < 0.01 AS calibrated
        FROM (SELECT count(anomaly_score) AS scored,
          count(*) FILTER (WHERE anomaly_score < (SELECT quantile_cont(anomaly_score, 0.02) FROM te)) AS below FROM te) t"""
    ),
)
def _(spark, sf):
    return isolation.anomaly_rate(X.threat_events(spark, sf))


@query(
    "backfill",
    over_events("SELECT event_id, coalesce(anomaly_score, CAST(-0.25 AS DOUBLE)) AS anomaly_score FROM te"),
)
def _(spark, sf):
    def constant(rows):
        return rows.withColumn("anomaly_score", F.lit(-0.25))

    return jobs.backfill(X.threat_events(spark, sf), "anomaly_score", constant).select("event_id", "anomaly_score")


@query(
    "backfill_model",
    over_events("SELECT count(*) AS n, count(anomaly_score) AS kept, count(*) - count(anomaly_score) AS filled FROM te"),
)
def _(spark, sf):
    events = X.threat_events(spark, sf)
    after = jobs.backfill(events, "anomaly_score", forest(spark, sf).score).select("event_id", F.col("anomaly_score").alias("after"))
    both = events.select("event_id", "anomaly_score").join(after, "event_id")
    return both.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("anomaly_score") == F.col("after")).alias("kept"),
        F.count_if(F.col("anomaly_score").isNull() & F.col("after").between(-1, 0)).alias("filled"),
    )


@query(
    "stream_score",
    over_events("SELECT count(*) AS n, count(*) AS reoffense, count(*) AS anomaly FROM enriched", MESSAGES, DIM_COUNTRY, ENRICHED),
)
def _(spark, sf):
    """Rows of the table that a scoring stream has loaded, and how many carry a probability and a score."""
    score = jobs.stream_scorer(trained(spark, sf, "random_forest").models["random_forest"], forest(spark, sf))
    scored = tables.scan_events(spark, f"{_loaded(spark, sf, score)}/table")
    return scored.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("reoffense_probability").between(0, 1)).alias("reoffense"),
        F.count_if(F.col("anomaly_score").between(-1, 0)).alias("anomaly"),
    )


@query("model_registry", over_events("SELECT count(*) AS n, count(*) AS same FROM te"))
def _(spark, sf):
    """Models that were saved and loaded again score every event as before."""
    base = shared_folder(spark, "models")
    models = trained(spark, sf, "random_forest").models["random_forest"], forest(spark, sf)
    models[0].save(f"{base}/reoffense")
    models[1].save(f"{base}/anomaly")
    again = reoffense.ReoffenseModel.load(f"{base}/reoffense"), isolation.IsolationModel.load(f"{base}/anomaly")
    rows = unscored(spark, sf)
    first, second = (
        pair[1].score(pair[0].score(rows)).select("event_id", F.struct("reoffense_probability", "anomaly_score").alias(name))
        for pair, name in ((models, "a"), (again, "b"))
    )
    return first.join(second, "event_id").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))


@query(
    "model_report",
    over_events(
        """SELECT 'random_forest' AS model, s.*, c.*, true AS sound FROM
          (SELECT CAST(sum(n) AS BIGINT) AS trained_on_rows, CAST(sum(n - test_n) AS BIGINT) AS train_rows,
            CAST(sum(test_n) AS BIGINT) AS test_rows FROM test_sizes) s,
          (SELECT count(*) AS total, count(reoffense_probability) AS reoffense_scored, count(anomaly_score) AS anomaly_scored FROM te) c""",
        FIRST,
        SPLIT,
    ),
)
def _(spark, sf):
    """The report as it lies beside the saved model."""
    run = trained(spark, sf, "random_forest")
    figures = reoffense.evaluate(run.models["random_forest"], run.test).withColumn("model", F.lit("random_forest"))
    sizes = run.sizes.agg(
        F.sum("n").alias("trained_on_rows"),
        F.sum(F.when(~F.col("is_test"), F.col("n"))).alias("train_rows"),
        F.sum(F.when(F.col("is_test"), F.col("n"))).alias("test_rows"),
    )
    report = figures.withColumn("sizes", sizes.select(F.struct("*")).scalar()).withColumn("contamination", F.lit(CONTAMINATION))
    whole = jobs.model_report(report.select("*", "sizes.*").drop("sizes"), X.threat_events(spark, sf))
    path = shared_folder(spark, "report")
    jobs.save_report(whole, path)
    stored = spark.read.schema(whole.schema).json(path)
    sound = F.col("accuracy").between(0, 1) & F.col("roc_auc").between(0, 1) & (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp") == F.col("test_rows"))
    return stored.select(
        "model", "trained_on_rows", "train_rows", "test_rows", "total", "reoffense_scored", "anomaly_scored", sound.alias("sound")
    )
