"""Model reports and scoring of rows that have no score yet."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ipvigil.ml.isolation import IsolationModel
from ipvigil.ml.reoffense import ReoffenseModel
from ipvigil.operators.quality import score_coverage


def backfill(events: DataFrame, column: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score the rows where `column` is NULL; scored rows pass through untouched and nothing is shuffled."""
    missing = score(events.filter(F.col(column).isNull()))
    return events.filter(F.col(column).isNotNull()).unionByName(missing.select(*events.columns))


def stream_scorer(reoffense: ReoffenseModel | None, isolation: IsolationModel | None) -> Callable[[DataFrame], DataFrame]:
    """Scoring step of the table sink; a missing model leaves its column NULL."""

    def score(batch: DataFrame) -> DataFrame:
        if reoffense is not None:
            batch = reoffense.score(batch)
        if isolation is not None:
            batch = isolation.score(batch)
        return batch

    return score


def model_report(metrics: DataFrame, events: DataFrame) -> DataFrame:
    """A model's quality figures next to how much of the table it has scored."""
    coverage = score_coverage(events).select(F.struct("*")).scalar()
    return metrics.withColumn("coverage", coverage).select(*metrics.columns, "coverage.*")


def save_report(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)
