"""Helpers for whole rows: passing a table's columns through an Arrow task, and column names that cannot clash."""

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ipvigil.session import cut_lineage  # noqa: F401  general helper, used by the operators
from ipvigil.llm.spans import sliced


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores added until no column of `df` has that name (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def map_text(
    df: DataFrame, text: str, fields: list[T.StructField], compute: Callable[[pa.RecordBatch], list], keep: list[str]
) -> DataFrame:
    """One output row per input row: the columns in `keep`, then `fields` as computed from each part of a batch.

    `compute` sees record batches of bounded text size and returns one array per field.
    """
    kept = [f for f in df.schema.fields if f.name in keep]
    kept.sort(key=lambda f: keep.index(f.name))
    schema = T.StructType(kept + fields)
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, text):
                own = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, *compute(part)], names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
