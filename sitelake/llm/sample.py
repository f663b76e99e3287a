"""Bounded, repeatable samples of rows for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, id_column: str, rows: int) -> DataFrame:
    """About `rows` rows of `df`, those of least id hash; all of a smaller table.

    Only hashes are sorted and one number reaches the driver; the rows stay where they are.
    """
    key = F.xxhash64(id_column)
    last = df.select(key.alias("h")).orderBy("h").limit(rows).agg(F.max("h").alias("h")).first()["h"]
    return df.where(key <= F.lit(last)) if last is not None else df.limit(0)
