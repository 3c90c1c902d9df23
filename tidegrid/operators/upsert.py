"""Set operations and keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_last(*tables: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Union of tables; of equal keys the row of the later table (within one, the last by ``order``)."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn("_src", F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_src"), *[F.desc(c) for c in order or []])
    return out.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_src", "_rn")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
