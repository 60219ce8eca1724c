"""Joins in which a few keys hold very many rows of one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoflow.session import durable

#: A key of more rows than this, and than a thousandth of all, is salted.
HOT_ROWS = 100_000
SALTS = 64


def hot_keys(groups: DataFrame, key: str) -> DataFrame | None:
    """(key) of the hot ones of ``groups(key, n)``, or None; at most a thousand, for each has over a thousandth of all rows."""
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = durable(groups.where(F.col("n") > max(HOT_ROWS, total // 1000)).select(key))
    return None if hot.isEmpty() else hot


def salted_join(many: DataFrame, few: DataFrame, key: str, hot: DataFrame | None, by: str) -> DataFrame:
    """Inner join on ``key``; rows of ``many`` with a hot key are spread over ``SALTS`` tasks by their column ``by``."""
    if hot is None:
        return many.join(few, key)
    marked = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    left = many.join(marked, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    right = few.join(marked, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [key, "_salt"]).drop("_salt")
