"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_hashes(rows: DataFrame, key: Column, hot_share: int = 200) -> DataFrame:
    """`h, is_hot`: hashes of the keys that hold more than one in hot_share of the rows.

    Fewer than hot_share keys can, so the result is small enough to broadcast whatever the input.
    """
    counts = rows.groupBy(F.xxhash64(key).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))  # one row
    return counts.join(F.broadcast(total)).filter(F.col("n") * hot_share > F.col("t")).select("h", F.lit(True).alias("is_hot"))


def salted_join(many: DataFrame, one: DataFrame, many_key: str, one_key: str, spread_by: str, how: str = "left", counted: DataFrame | None = None, hot_share: int = 200, salt: int = 16) -> DataFrame:
    """Joins `many` to `one` (a row per key) with the hot keys of `many` spread over `salt` parts.

    The few rows of `one` with a hot key are copied to each part; all other keys keep part 0. `counted`
    is where the keys are counted, if that is cheaper than on `many` itself.
    """
    source = many if counted is None else counted
    hot = F.broadcast(hot_hashes(source, F.col(many_key), hot_share))
    parts = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(salt - 1))).otherwise(F.array(F.lit(0)))
    right = one.withColumn("h", F.xxhash64(one_key)).join(hot, "h", "left").select(*one.columns, F.explode(parts).alias("_part_r"))
    part = F.when(F.col("is_hot"), F.pmod(F.xxhash64(spread_by), F.lit(salt)).cast("int")).otherwise(0)
    left = many.withColumn("h", F.xxhash64(many_key)).join(hot, "h", "left").select(*many.columns, part.alias("_part"))
    return left.join(right, (F.col(many_key) == F.col(one_key)) & (F.col("_part") == F.col("_part_r")), how).drop("_part", "_part_r")
