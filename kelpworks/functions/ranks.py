"""Ranks within groups of any size, without collecting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from ..session import cut
from .skew import salted_join


def group_ranks(df: DataFrame, group: list[str], order: list[Column], ties: bool = False, rank: str = "rank", size: str = "group_size") -> DataFrame:
    """Adds `rank` (1 is first in `order`) and `size` of each group.

    Rows are range-partitioned by group and order, so a large group lies in several partitions; a rank is
    the row's place in its partition plus the group's rows in the partitions before. With ties, rows that
    are equal in `order` all get the last place among them (equal keys are in one partition).
    """
    ordered = cut(df.repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id()))
    per = ordered.groupBy("_p", *group).agg(F.count(F.lit(1)).alias("_n"))
    # One row per group and partition it touches.
    upto = per.withColumn("_before", F.sum("_n").over(Window.partitionBy(*group).orderBy("_p")) - F.col("_n")).withColumn(size, F.sum("_n").over(Window.partitionBy(*group)))
    here = Window.partitionBy("_p", *group).orderBy(*order)
    local = F.count(F.lit(1)).over(here) if ties else F.row_number().over(here)
    local_rank = ordered.withColumn("_local", local)
    join = [local_rank["_p"] == upto["_p"], *(local_rank[g].eqNullSafe(upto[g]) for g in group)]
    on = join[0]
    for c in join[1:]:
        on = on & c
    keep = [local_rank[c] for c in df.columns]
    return local_rank.join(upto, on, "inner").select(*keep, (F.col("_local") + F.col("_before")).alias(rank), upto[size])


def tied_ranks(df: DataFrame, group: list[str], value: str, rank: str = "rank", size: str = "group_size") -> DataFrame:
    """Adds the rank of each row by `value`, ascending with nulls first, where equal values all get the last place among them, and the group's `size`.

    Values are counted first, so one that a third of all rows hold is one row of the ordering; the rows get their ranks
    by a join that spreads such a value.
    """
    kind = df.schema[value].dataType
    plain = F.when(F.col(value) == 0, F.lit(0).cast(kind)).otherwise(F.col(value)) if isinstance(kind, FractionalType) else F.col(value)  # -0.0 equals 0.0
    counts = df.groupBy(*group, plain.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    order = F.col("_v").asc_nulls_first()
    ordered = cut(counts.repartitionByRange(*group, order).withColumn("_p", F.spark_partition_id()))
    per = ordered.groupBy("_p", *group).agg(F.sum("_n").alias("_in"))
    upto = per.withColumn("_before", F.sum("_in").over(Window.partitionBy(*group).orderBy("_p")) - F.col("_in")).withColumn(size, F.sum("_in").over(Window.partitionBy(*group)))
    here = Window.partitionBy("_p", *group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = ordered.withColumn("_local", F.sum("_n").over(here))
    on = local["_p"] == upto["_p"]
    for g in group:
        on = on & local[g].eqNullSafe(upto[g])
    # A null is told from every value by a flag, so keys compare by plain equality.
    key = lambda v: F.to_json(F.struct(*(x for i, c in enumerate([*map(F.col, group), v]) for x in (c.isNull().alias(f"null{i}"), c.alias(f"key{i}")))))
    ranked = local.join(upto, on, "inner").select(*(local[c] for c in (*group, "_v")), (F.col("_local") + F.col("_before")).alias(rank), upto[size])
    ranked = ranked.select(key(F.col("_v")).alias("_of"), rank, size)
    return salted_join(df.withColumn("_key", key(plain)).withColumn("_row", F.xxhash64(*df.columns)), ranked, "_key", "_of", spread_by="_row", how="inner").select(*df.columns, rank, size)


def running_max(df: DataFrame, group: list[str], order: list[Column], value: str, out: str = "running") -> DataFrame:
    """Adds the greatest `value` of the group's rows up to each row in `order`, itself included (equal rows may count or not).

    As in group_ranks, a large group lies in several range partitions; what earlier partitions hold of
    the group comes from one row per group and partition.
    """
    ordered = cut(df.repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id()))
    per = ordered.groupBy("_p", *group).agg(F.max(value).alias("_most"))
    before = F.max("_most").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    upto = per.select(F.col("_p").alias("_up"), *(F.col(g).alias(f"_u_{g}") for g in group), before.alias("_before"))
    here = Window.partitionBy("_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ordered.withColumn("_local", F.max(value).over(here))
    on = F.col("_p") == F.col("_up")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_u_{g}"))
    return local.join(upto, on, "inner").select(*df.columns, F.greatest("_local", "_before").alias(out))
