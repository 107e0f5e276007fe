"""Running sums inside groups of any size: a group that holds a third of all rows is still many tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep


def running_sums(rows: DataFrame, part: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """rows with, for each name, the sum of its value over all rows of the same `part` up to this one in `order`.

    Rows are dealt by ranges of (part, order); sums run inside a range, and what earlier ranges of the part hold is added. Only one
    row a (range, part) takes part in the second step. Nulls of `part` are one group; rows tied in `order` are taken in any order;
    an empty table stays empty.
    """
    made = rows.select("*", *[v.alias(f"_value_{n}") for n, v in values.items()])
    ranged = keep(made.repartitionByRange(*part, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range", *part).agg(*[F.sum(f"_value_{n}").alias(f"_all_{n}") for n in values])
    earlier = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("_range").alias("_in"), *[F.col(c).alias(f"_part_{i}") for i, c in enumerate(part)], *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in values])
    inside = Window.partitionBy("_range", *part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select("*", *[F.sum(f"_value_{n}").over(inside).alias(f"_inside_{n}") for n in values])
    same = reduce(lambda a, b: a & b, [F.col("_range") == F.col("_in"), *[F.col(c).eqNullSafe(F.col(f"_part_{i}")) for i, c in enumerate(part)]])
    return summed.join(before, same).select(*rows.columns, *[(F.col(f"_inside_{n}") + F.col(f"_before_{n}")).alias(n) for n in values])
