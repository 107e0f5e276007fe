"""Ordered lists of groups of any size, in segments: no row, and no task, holds a whole group.

A group's rows get running ordinals (`ranges.running_sums`), and `size` of them in a row are one segment: (group, segment, items). Readers
go by segment: `members` gives items with their ordinals back, `item_at` one item, without putting a group together.

Defined cases: nulls of the group are one group; rows tied in the order come in any order among themselves; null items stay; an empty
table gives no segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import running_sums

SEGMENT = 1000


def segmented(rows: DataFrame, part: list[str], order: list[str], value: str, size: int = SEGMENT) -> DataFrame:
    """(*part, segment, items): the values of each group in order, at most `size` a row; segments count from 0."""
    numbered = running_sums(rows.select(*dict.fromkeys([*part, *order, value])), part, order, {"_ord": F.lit(1).cast("long")})
    cut = numbered.withColumn("segment", F.floor((F.col("_ord") - 1) / size).cast("long"))
    return cut.groupBy(*part, "segment").agg(F.array_sort(F.collect_list(F.struct("_ord", F.col(value).alias("v"))))["v"].alias("items"))


def members(segments: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Items of segments, one a row, with their ordinals in the group from 1."""
    others = [c for c in segments.columns if c not in ("segment", "items")]
    return segments.select(*others, "segment", F.posexplode("items").alias("_place", "item")).select(*others, (F.col("segment") * size + F.col("_place") + 1).alias("ord"), "item")


def item_at(segments: DataFrame, ordinal: Column, size: int = SEGMENT) -> DataFrame:
    """The item of each group with this ordinal; groups that are shorter have no row."""
    place = ordinal - 1
    found = segments.where(F.col("segment") == F.floor(place / size)).withColumn("item", F.get("items", (place % size).cast("int")))
    return found.where(place % size < F.size("items")).drop("segment", "items")
