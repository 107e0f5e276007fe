"""Corpus statistics over per-paper evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ["overall", "coverage", "faithfulness", "diversity", "triplifiability", "concept_cov", "faith_cosine"]


def unpivot(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, value) rows of the numeric columns, nulls left out."""
    return rows.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", "value").where("value is not null and not isnan(value)")


def metric_summary(rows: DataFrame, metrics: list[str] = METRICS, digits: int = 6) -> DataFrame:
    """Mean, population deviation, extremes and count of each metric; a metric without values is all 0."""
    got = unpivot(rows, metrics).groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))
    names = rows.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    full = names.join(got, "metric", "left")
    return full.select("metric", *[F.round(F.coalesce(c, F.lit(0.0)), digits).alias(c) for c in ("mean", "sd", "min", "max")], F.coalesce("n", F.lit(0)).alias("n"))


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_papers"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(a) for c, a in (("n_questions", "total_questions"), ("n_off_paper", "total_off_paper"), ("n_near_dupes", "total_near_dupes"))])


def console_table(rows: DataFrame, columns: list[tuple[str, int, int]]) -> DataFrame:
    """One fixed-width line a row; (column, width, decimals or -1); nulls print as '-'."""
    cells = []
    for name, width, digits in columns:
        text = F.col(name).cast("string") if digits < 0 else F.format_string(f"%.{digits}f", F.col(name).cast("double"))
        cell = F.coalesce(F.when(F.col(name).isNotNull(), text), F.lit("-"))
        cells.append(F.rpad(cell, width, " ") if digits < 0 else F.lpad(cell, width, " "))
    return rows.select(F.concat_ws(" ", *cells).alias("line"))
