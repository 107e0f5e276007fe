"""Corpus report queries: metric summaries, composites, totals, console lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import report as R
from ..session import table
from .registry import query

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 4) AS mean, round(stddev_pop({m}), 4) AS sd, round(min({m}), 4) AS min, round(max({m}), 4) AS max, count({m}) AS n FROM lineitem" for m in MEASURES))
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1 over measures: one pass, partial aggregation."""
    return R.metric_summary(table(spark, sf_dir, "lineitem"), MEASURES, digits=4)


_PAPERS = """SELECT l_suppkey AS paper, round(avg(l_discount) * 10, 3) AS coverage, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE round(avg(l_tax) * 10, 3) END AS question_faithfulness, round(avg(l_quantity) / 50, 3) AS diversity, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE round(count(*) / (count(*) + 100.0), 3) END AS triplifiability FROM lineitem GROUP BY l_suppkey"""
_W = {"coverage": 0.38, "question_faithfulness": 0.44, "diversity": 0.12, "triplifiability": 0.06}


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("paper")).agg(
        F.round(F.avg("l_discount") * 10, 3).alias("coverage"), F.round(F.avg("l_tax") * 10, 3).alias("t"), F.round(F.avg("l_quantity") / 50, 3).alias("diversity"), F.round(F.count("*") / (F.count("*") + 100.0), 3).alias("r")
    )
    return g.select("paper", "coverage", F.when(F.col("paper") % 3 != 0, F.col("t")).alias("question_faithfulness"), "diversity", F.when(F.col("paper") % 7 != 0, F.col("r")).alias("triplifiability"))


@query(f"SELECT paper, round(({' + '.join(f'coalesce({k} * {w}, 0)' for k, w in _W.items())}) / ({' + '.join(f'CASE WHEN {k} IS NULL THEN 0 ELSE {w} END' for k, w in _W.items())}), 3) AS overall FROM ({_PAPERS})")
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-9: weights renormalised over families with a score."""
    rows = families(spark, sf_dir).unpivot(["paper"], list(_W), "family", "score")
    return E.composite(rows)


@query("SELECT count(*) AS n_papers, CAST(sum(n) AS BIGINT) AS total_questions, CAST(sum(off) AS BIGINT) AS total_off_paper, CAST(sum(near) AS BIGINT) AS total_near_dupes FROM (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS off, count(*) FILTER (WHERE l_linestatus = 'F') AS near FROM lineitem GROUP BY l_suppkey)")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-2."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n_questions"), F.count_if(F.col("l_returnflag") == "R").alias("n_off_paper"), F.count_if(F.col("l_linestatus") == "F").alias("n_near_dupes"))
    return R.totals(g)


@query("SELECT paper, rpad(CAST(paper AS VARCHAR), 12, ' ') || ' ' || lpad(format('{:.3f}', coverage), 8, ' ') || ' ' || CASE WHEN question_faithfulness IS NULL THEN '       -' ELSE lpad(format('{:.3f}', question_faithfulness), 8, ' ') END AS line FROM (" + _PAPERS + ")")
def console_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-5: fixed-width lines, nulls as '-'."""
    rows = families(spark, sf_dir)
    lines = R.console_table(rows, [("paper", 12, -1), ("coverage", 8, 3), ("question_faithfulness", 8, 3)])
    return lines.select(F.trim(F.substring("line", 1, 12)).cast("long").alias("paper"), "line")


@query(f"SELECT paper, CASE WHEN question_faithfulness IS NULL THEN 0.0 ELSE question_faithfulness END AS value, '{{\"coverage\":' || CAST(coverage AS VARCHAR) || CASE WHEN question_faithfulness IS NULL THEN '' ELSE ',\"question_faithfulness\":' || CAST(question_faithfulness AS VARCHAR) END || '}}' AS view FROM ({_PAPERS})")
def nested_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-1 path with default, PRJ-3 non-empty view."""
    nested = families(spark, sf_dir).select("paper", F.struct(F.struct("coverage", "question_faithfulness").alias("scores")).alias("evaluation"))
    return nested.select("paper", F.coalesce("evaluation.scores.question_faithfulness", F.lit(0.0)).alias("value"), F.to_json("evaluation.scores").alias("view"))
