"""Queries over events: extraction items (paper = user, key = type and value band), verdicts, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import narrowing as N
from ..operators import state as S
from ..operators import validation as C
from ..session import table
from .registry import query


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as extraction items; every eleventh has an empty key, which must not count."""
    band = F.floor(F.col("value") / 20).cast("string")
    key = F.when(F.col("event_id") % 11 == 0, "|").otherwise(F.concat(F.col("event_type"), F.lit("|"), band))
    level = F.when(F.col("event_id") % 3 == 0, "high").when(F.col("event_id") % 3 == 1, "low").otherwise(F.lit(None))
    sentence = F.concat(F.lit("s"), F.floor(F.col("value")).cast("string"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("paper"), F.lit("concepts").alias("category"), key.alias("key"), level.alias("confidence"), sentence.alias("sentence"), F.col("event_id").alias("ord"), F.floor(F.col("event_id") / 50).alias("chunk_id")
    )


_ITEMS = "SELECT user_id AS paper, event_type || '|' || CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS key, CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS confidence, 's' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS sentence, event_id AS ord FROM events WHERE event_id % 11 <> 0"
_RANK = "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
_TOLD = "SELECT paper, key, list(sentence ORDER BY ord)[1:3] AS evidence FROM (SELECT paper, key, sentence, min(ord) AS ord FROM i GROUP BY ALL) GROUP BY paper, key"
# an item without a confidence ranks as low when it promotes and counts as medium when it is the only one
_MERGED = f"WITH i AS ({_ITEMS}), e AS ({_TOLD}), m AS (SELECT paper, key, count(*) AS mentions, arg_max(confidence, (CASE WHEN confidence = 'high' THEN 3 ELSE 1 END, -ord)) AS confidence, min(ord) AS ord FROM i GROUP BY paper, key)"


@query(f"{_MERGED} SELECT m.paper, m.key, m.mentions, m.confidence, array_to_string(e.evidence, ',') AS evidence FROM m JOIN e USING (paper, key)")
def merge_state_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-2 below the caps: FLT-1, ARR-2, MAP-1."""
    return S.merge_items(items(spark, sf_dir)).select("paper", "key", "mentions", "confidence", F.array_join("evidence", ",").alias("evidence"))


@query(f"{_MERGED} SELECT paper, key, CAST(row_number() OVER (PARTITION BY paper ORDER BY mentions DESC, {_RANK} DESC, ord) AS INTEGER) AS rank FROM m QUALIFY rank <= 10")
def state_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-4 with a cap of ten."""
    return S.cap(S.merge_items(items(spark, sf_dir)), {"concepts": 10}).select("paper", "key", "rank")


@query(f"{_MERGED} SELECT paper, key, mentions, CAST(row_number() OVER (PARTITION BY paper ORDER BY mentions DESC, {_RANK} DESC, ord) AS INTEGER) AS rank FROM m QUALIFY rank <= 20")
def top_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-2."""
    return S.top_concepts(S.merge_items(items(spark, sf_dir))).select("paper", "key", "mentions", "rank")


@query(f"{_MERGED} SELECT confidence, count(*) AS n, CAST(sum(mentions) AS BIGINT) AS mentions FROM m GROUP BY confidence")
def confidence_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-1 and AGG-25 as a tally."""
    return S.merge_items(items(spark, sf_dir)).groupBy("confidence").agg(F.count("*").alias("n"), F.sum("mentions").alias("mentions"))


# The fold, replayed chunk by chunk: a new key goes behind the held ones; beyond 25, order by mentions and confidence and cut.
# A missing confidence is medium on a new key and low on a held one.
_FOLD = """WITH RECURSIVE i AS (
  SELECT user_id AS paper, event_type || '|' || CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS key, event_id AS ord,
    CASE event_id % 3 WHEN 0 THEN 3 ELSE 1 END AS again, CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS first, dense_rank() OVER (PARTITION BY user_id ORDER BY event_id // 50) AS step
  FROM events WHERE event_id % 11 <> 0
), c AS (
  SELECT paper, step, key, count(*) AS mentions, max(again) AS again, greatest(arg_min(first, ord), max(again)) AS first, min(ord) AS ord FROM i GROUP BY ALL
), ends AS (
  SELECT paper, max(step) AS last FROM c GROUP BY paper
), fold AS (
  SELECT paper, CAST(0 AS BIGINT) AS step, '' AS key, CAST(0 AS BIGINT) AS mentions, 0 AS level, CAST(-1 AS BIGINT) AS position FROM ends
  UNION ALL
  SELECT paper, step, key, mentions, level, position FROM (
    SELECT paper, step, key, mentions, level, row_number() OVER (PARTITION BY paper ORDER BY CASE WHEN n > 25 THEN -mentions END, CASE WHEN n > 25 THEN -level END, behind, place) - 1 AS position
    FROM (
      SELECT paper, step, key, CAST(sum(mentions) AS BIGINT) AS mentions, CASE WHEN min(behind) = 0 THEN greatest(max(held), max(again)) ELSE max(first) END AS level, min(behind) AS behind, arg_min(place, behind) AS place, count(*) OVER (PARTITION BY paper) AS n
      FROM (
        SELECT f.paper, f.step + 1 AS step, f.key, f.mentions, f.level AS held, 0 AS again, 0 AS first, 0 AS behind, f.position AS place FROM fold AS f JOIN ends ON ends.paper = f.paper AND f.step < ends.last WHERE f.key <> ''
        UNION ALL
        SELECT c.paper, c.step, c.key, c.mentions, 0, c.again, c.first, 1, c.ord FROM c JOIN (SELECT DISTINCT paper, step FROM fold) AS f ON c.paper = f.paper AND c.step = f.step + 1
      ) GROUP BY paper, step, key
    )
  ) WHERE position < 25
) SELECT CAST(paper AS VARCHAR) AS paper, 'concepts' AS category, key, mentions, CASE level WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence, position AS ord FROM fold JOIN ends USING (paper) WHERE step = last"""


@query(_FOLD)
def rolling_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1: the ordered fold with eviction."""
    rows = S.fold(items(spark, sf_dir), {"concepts": 25})
    return rows.select("paper", "category", "key", "mentions", "confidence", "ord")


@query(_FOLD)
def rolling_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1 as a stream: the same fold over event files as they arrive, state keyed by paper."""
    from ..streaming.rolling import run_available

    return run_available(items(spark, sf_dir), {"concepts": 25})


def _view(share: float) -> str:
    return f"""'{{"concepts":[' || string_agg('{{"key":"' || key || '","mentions":' || mentions || ',"confidence":"' || confidence || '"}}', ',' ORDER BY rank) FILTER (WHERE rank <= greatest(1, floor(n * CAST({share} AS DOUBLE)))) || ']}}'"""


_VIEWS = ", ".join(f"{_view(share)} AS v{i}" for i, share in enumerate([1.0, *S.SHRINK]))
_TRIES = " ".join(f"WHEN length(v{i}) <= 4000 THEN v{i}" + (f" || '{S.SHRUNK_NOTE}'" if i else "") for i in range(len(S.SHRINK) + 1))


@query(
    f"""{_MERGED}, r AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY mentions DESC, {_RANK} DESC, ord) AS rank FROM m QUALIFY rank <= {S.KEEP["concepts"]}),
    v AS (SELECT paper, {_VIEWS} FROM (SELECT *, count(*) OVER (PARTITION BY paper) AS n FROM r) GROUP BY paper),
    t AS (SELECT paper, CASE {_TRIES} ELSE left(v{len(S.SHRINK)}, 4000) || '{S.CUT_NOTE}' END AS view FROM v)
    SELECT paper, length(view) AS n_chars, md5(view) AS digest FROM t"""
)
def compact_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-5 and PRJ-2: JSON views within 4,000 characters."""
    rows = S.compact(S.merge_items(items(spark, sf_dir)))
    return rows.select("paper", F.length("view").cast("long").alias("n_chars"), F.md5("view").alias("digest"))


@query("SELECT event_id, round(least(1.0, greatest(0.0, value / 100 - 0.2)), 6) AS score, CASE WHEN value / 100 - 0.2 >= 0.75 THEN 'pass' WHEN value / 100 - 0.2 >= 0.4 THEN 'borderline' ELSE 'fail' END AS verdict FROM events")
def verdict_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15 and MATH-1."""
    raw = F.col("value") / 100 - 0.2
    return table(spark, sf_dir, "events").select("event_id", F.round(V.clamp(raw), 6).alias("score"), V.verdict(raw).alias("verdict"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as member verdicts: group = user and hour of id, paper = type."""
    kind = F.when(F.col("event_type") == "error", "NOT_FOUND").when(F.col("value") >= 60, "PASS").when(F.col("value") >= 25, "PARTIAL").otherwise("FAIL")
    return table(spark, sf_dir, "events").select(F.pmod(F.col("event_id") * 7919, F.lit(997)).alias("group_id"), F.col("event_type").alias("paper"), kind.alias("verdict"), F.least(F.lit(1.0), F.floor("value") / 100).alias("score"))


_GROUPS = """WITH r AS (SELECT (event_id * 7919) % 997 AS group_id, event_type AS paper, CASE WHEN event_type = 'error' THEN 'NOT_FOUND' WHEN value >= 60 THEN 'PASS' WHEN value >= 25 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict, least(1.0, floor(value) / 100) AS score FROM events),
g AS (SELECT group_id, count(*) FILTER (WHERE verdict = 'PASS') AS n_pass, count(*) FILTER (WHERE verdict = 'PARTIAL') AS n_partial, count(*) FILTER (WHERE verdict = 'FAIL') AS n_fail, count(*) FILTER (WHERE verdict = 'NOT_FOUND') AS n_absent,
  count(DISTINCT paper) AS n_papers, coalesce(round(avg(score) FILTER (WHERE verdict <> 'NOT_FOUND'), 9), 0.0) AS mean_fidelity FROM r GROUP BY group_id),
o AS (SELECT *, CASE WHEN n_pass + n_partial + n_fail + n_absent = 0 THEN 'NO_DATA' WHEN n_pass + n_partial + n_fail = 0 THEN 'NOT_FOUND' WHEN n_pass / (n_pass + n_partial + n_fail) >= 0.75 THEN 'PASS' WHEN n_pass / (n_pass + n_partial + n_fail) >= 0.4 THEN 'PARTIAL' ELSE 'FAIL' END AS overall FROM g),
f AS (SELECT *, CASE WHEN overall = 'NOT_FOUND' OR (n_absent > 0 AND overall <> 'PASS') THEN 'OVER_GENERALISED' WHEN overall = 'PASS' AND n_papers = 1 THEN 'PAPER_SPECIFIC' WHEN overall = 'PASS' AND mean_fidelity >= 0.75 THEN 'STRONG' WHEN overall IN ('PARTIAL', 'FAIL') AND mean_fidelity < 0.4 THEN 'UNDER_ANSWERED' WHEN overall = 'PARTIAL' THEN 'PARTIAL' ELSE 'STRONG' END AS flag FROM o)"""


@query(f"{_GROUPS} SELECT group_id, n_pass, n_partial, n_fail, n_absent, n_papers, mean_fidelity, overall, flag FROM f")
def group_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19, AGG-20, AGG-21 per group; nine digits, as ties at three round differently between engines."""
    return N.group_verdicts(results(spark, sf_dir), digits=9)


@query(f"{_GROUPS} SELECT overall, flag, count(*) AS n FROM f GROUP BY overall, flag")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22."""
    return N.group_verdicts(results(spark, sf_dir), digits=9).groupBy("overall", "flag").agg(F.count("*").alias("n"))


@query(f"{_GROUPS} SELECT count(*) AS n_groups, round(avg(mean_fidelity) FILTER (WHERE mean_fidelity > 0), 3) AS mean_fidelity FROM f")
def mean_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21 over the corpus."""
    g = N.group_verdicts(results(spark, sf_dir), digits=9)
    return g.agg(F.count("*").alias("n_groups"), F.round(F.avg(F.when(F.col("mean_fidelity") > 0, F.col("mean_fidelity"))), 3).alias("mean_fidelity"))


@query(
    """WITH c AS (SELECT user_id, event_id, event_type <> 'error' AS ok FROM events), i AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM c),
    s AS (SELECT *, sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY user_id, island ORDER BY event_id) AS streak FROM i)
    SELECT user_id, event_id, CAST(streak AS BIGINT) AS streak, max(CAST(streak >= 3 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS aborted FROM s"""
)
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-6: consecutive failures, abort at three."""
    calls = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return N.failure_streaks(calls, "user_id", ["event_id"], F.col("event_type") != "error").select("user_id", "event_id", "streak", "aborted")


@query("SELECT user_id AS paper, round(avg(CAST(event_type = 'error' AS INTEGER)), 6) AS share FROM events GROUP BY user_id HAVING avg(CAST(event_type = 'error' AS INTEGER)) > 0.22")
def corrupt_output_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-5 (limit lowered to what the synthetic events reach)."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("paper"), F.when(F.col("event_type") == "error", "PARSE_ERROR").otherwise("x").alias("archetype"))
    return C.corrupt_papers(rows, 0.22).withColumn("share", F.round("share", 6))
