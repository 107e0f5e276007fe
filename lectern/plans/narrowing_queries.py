"""Queries over orders, lineitem, part and supplier as group, member, question and paper tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import narrowing as N
from ..session import keep, table
from .registry import query


@query("SELECT l_partkey AS group_id, count(DISTINCT l_suppkey) AS n_papers, CASE WHEN count(DISTINCT l_suppkey) <= 2 THEN 'narrow' WHEN count(DISTINCT l_suppkey) <= 6 THEN 'medium' ELSE 'broad' END AS breadth FROM lineitem GROUP BY l_partkey")
def coverage_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17: distinct papers (suppliers) of each group (part)."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("group_id")).agg(F.count_distinct("l_suppkey").alias("n_papers"))
    return g.withColumn("breadth", V.breadth(F.col("n_papers")))


_BLOOM = "['knowledge','comprehension','application','analysis','synthesis','evaluation','???']"
_MEMBERS = f"SELECT l_orderkey AS group_id, l_suppkey AS paper, list_extract({_BLOOM}, CAST(l_linenumber % 7 + 1 AS INTEGER)) AS bloom, l_linenumber % 7 + 1 AS level FROM lineitem"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.array(*[F.lit(b) for b in [*V.BLOOM, "???"]])
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("group_id"), F.monotonically_increasing_id().alias("id"), F.col("l_suppkey").alias("paper"), F.element_at(levels, (F.col("l_linenumber") % 7 + 1).cast("int")).alias("bloom"), F.col("l_linenumber").alias("ord")
    )


@query(
    f"""SELECT group_id, count(*) AS n_members, count(DISTINCT paper) AS n_papers, list_sort(list(DISTINCT paper)) AS papers, coalesce(arg_max(bloom, level) FILTER (WHERE level < 7), 'comprehension') AS bloom,
    CASE WHEN count(DISTINCT paper) <= 2 THEN 'narrow' WHEN count(DISTINCT paper) <= 6 THEN 'medium' ELSE 'broad' END AS breadth FROM ({_MEMBERS}) GROUP BY group_id"""
)
def bloom_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-9, AGG-18, SET-5: provenance of each group from its members."""
    rows = keep(members(spark, sf_dir))  # its ids are facts from here on
    return N.gather_members(rows.select("group_id", "id", "ord"), rows.select("id", "paper", "bloom"))


@query(
    """WITH a AS (SELECT o_orderpriority AS archetype, count(*) AS n_in FROM orders GROUP BY 1), b AS (SELECT o_orderpriority AS archetype, count(*) AS n_out FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT 'NEW', count(*) FROM region)
    SELECT coalesce(a.archetype, b.archetype) AS archetype, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, CASE WHEN coalesce(n_in, 0) > 0 THEN round((n_in - coalesce(n_out, 0)) / n_in, 3) ELSE 0.0 END AS reduction FROM a FULL JOIN b ON a.archetype = b.archetype"""
)
def archetype_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16 and AGG-26: full outer union of archetypes in and out."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("archetype"), "o_orderstatus")
    b = a.where("o_orderstatus = 'F'").select("archetype").unionByName(table(spark, sf_dir, "region").select(F.lit("NEW").alias("archetype")))
    return N.in_out(a, b, "archetype")


@query("SELECT l_partkey AS id, arg_min(l_orderkey, (l_linenumber, l_orderkey)) AS group_id FROM lineitem GROUP BY l_partkey")
def reverse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D21: member to its first group."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("ord"))
    return N.reverse_index(rows)


@query("SELECT o.o_custkey AS out_id, o.o_orderkey AS ref, coalesce(l.l_partkey, o.o_orderkey) AS id FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND o.o_orderstatus <> 'P'")
def expand_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-10: references to original ids, unknown ones as themselves."""
    orders = table(spark, sf_dir, "orders")
    a = table(spark, sf_dir, "lineitem").join(orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("ref"), F.col("l_partkey").alias("id"))
    return N.expand_ids(orders.select(F.col("o_custkey").alias("out_id"), F.col("o_orderkey").alias("ref")), a)


@query("SELECT ref, 'FB_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS out_id FROM (SELECT p_partkey AS ref, row_number() OVER (ORDER BY p_partkey) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48))")
def orphan_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-12 and WIN-1: first-stage groups no output mentions."""
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("ref"))
    return N.orphans(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref")), used).select("ref", "out_id")


@query(
    """SELECT DISTINCT c_custkey AS id, 'missing' AS problem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)
    UNION ALL SELECT DISTINCT o_custkey + 1000000 AS id, 'extra' AS problem FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000"""
)
def audit_missing_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-13: inputs not accounted for, and accounted ids that are no inputs."""
    seen = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    accounted = seen.select(F.col("o_custkey").alias("id")).unionByName(seen.where("o_orderstatus = 'P'").select((F.col("o_custkey") + 1_000_000).alias("id")))
    return N.audit(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), accounted)


@query("SELECT o_orderkey, 'GEN_' || o_orderpriority || '_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS new_id FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders)")
def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-1: running ids per archetype."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return N.assign_ids(rows, F.concat(F.lit("GEN_"), F.col("o_orderpriority"), F.lit("_")), ["o_orderpriority"], ["o_orderkey"]).select("o_orderkey", "new_id")


@query("SELECT p_partkey, base || CASE WHEN n BETWEEN 2 AND 11 THEN substr('abcdefghij', CAST(n - 1 AS INTEGER), 1) ELSE '' END AS resolved FROM (SELECT p_partkey, p_brand || p_type AS base, row_number() OVER (PARTITION BY p_brand || p_type ORDER BY p_partkey) AS n FROM part)")
def id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-2."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", "p_type").alias("base"))
    return N.resolve_collisions(rows, "base", ["p_partkey"]).select("p_partkey", "resolved")


@query(
    """WITH k AS (SELECT o_orderkey AS source_id, 'D' || o_orderkey AS new_id FROM orders WHERE o_orderstatus = 'F') SELECT l.l_orderkey AS keep_id, l.l_linenumber AS line, coalesce(k.new_id, '(source: ' || l.l_orderkey || ')') AS absorbed_into FROM lineitem l LEFT JOIN k ON k.source_id = l.l_orderkey"""
)
def absorbed_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-8: two hops with a note where the keeper is unknown."""
    keep = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("source_id"), F.concat(F.lit("D"), F.col("o_orderkey").cast("string")).alias("new_id"))
    gone = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("keep_id"))
    return N.absorbed_into(gone, keep).select("keep_id", "line", "absorbed_into")


@query("SELECT count(*) AS inputs, count(*) FILTER (WHERE o_orderstatus = 'F') AS representatives, count(*) FILTER (WHERE o_orderstatus <> 'F') AS discarded, true AS accounted FROM orders")
def partition_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-6."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return N.partition_audit(o, o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"))


@query("SELECT l_orderkey AS group_id, count(*) AS members FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY l_orderkey")
def known_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-6: invented members stripped, emptied groups dropped."""
    groups = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("member"))
    return N.only_known(groups, table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("id"))).groupBy("group_id").agg(F.count("*").alias("members"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def unmentioned_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-3 / SET-4: what neither keepers nor discards mention."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    return N.singletons_for_rest(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"))


@query(
    """SELECT o.o_custkey AS out_id, list_sort(list(DISTINCT l.l_suppkey)) AS papers_covered, count(DISTINCT l.l_suppkey) AS n_papers, list_sort(list(DISTINCT l.l_returnflag)) AS source_archetypes,
    CASE WHEN count(DISTINCT l.l_suppkey) <= 2 THEN 'narrow' WHEN count(DISTINCT l.l_suppkey) <= 6 THEN 'medium' ELSE 'broad' END AS breadth FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey"""
)
def repaired_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-11: papers and archetypes recomputed from members."""
    m = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("out_id"), F.col("o_orderkey").alias("id"))
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("paper"), F.col("l_returnflag").alias("archetype"))
    return N.repaired_fields(m, o)


@query("SELECT 'all' AS scope, count(*) AS n_in, count(DISTINCT p_name || p_brand) AS n_out, round(1 - count(DISTINCT p_name || p_brand) / count(*), 3) AS reduction FROM part")
def reduction_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23 reduction."""
    p = table(spark, sf_dir, "part").select(F.lit("all").alias("scope"), F.concat("p_name", "p_brand").alias("name"))
    return N.in_out(p, p.distinct(), "scope")


@query("SELECT group_id, segment, count(*) AS n, list(id ORDER BY id) AS merged_from FROM (SELECT p_partkey AS id, min(p_partkey) OVER w AS group_id, (row_number() OVER (PARTITION BY p_name, p_brand, p_type ORDER BY p_partkey) - 1) // 2 AS segment FROM part WINDOW w AS (PARTITION BY p_name, p_brand, p_type)) GROUP BY group_id, segment")
def merged_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic stage-A merge on (subject, predicate, object)."""
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("subject"), F.col("p_brand").alias("predicate"), F.col("p_type").alias("object"))
    return N.merge_signatures(t, size=2).select("group_id", "segment", F.size("merged_from").cast("long").alias("n"), "merged_from")


@query("SELECT user_id AS paper, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS n_revised, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS n_kept, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS n_unrepairable, CAST(count(*) FILTER (WHERE event_type IS NULL OR event_type NOT IN ('click', 'view', 'purchase')) AS BIGINT) AS n_other FROM events GROUP BY user_id")
def refine_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25: events as refiner answers; types that are no action count as unanswered."""
    action = F.when(F.col("event_type") == "click", "revise").when(F.col("event_type") == "view", "keep").when(F.col("event_type") == "purchase", "unrepairable").otherwise(F.col("event_type"))
    return N.refine_tallies(table(spark, sf_dir, "events").select(F.col("user_id").alias("paper"), action.alias("action")))


@query("SELECT c.c_custkey AS paper, c.c_mktsegment AS segment, coalesce(n.n_name, 'DEFAULT') AS model FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey < 3")
def role_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-8 and JOIN-14: configuration lookup with a default."""
    from ..sources.files import role_model

    config = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.lit("p").alias("pipeline"), F.col("n_nationkey").cast("string").alias("role"), F.col("n_name").alias("value"))
    needs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper"), F.col("c_mktsegment").alias("segment"), F.lit("p").alias("pipeline"), F.col("c_nationkey").cast("string").alias("role"))
    return role_model(needs, config, "DEFAULT").select("paper", "segment", "model")
