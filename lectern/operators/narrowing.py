"""Narrowing questions within and across papers: groups, provenance, repairs, audits.

Every list is a long table with an ordinal. Groups come as (group, member, ord) rows; what the text model proposes is
repaired so that every input is in exactly one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..session import keep
from . import lists
from .ranges import running_sums


def assign_ids(rows: DataFrame, prefix: Column, part: list[str], order: list[str], name: str = "new_id") -> DataFrame:
    """prefix + a three-digit running number in input order, restarting for each value of `part`; without one, over all rows."""
    rows = running_sums(rows, part, order, {"_n": F.lit(1).cast("long")})
    return rows.withColumn(name, F.concat(prefix, F.format_string("%03d", F.col("_n")))).drop("_n")


def resolve_collisions(rows: DataFrame, base: str, order: list[str], name: str = "resolved") -> DataFrame:
    """The base id, then base with a..j for the next ten, then base again."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    suffix = F.when((n >= 2) & (n <= 11), F.substring(F.lit("abcdefghij"), n - 1, F.lit(1))).otherwise("")
    return rows.withColumn(name, F.concat(base, suffix))


def only_known(groups: DataFrame, inputs: DataFrame) -> DataFrame:
    """Group members that exist; members a model invented go, and groups they leave empty with them."""
    return groups.join(inputs.select(F.col("id").alias("member")), "member", "left_semi")


def invented(groups: DataFrame, inputs: DataFrame) -> DataFrame:
    return groups.join(inputs.select(F.col("id").alias("member")), "member", "left_anti")


def singletons_for_rest(inputs: DataFrame, *taken: DataFrame) -> DataFrame:
    """Inputs that no taken(id) table mentions; each becomes a group of its own."""
    rest = inputs
    for t in taken:
        rest = rest.join(t.select("id"), "id", "left_anti")
    return rest


def absorbed_into(discarded: DataFrame, keepers: DataFrame) -> DataFrame:
    """discarded(id, keep_id) -> the id assigned to its keeper, or a note of the source. keepers: source_id, new_id."""
    known = keepers.select(F.col("source_id").alias("keep_id"), F.col("new_id").alias("found"))
    return discarded.join(known, "keep_id", "left").withColumn("absorbed_into", F.coalesce("found", F.concat(F.lit("(source: "), F.col("keep_id").cast("string"), F.lit(")")))).drop("found")


def partition_audit(inputs: DataFrame, representatives: DataFrame, discarded: DataFrame) -> DataFrame:
    """One row: sizes, and whether inputs are exactly representatives plus discarded."""
    names = ("inputs", "representatives", "discarded")
    tagged = None
    for name, rows in zip(names, (inputs, representatives, discarded), strict=True):
        one = rows.select(F.lit(name).alias("kind"))
        tagged = one if tagged is None else tagged.unionByName(one)
    counts = tagged.agg(*[F.count_if(F.col("kind") == name).alias(name) for name in names])
    return counts.withColumn("accounted", F.col("inputs") == F.col("representatives") + F.col("discarded"))


def gather_members(members: DataFrame, originals: DataFrame) -> DataFrame:
    """Per group: papers (sorted), archetypes, size, breadth and highest Bloom level. members: group_id, id, ord."""
    rows = members.join(originals, "id")
    return rows.groupBy("group_id").agg(
        F.count("*").alias("n_members"),
        F.array_sort(F.collect_set("paper")).alias("papers"),
        F.count_distinct("paper").alias("n_papers"),
        F.coalesce(F.max_by(F.when(V.bloom_rank(F.col("bloom")) > 0, F.col("bloom")), F.when(V.bloom_rank(F.col("bloom")) > 0, F.struct(V.bloom_rank(F.col("bloom")), -F.col("ord")))), F.lit("comprehension")).alias("bloom"),
    ).withColumn("breadth", V.breadth(F.col("n_papers")))


def reverse_index(members: DataFrame) -> DataFrame:
    """member -> group; a member of several groups belongs to the first."""
    return members.groupBy("id").agg(F.min_by("group_id", F.struct("ord", "group_id")).alias("group_id"))


def expand_ids(references: DataFrame, stage_a: DataFrame) -> DataFrame:
    """references(out_id, ref) -> original ids through stage_a(ref, id); an unknown reference stands for itself."""
    return references.join(stage_a, "ref", "left").select("out_id", "ref", F.coalesce("id", "ref").alias("id"))


def repaired_fields(members: DataFrame, originals: DataFrame) -> DataFrame:
    """Papers and archetypes of each output recomputed from its members."""
    return members.join(originals, "id").groupBy("out_id").agg(F.array_sort(F.collect_set("paper")).alias("papers_covered"), F.count_distinct("paper").alias("n_papers"), F.array_sort(F.collect_set("archetype")).alias("source_archetypes")).withColumn("breadth", V.breadth(F.col("n_papers")))


def orphans(stage_a: DataFrame, referenced: DataFrame) -> DataFrame:
    """First-stage groups that no second-stage output mentions, as FB_nnn rows."""
    lost = stage_a.select("ref").distinct().join(referenced.select("ref"), "ref", "left_anti")
    return assign_ids(lost, F.lit("FB_"), [], ["ref"], "out_id")


def audit(inputs: DataFrame, accounted: DataFrame) -> DataFrame:
    """(id, problem): inputs nobody accounts for, and accounted ids that are no input."""
    missing = inputs.select("id").distinct().join(accounted.select("id"), "id", "left_anti").withColumn("problem", F.lit("missing"))
    extra = accounted.select("id").distinct().join(inputs.select("id"), "id", "left_anti").withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra)


def in_out(inputs: DataFrame, outputs: DataFrame, by: str) -> DataFrame:
    """Counts in and out and the reduction of each value of `by` that either side has."""
    a, b = inputs.groupBy(by).agg(F.count("*").alias("n_in")), outputs.groupBy(by).agg(F.count("*").alias("n_out"))
    n_in, n_out = F.coalesce("n_in", F.lit(0)), F.coalesce("n_out", F.lit(0))
    both = a.join(b, by, "full_outer").select(by, n_in.alias("n_in"), n_out.alias("n_out"))
    return both.withColumn("reduction", F.when(F.col("n_in") > 0, F.round((F.col("n_in") - F.col("n_out")) / F.col("n_in"), 3)).otherwise(0.0))


def repeated_texts(rows: DataFrame, text: Column) -> DataFrame:
    """Normalised texts that occur more than once, with how often."""
    return rows.groupBy(text.alias("text")).agg(F.count("*").alias("n")).where("n > 1")


def group_verdicts(results: DataFrame, digits: int = 3) -> DataFrame:
    """Per group from (group_id, paper, verdict, score): counts, overall verdict, mean fidelity of judged members, flag."""
    absent = F.col("verdict").isin("NOT_FOUND", "INDEX_MISSING")
    g = results.groupBy("group_id").agg(
        F.count_if(F.col("verdict") == "PASS").alias("n_pass"),
        F.count_if(F.col("verdict") == "PARTIAL").alias("n_partial"),
        F.count_if(F.col("verdict") == "FAIL").alias("n_fail"),
        F.count_if(absent).alias("n_absent"),
        F.count_distinct("paper").alias("n_papers"),
        F.coalesce(F.round(F.avg(F.when(~absent, F.col("score"))), digits), F.lit(0.0)).alias("mean_fidelity"),
    )
    g = g.withColumn("overall", V.group_verdict(F.col("n_pass"), F.col("n_partial"), F.col("n_fail"), F.col("n_absent")))
    return g.withColumn("flag", V.quality_flag(F.col("overall"), F.col("n_papers"), F.col("n_absent"), F.col("mean_fidelity")))


def merge_signatures(triples: DataFrame, size: int = lists.SEGMENT) -> DataFrame:
    """Deterministic consolidation: questions whose sets of (subject, predicate, object) are equal share a group: (group_id, segment, merged_from).

    A group's members come in segments of at most `size`; the group's id is its smallest member. A question's own triples are few.
    """
    signed = triples.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("subject", "predicate", "object"))).alias("signature"))
    signed = keep(signed.select("id", F.sha2(F.to_json("signature"), 256).alias("signature")))
    first = signed.groupBy("signature").agg(F.min("id").alias("group_id"))
    segments = lists.segmented(signed, ["signature"], ["id"], "id", size)
    return segments.join(first, "signature").select("group_id", "segment", F.col("items").alias("merged_from"))


def refine_tallies(refined: DataFrame) -> DataFrame:
    """AGG-25: per paper, how many failing questions were revised, kept or found beyond repair, and how many got no usable answer. refined: paper, action."""
    known = ["revise", "keep", "unrepairable"]
    names = ["n_revised", "n_kept", "n_unrepairable"]
    return refined.groupBy("paper").agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in zip(known, names, strict=True)], F.count_if(F.coalesce(~F.col("action").isin(known), F.lit(True))).alias("n_other"))


def failure_streaks(calls: DataFrame, part: str, order: list[str], ok: Column, abort_at: int = 3) -> DataFrame:
    """calls with `streak`, the consecutive failures up to each, and `aborted` from the first streak that reaches the limit."""
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = calls.withColumn("island", F.sum(ok.cast("int")).over(w))
    inside = Window.partitionBy(part, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("streak", F.sum((~ok).cast("int")).over(inside))
    return rows.withColumn("aborted", F.max((F.col("streak") >= abort_at).cast("int")).over(w) == 1)
