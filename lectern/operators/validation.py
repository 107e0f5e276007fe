"""Rule checks of a question set, per-question verdicts, and merging refined questions back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V


def each_persona(papers: DataFrame, personas: DataFrame, most: int = 1000) -> tuple[DataFrame, int]:
    """papers once for every persona code, and the number of codes. Personas are configuration; their number is checked."""
    codes = sorted(r.persona for r in personas.select("persona").distinct().limit(most + 1).collect())
    if len(codes) > most:
        raise ValueError(f"more than {most} personas are no configuration table")
    return papers.withColumn("persona", F.explode(F.array(*[F.lit(c) for c in codes]))), len(codes)


def persona_coverage(questions: DataFrame, personas: DataFrame) -> DataFrame:
    """Per paper: required personas missing, and distinct codes / required when some are (unknown codes count as present)."""
    need, n = each_persona(questions.select("paper").distinct(), personas)
    have = questions.select("paper", "persona").distinct()
    missing = need.join(have, ["paper", "persona"], "left_anti").groupBy("paper").agg(F.count("*").alias("missing"))
    out = have.groupBy("paper").agg(F.count("persona").alias("present")).join(missing, "paper", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    return out.withColumn("score", F.when(F.col("missing") > 0, F.round(F.col("present") / n, 3)).otherwise(1.0))


def question_count(questions: DataFrame, personas: DataFrame, each: int = 5) -> DataFrame:
    """1 - summed shortfall / (each * personas), not below 0."""
    grid, n = each_persona(questions.select("paper").distinct(), personas)
    counted = questions.groupBy("paper", "persona").agg(F.count("*").alias("n"))
    short = F.greatest(F.lit(0), F.lit(each) - F.coalesce("n", F.lit(0)))
    return grid.join(counted, ["paper", "persona"], "left").groupBy("paper").agg(F.sum(short).alias("shortfall")).withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - F.col("shortfall") / (each * n)), 3))


def section_validity(questions: DataFrame) -> DataFrame:
    bad = F.sum(X.invalid_section(F.col("section")).cast("int"))
    return questions.groupBy("paper").agg(bad.alias("issues"), F.round(1 - bad / F.greatest(F.count("*"), F.lit(1)), 3).alias("score"))


def concept_usage(flagged: DataFrame) -> DataFrame:
    """Share of questions that name a concept of their paper; a paper without concepts passes."""
    bad = F.sum((~F.col("has_concept") & F.col("any_concept")).cast("int"))
    return flagged.groupBy("paper").agg(bad.alias("issues"), F.round(1 - bad / F.greatest(F.count("*"), F.lit(1)), 3).alias("score"))


def redundancy(sums: DataFrame, counts: DataFrame) -> DataFrame:
    """1 - near-duplicate pairs / questions, not below 0. sums: pair sums; counts: paper, n."""
    near = F.coalesce("near", F.lit(0))
    return counts.join(sums.select("paper", "near"), "paper", "left").select("paper", "n", near.alias("near"), F.round(F.greatest(F.lit(0.0), 1 - near / F.greatest("n", F.lit(1))), 3).alias("score"))


def mean_score(components: DataFrame) -> DataFrame:
    """Mean of the enabled components: (paper, component, score) rows, one the judge's mean."""
    return components.groupBy("paper").agg(F.round(F.avg("score"), 3).alias("quality"))


def judge(questions: DataFrame, replies: DataFrame, passing: float = V.PASS) -> DataFrame:
    """Verdict of every question; without a reply the default is 0.5, borderline. replies: id, score, reasons."""
    score = V.clamp(F.coalesce("score", F.lit(0.5)))
    joined = questions.join(replies, "id", "left")
    return joined.withColumn("defaulted", F.col("score").isNull()).withColumn("score", score).withColumn("verdict", V.verdict(F.col("score"), passing)).withColumn("refine", F.col("verdict") != "pass")


def overlay(original: DataFrame, refined: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Refined rows over originals by key: revise replaces fields, unrepairable sets a flag, anything else keeps."""
    new = refined.select(*key, "action", *[F.col(f).alias(f"new_{f}") for f in fields])
    joined = original.join(new, key, "left")
    for f in fields:
        joined = joined.withColumn(f, F.when((F.col("action") == "revise") & F.col(f"new_{f}").isNotNull(), F.col(f"new_{f}")).otherwise(F.col(f)))
    action = F.when(F.col("action").isin("revise", "keep", "unrepairable"), F.col("action")).otherwise("keep")
    return joined.withColumn("unrepairable", F.coalesce(F.col("action") == "unrepairable", F.lit(False))).withColumn("action", action).drop(*[f"new_{f}" for f in fields])


def clean_question(column: str, kind: str) -> Column:
    """Placeholder sentinels out of a field. kind: question, answer or section."""
    c = F.trim(F.coalesce(F.col(column), F.lit("")))
    if kind == "section":
        return F.when((c.startswith("<") & c.endswith(">")) | c.isin("...", ""), "Body").otherwise(c)
    return F.when(c.isin("...", f"<your {'question text' if kind == 'question' else 'expected answer'} here>"), "").otherwise(c)


def clean_hints(hints: Column) -> Column:
    """Ontology hints with a known role and a term that is no placeholder."""
    return F.filter(F.coalesce(hints, F.array()), lambda h: ~F.trim(F.coalesce(h["term"], F.lit(""))).isin("<domain term>", "...", "", "<term>") & F.lower(F.trim(F.coalesce(h["role"], F.lit("")))).isin("class", "property", "individual", "axiom"))


def canonical_archetype(questions: DataFrame, archetypes: DataFrame, column: str = "archetype") -> DataFrame:
    """Archetype spellings to ids, whatever their case and separators; an unknown spelling stays as it is."""
    known = archetypes.groupBy(X.archetype_key(F.col("id")).alias("known_key")).agg(F.min("id").alias("known_id"))
    return questions.join(known, X.archetype_key(F.trim(F.col(column))) == F.col("known_key"), "left").withColumn(column, F.coalesce("known_id", column)).drop("known_id", "known_key")


def persona_archetypes(personas: DataFrame, affinity: DataFrame, archetypes: DataFrame, fallback: int = 4) -> DataFrame:
    """(persona, archetype, ord): the known archetypes a persona favours, in their own order; without any, the first `fallback`.

    affinity: persona, archetype (names that begin with "_" are notes); archetypes: archetype, ord. Both are configuration of a few rows.
    """
    known = archetypes.select("archetype", "ord").distinct()
    liked = affinity.where(~F.col("archetype").startswith("_")).select("persona", "archetype").distinct()
    own = personas.select("persona").distinct().join(liked, "persona").join(known, "archetype").select("persona", "archetype", "ord")
    place = F.row_number().over(Window.orderBy("ord", "archetype"))  # of the archetypes' own table
    first = known.withColumn("place", place).where(F.col("place") <= fallback)
    rest = personas.select("persona").distinct().join(own.select("persona").distinct(), "persona", "left_anti")
    listed = first.agg(F.collect_list(F.struct("archetype", "ord")).alias("first")).first()["first"]  # at most `fallback` rows
    default = F.array(*[F.struct(F.lit(r.archetype).alias("archetype"), F.lit(r.ord).alias("ord")) for r in listed]) if listed else None
    if default is None:
        return own
    return own.unionByName(rest.select("persona", F.inline(default)).select("persona", "archetype", F.col("ord").cast(known.schema["ord"].dataType).alias("ord")))


def corrupt_papers(questions: DataFrame, most: float = 0.5) -> DataFrame:
    """Papers whose share of unparsed questions is above `most`; nothing of theirs is written."""
    return questions.groupBy("paper").agg(F.avg((F.col("archetype") == "PARSE_ERROR").cast("int")).alias("share")).where(F.col("share") > most)
