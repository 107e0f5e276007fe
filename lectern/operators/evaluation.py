"""Reference-free scoring of a paper's questions: coverage, faithfulness, diversity, triples, specificity, composite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from . import names as N


def blob(question: Column, answer: Column) -> Column:
    return X.norm(F.concat(F.coalesce(question, F.lit("")), F.lit(" "), F.coalesce(answer, F.lit(""))))


def with_blob(questions: DataFrame) -> DataFrame:
    return questions.withColumn("blob", blob(F.col("question"), F.col("answer")))


def named(items: DataFrame) -> DataFrame:
    """Distinct concept names that count: normalised, at least three characters. (paper, name)"""
    return items.select("paper", X.norm(F.col("name")).alias("name")).where(F.length("name") >= 3).distinct()


def _named_in(names: DataFrame, questions: DataFrame) -> DataFrame:
    """(paper, name) of the names that some question blob of their paper contains."""
    return N.found(N.single(names), questions).select("paper", F.col("a").alias("name"))


def covered(names: DataFrame, questions: DataFrame) -> DataFrame:
    """Names that some question blob of their paper contains."""
    return names.join(_named_in(names, questions), ["paper", "name"], "left_semi")


def uncovered(names: DataFrame, questions: DataFrame) -> DataFrame:
    return names.join(_named_in(names, questions), ["paper", "name"], "left_anti")


def uncovered_examples(names: DataFrame, questions: DataFrame, most: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("paper").orderBy("name"))
    return uncovered(names, questions).withColumn("rank", rank).where(F.col("rank") <= most)


def gap_concepts(items: DataFrame, questions: DataFrame, most: int = 8) -> DataFrame:
    """Uncovered concepts by mentions (ties in first-seen order): (paper, name, mentions, rank). items: paper, name, mentions, ord."""
    own = items.select("paper", X.norm(F.col("name")).alias("name"), "mentions", "ord").where(F.length("name") >= 3)
    rank = F.row_number().over(Window.partitionBy("paper").orderBy(F.desc("mentions"), "ord"))
    return uncovered(own, questions).withColumn("rank", rank).where(F.col("rank") <= most)


def _hit(items: DataFrame, a: str, b: str, c: str | None, questions: DataFrame) -> DataFrame:
    """(paper, total, hit): how many different (a, b) a paper has, and how many of them one of its questions holds: a, and b or c."""
    key = [a] if a == b else [a, b]
    entries = items.select("paper", F.col(a).alias("a"), F.col(b).alias("b"), (F.lit(None).cast("string") if c is None else F.col(c)).alias("c")).where("a is not null and b is not null")
    hits = N.found(entries, questions).groupBy("paper").agg(F.count("*").alias("hit"))
    return items.groupBy("paper").agg(F.count_distinct(*key).alias("total")).join(hits, "paper", "left").select("paper", "total", F.coalesce("hit", F.lit(0)).alias("hit"))


def coverage(concepts: DataFrame, properties: DataFrame, relations: DataFrame, questions: DataFrame) -> DataFrame:
    """0.5 concept + 0.3 property + 0.2 relation ratio per paper with questions.

    A property is hit by one question naming its material and its property (or the property's first word), a
    relation by one question naming subject and object. Ratios have three decimals; an empty total counts as 1.
    """
    c = _hit(named(concepts), "name", "name", None, questions)
    p = properties.select("paper", X.norm(F.col("material")).alias("material"), X.norm(F.col("property")).alias("property")).distinct()
    p = p.withColumn("first", F.split_part(F.col("property"), F.lit(" "), F.lit(1)))
    p = _hit(p, "material", "property", "first", questions)
    r = relations.select("paper", X.norm(F.col("subject")).alias("subject"), X.norm(F.col("object")).alias("object")).distinct()
    r = _hit(r, "subject", "object", None, questions)
    out = questions.select("paper").distinct()
    for name, one in (("concept", c), ("property", p), ("relation", r)):
        out = out.join(one.select("paper", F.col("total").alias(f"{name}_total"), F.col("hit").alias(f"{name}_hit")), "paper", "left")
        total, hit = F.coalesce(f"{name}_total", F.lit(0)), F.coalesce(f"{name}_hit", F.lit(0))
        out = out.withColumn(f"{name}_total", total.cast("long")).withColumn(f"{name}_hit", hit.cast("long")).withColumn(f"{name}_ratio", V.ratio(F.col(f"{name}_hit"), F.col(f"{name}_total")))
    return out.withColumn("score", F.round(0.5 * F.col("concept_ratio") + 0.3 * F.col("property_ratio") + 0.2 * F.col("relation_ratio"), 3))


def faithfulness(best: DataFrame, ok: float = V.FAITHFUL_OK, good: float = V.FAITHFUL_GOOD) -> DataFrame:
    """Per paper from (paper, query, cosine): points, counts, and the least supported question."""
    c = F.round("cosine", 9)
    return best.groupBy("paper").agg(
        F.round(F.avg(V.faithful_points(c, ok, good)), 3).alias("score"),
        F.round(F.avg("cosine"), 3).alias("mean_cosine"),
        F.round(F.min("cosine"), 3).alias("min_cosine"),
        F.count_if(c >= good).alias("n_well"),
        F.count_if((c >= ok) & (c < good)).alias("n_weak"),
        F.count_if(c < ok).alias("n_off"),
        F.min_by("query", F.struct(c, "query")).alias("weakest"),
    )


def answer_verifiability(best: DataFrame) -> DataFrame:
    """Per paper from (paper, query, cosine) of the answers' best passages: mean and least cosine; a side signal, in no composite."""
    return best.groupBy("paper").agg(F.round(F.avg("cosine"), 3).alias("mean_cosine"), F.round(F.min("cosine"), 3).alias("min_cosine"))


def diversity(sums: DataFrame) -> DataFrame:
    """1 - mean pairwise cosine (not below 0), the largest cosine and near duplicates, from pair sums."""
    mean = F.col("cosine_sum") / F.col("pairs")
    return sums.select("paper", F.round(F.greatest(F.lit(0.0), 1 - mean), 3).alias("score"), F.round(mean, 3).alias("mean_pairwise"), F.round("cosine_max", 3).alias("max_pairwise"), F.col("near").alias("n_near_duplicates"))


def names_concept(questions: DataFrame, names: DataFrame, key: list[str]) -> DataFrame:
    """questions with `has_concept`: whether the blob contains some name of the paper."""
    hit = N.naming(N.single(names), questions, key).withColumn("has_concept", F.lit(True))
    return questions.join(hit, key, "left").withColumn("has_concept", F.coalesce("has_concept", F.lit(False)))


def triplifiability(flagged: DataFrame) -> DataFrame:
    """Per paper from questions with has_concept: 1 for phrase and concept, a half for one of them."""
    points = (X.has_triple_phrase(F.col("question")).cast("int") + F.col("has_concept").cast("int")) / 2
    return flagged.withColumn("points", points).groupBy("paper").agg(F.round(F.avg("points"), 3).alias("score"), F.round(F.avg((F.col("points") == 1).cast("int")), 3).alias("pct_full"), F.round(F.avg((F.col("points") == 0.5).cast("int")), 3).alias("pct_partial"))


def specificity(flagged: DataFrame) -> DataFrame:
    both = F.concat(F.coalesce("question", F.lit("")), F.lit(" "), F.coalesce("answer", F.lit("")))
    shares = flagged.groupBy("paper").agg(
        F.avg(F.length(F.coalesce("question", F.lit("")))).alias("chars"),
        F.avg(X.has_number(both).cast("int")).alias("num"),
        F.avg(X.has_unit(both).cast("int")).alias("unit"),
        F.avg(F.col("has_concept").cast("int")).alias("concept"),
    )
    length = F.greatest(F.lit(0.0), 1 - F.abs(F.col("chars") - 110) / 110)
    return shares.select("paper", F.round(0.5 * F.col("concept") + 0.2 * F.col("num") + 0.1 * F.col("unit") + 0.2 * length, 3).alias("score"), F.round("chars", 1).alias("avg_chars"), *[F.round(c, 3).alias(f"pct_{c}") for c in ("num", "unit", "concept")])


def composite(families: DataFrame) -> DataFrame:
    """Weighted mean over the families a paper has a score for; null if it has none. families: paper, family, score."""
    weight = F.create_map(*[F.lit(x) for kv in V.WEIGHTS.items() for x in kv])
    w = F.when(F.col("score").isNotNull(), F.element_at(weight, F.col("family")))
    return families.groupBy("paper").agg(F.round(F.sum(F.col("score") * w) / F.sum(w), 3).alias("overall"))
