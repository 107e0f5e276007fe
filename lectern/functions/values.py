"""Numbers, decision tables, arrays and JSON replies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds, ranks and weights that decide results.
PASS, BORDERLINE = 0.75, 0.40
FAITHFUL_OK, FAITHFUL_GOOD, DUPLICATE = 0.55, 0.70, 0.92
WEIGHTS = {"coverage": 0.38, "question_faithfulness": 0.44, "diversity": 0.12, "triplifiability": 0.06}
BLOOM = ["knowledge", "comprehension", "application", "analysis", "synthesis", "evaluation"]
# End of fixed values.


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def verdict(score: Column, passing: float = PASS) -> Column:
    return F.when(score >= passing, "pass").when(score >= BORDERLINE, "borderline").otherwise("fail")


def faithful_points(cosine: Column, ok: float = FAITHFUL_OK, good: float = FAITHFUL_GOOD) -> Column:
    return F.when(cosine >= good, 1.0).when(cosine >= ok, 0.5).otherwise(0.0)


def breadth(papers: Column) -> Column:
    return F.when(papers <= 2, "narrow").when(papers <= 6, "medium").otherwise("broad")


def confidence_rank(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low == "high", 3).when(low == "medium", 2).otherwise(1)


def bloom_rank(c: Column) -> Column:
    """1 (lowest level) to 6; 0 for unknown names."""
    return F.coalesce(F.array_position(F.array(*[F.lit(b) for b in BLOOM]), F.lower(c)), F.lit(0)).cast("int")


def group_verdict(passed: Column, partial: Column, failed: Column, absent: Column) -> Column:
    """Verdict of a group from its members' counts; absent: not found or index missing."""
    judged = passed + partial + failed
    rate = passed / judged
    return (
        F.when(judged + absent == 0, "NO_DATA")
        .when(judged == 0, "NOT_FOUND")
        .when(rate >= PASS, "PASS")
        .when(rate >= BORDERLINE, "PARTIAL")
        .otherwise("FAIL")
    )


def quality_flag(overall: Column, papers: Column, absent: Column, mean: Column) -> Column:
    """Ordered rules; whatever no rule catches is STRONG."""
    return (
        F.when((overall == "NOT_FOUND") | ((absent > 0) & (overall != "PASS")), "OVER_GENERALISED")
        .when((overall == "PASS") & (papers == 1), "PAPER_SPECIFIC")
        .when((overall == "PASS") & (mean >= PASS), "STRONG")
        .when(overall.isin("PARTIAL", "FAIL") & (mean < BORDERLINE), "UNDER_ANSWERED")
        .when(overall == "PARTIAL", "PARTIAL")
        .otherwise("STRONG")
    )


def ratio(hit: Column, total: Column) -> Column:
    """Three decimals; an empty total counts as fully covered."""
    return F.when(total == 0, 1.0).otherwise(F.round(hit / total, 3))


def json_object(reply: Column) -> Column:
    """The outermost {...} of a model reply, whatever surrounds it (fences, prose); null if there is none."""
    found = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def json_rows(reply: Column, keys: list[str], row_type: str) -> Column:
    """array<row_type> from the first key that holds a list, else from a bare top-level list; null if unreadable."""
    text = json_object(reply)
    listed = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\[.*\])", 1)
    tries = [F.from_json(F.get_json_object(text, f"$.{k}"), f"array<{row_type}>") for k in keys]
    return F.coalesce(*tries, F.from_json(F.when(listed != "", listed), f"array<{row_type}>"))


def first_by_key(items: Column, key) -> Column:
    """Elements whose key has not occurred before, in order."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def merge_aliases(existing: Column, incoming: Column, key) -> Column:
    return first_by_key(F.concat(F.coalesce(existing, F.array()), F.coalesce(incoming, F.array())), key)


def merge_evidence(existing: Column, incoming: Column, most: int = 3) -> Column:
    """Append evidence with a new trimmed sentence; keep the first three."""
    both = F.concat(F.coalesce(existing, F.array()), F.coalesce(incoming, F.array()))
    return F.slice(first_by_key(both, lambda e: F.trim(e["evidence_sentence"])), 1, most)
