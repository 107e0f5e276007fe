"""Names in texts against brute force, with hot papers and groups of a few rows; no nested loop in any plan of the family."""

import random
import time

import pytest

from lectern.operators import evaluation as E
from lectern.operators import names as N
from lectern.plans import QUERIES


def tables(spark, papers=9, texts=240, names=60, seed=1):
    """One paper holds a third of all texts and names."""
    rng = random.Random(seed)
    paper = lambda: 0 if rng.random() < 1 / 3 else rng.randrange(1, papers)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 5)))
    t = [(paper(), i, "".join(rng.choice("abc ") for _ in range(rng.randrange(30)))) for i in range(texts)] + [(None, -1, "abc"), (1, -2, None), (99, -3, "abc")]
    e = [(paper(), word(), word(), rng.choice([None, word()])) for _ in range(names)] + [(2, "", "", None), (3, None, "a", "b"), (None, "a", "a", None), (98, "a", "a", None), (4, "a", None, None)] * 2
    return spark.createDataFrame(e, "paper long, a string, b string, c string").repartition(4), spark.createDataFrame(t, "paper long, key long, blob string").repartition(4), e, t


def holds(text, a, b, c):
    return a is not None and a in text and any(x is not None and x in text for x in (b, c))


@pytest.mark.parametrize("sizes", [(40, 3), (1 << 22, 20_000)])
def test_against_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(N, "SLICE", sizes[0])
    monkeypatch.setattr(N, "CHUNK", sizes[1])
    entries, texts, e, t = tables(spark)
    got = sorted(map(str, (tuple(r) for r in N.found(entries, texts).collect())))
    assert got == sorted({str(x) for x in e if any(p == x[0] and p is not None and s is not None and holds(s, *x[1:]) for p, _, s in t)})
    keys = sorted(r.key for r in N.naming(entries, texts, ["key"]).collect())
    assert keys == sorted(k for p, k, s in t if s is not None and any(x[0] == p and p is not None and holds(s, *x[1:]) for x in e))
    assert N.found(entries.limit(0), texts).count() == N.naming(entries, texts.limit(0), ["key"]).count() == 0


def test_hot_paper_is_many_groups(spark, monkeypatch):
    """A paper with most rows is dealt to groups of bounded size."""
    monkeypatch.setattr(N, "SLICE", 2000)
    texts = spark.range(3000).selectExpr("1L as paper", "id as key", "concat('text of ', cast(id as string)) as blob")
    names = spark.range(500).selectExpr("1L as paper", "cast(id as string) as a", "cast(id as string) as b", "cast(null as string) as c")
    _, right = N._groups(names, texts)
    sizes = [r["count"] for r in right.count().collect()]
    assert len(sizes) > 30 and max(sizes) < 4 * 3000 / len(sizes)
    assert N.found(names, texts).count() == 500


def test_work_grows_with_the_texts():
    """Ten times the names and texts cost about ten times as much, not a hundred."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=9))

    def seconds(n):
        finder = N.Finder([(w, w, None) for w in (word() for _ in range(n))])
        texts = [" ".join(word() for _ in range(12)) for _ in range(n)]
        began = time.perf_counter()
        for text in texts:
            finder.hits(text, finder.by_a)
        return time.perf_counter() - began

    seconds(200)
    assert seconds(20_000) < 40 * max(seconds(2000), 1e-3)


@pytest.mark.parametrize("name", ["coverage_ratio", "uncovered_examples", "gap_topk", "triplifiability", "specificity", "concept_usage"])
def test_plans_have_no_nested_loop(spark, tiny, name):
    plan = QUERIES[name](spark, tiny)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Contains(" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_coverage_edges(spark):
    """Null and empty parts, and a property hit by its first word."""
    questions = spark.createDataFrame([("p", "steel has yield strength"), ("q", "nothing")], "paper string, blob string")
    concepts = spark.createDataFrame([("p", "Steel"), ("p", "of"), ("p", None), ("q", "gold")], "paper string, name string")
    properties = spark.createDataFrame([("p", "steel", "yield point"), ("p", "steel", None), ("q", "gold", "price")], "paper string, material string, property string")
    relations = spark.createDataFrame([("p", "steel", "strength"), ("p", "steel", "gold")], "paper string, subject string, object string")
    got = {r.paper: (r.concept_total, r.concept_hit, r.property_total, r.property_hit, r.relation_total, r.relation_hit, r.score) for r in E.coverage(concepts, properties, relations, questions).collect()}
    assert got == {"p": (1, 1, 2, 2, 2, 1, 0.9), "q": (1, 0, 1, 0, 0, 0, 0.2)}
