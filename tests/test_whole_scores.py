"""Scores over all concepts and real texts, against brute force on a small table."""

import re

import pytest

from lectern.functions import text as X
from lectern.plans import QUERIES

BENCH = [(0, "of copper to"), (1, "graphene"), (3, "in of"), (4, "molybdenum steel")]
TURNS = [
    (0, "What is the yield of copper?", "At 25 °C, 3 nm thick."),
    (10, "Why so?", "No reason, but 40 times."),
    (20, "Which part is copper–bound?", "None"),
    (1, "How does it affect graphenes?", "By 5 µm."),
    (11, "What about graphite?", "It took two hours"),
    (2, "Is 25°C warm?", "Yes"),
    (3, "Is it in there?", "It is"),
    (4, "Is steel hard?", "Quite hard, 200 MPa"),
    (14, "Is it molybdenum?", "No"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("scores"))
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    rows = [(c, t, role, text) for c, q, a in TURNS for t, role, text in ((0, "user", q), (1, "assistant", a))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def papers():
    """(paper, [(question, both texts, names a concept)], has concepts)"""
    for p in sorted({c % 10 for c, _, _ in TURNS}):
        names = {w for i, t in BENCH if i % 10 == p for w in t.split() if len(w) >= 3}
        yield p, [(q, f"{q} {a}", any(n in f"{q} {a}".lower() for n in names)) for c, q, a in TURNS if c % 10 == p], bool(names)


def mean(values):
    values = [float(v) for v in values]
    return sum(values) / len(values)


def near(want):
    return {k: pytest.approx(v, abs=0.00051) for k, v in want.items()}


def test_specificity(spark, folder):
    want = {}
    for p, rows, _ in papers():
        chars, concept = mean(len(q) for q, _, _ in rows), mean(c for _, _, c in rows)
        num, unit = mean(bool(re.search(X.NUMERIC, b)) for _, b, _ in rows), mean(bool(re.search(X.UNIT, b, re.I)) for _, b, _ in rows)
        want[p] = (0.5 * concept + 0.2 * num + 0.1 * unit + 0.2 * max(0, 1 - abs(chars - 110) / 110), num, unit, concept)
    rows = QUERIES["specificity"](spark, folder).collect()
    assert {r.paper: (r.score, r.pct_num, r.pct_unit, r.pct_concept) for r in rows} == near(want)
    assert want[0][1] > 0 and want[0][2] > 0 and want[4][3] == 1
    assert all(r.avg_chars == pytest.approx(mean(len(q) for q, _, _ in dict((p, x) for p, x, _ in papers())[r.paper]), abs=0.051) for r in rows)


def test_concept_usage(spark, folder):
    want = {p: (sum(any_ and not c for _, _, c in rows), 1 - mean(any_ and not c for _, _, c in rows)) for p, rows, any_ in papers()}
    got = {r.paper: (r.issues, r.score) for r in QUERIES["concept_usage"](spark, folder).collect()}
    assert got == near(want)
    assert {p: n for p, (n, _) in want.items()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0}  # short names count; no concepts, no issue


def test_triplifiability(spark, folder):
    want = {}
    for p, rows, _ in papers():
        points = [(any(re.search(x, q, re.I) for x in X.TRIPLE_PHRASES) + c) / 2 for q, _, c in rows]
        want[p] = (mean(points), mean(x == 1 for x in points), mean(x == 0.5 for x in points))
    got = {r.paper: (r.score, r.pct_full, r.pct_partial) for r in QUERIES["triplifiability"](spark, folder).collect()}
    assert got == near(want)
    assert want[0][1] > 0
