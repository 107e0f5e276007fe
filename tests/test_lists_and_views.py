"""Segmented lists, budgets, walks, tallies, excerpts, aliases through the stream, and the command line's configuration."""

import argparse
import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import lists, narrowing, state
from lectern.operators import vectors as R
from lectern.plans import flows
from lectern.sources import files, sinks
from lectern.sources.backends import HeuristicBackend
from lectern.streaming.rolling import run_available


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_segments(spark, size):
    """One group holds most rows; no row holds more than a segment, and the readers give every item its place."""
    rows = [("a", i, f"v{i}") for i in range(100)] + [("b", 1, None), (None, 2, "x"), (None, 1, "y")]
    segments = lists.segmented(spark.createDataFrame(rows, "g string, o int, v string").repartition(5), ["g"], ["o"], "v", size).cache()
    assert max(len(r.items_) for r in segments.withColumnRenamed("items", "items_").collect()) <= size
    got = {(r.g, r.ord): r.item for r in lists.members(segments, size).collect()}
    assert got == {("a", i + 1): f"v{i}" for i in range(100)} | {("b", 1): None, (None, 1): "y", (None, 2): "x"}
    assert {(r.g, r.item) for r in lists.item_at(segments, F.lit(2), size).collect()} == {("a", "v1"), (None, "x")}
    assert lists.segmented(spark.createDataFrame([], "g string, o int, v string"), ["g"], ["o"], "v").count() == 0


def test_merged_signatures_in_segments(spark):
    rows = [(i, "s", "p", "o") for i in range(25)] + [(30, "s", "p", "q"), (31, "s", "p", "o"), (31, "s", "p", "o")]
    got = narrowing.merge_signatures(spark.createDataFrame(rows, "id int, subject string, predicate string, object string"), size=10).collect()
    assert sorted((r.group_id, r.segment, r.merged_from) for r in got) == [(0, 0, list(range(10))), (0, 1, list(range(10, 20))), (0, 2, [20, 21, 22, 23, 24, 31]), (30, 0, [30])]


def budget(lengths, most, headers):
    total, out = 0, []
    for i, n in enumerate(lengths):
        block = (n or 0) + (len(f"--- passage {i + 1} ---\n") if headers else 0)
        if total + block + 2 > most and out:
            break
        total += block + 2
        out.append(i)
    return out


@pytest.mark.parametrize("headers", [False, True])
@pytest.mark.parametrize("most", [1, 30, 700, 2500, 10_000])
def test_budget(spark, headers, most):
    papers = {"a": [5] * 130, "b": [9000, 1], "c": [0] * 40, "d": [None, 3, 400, 2], "e": [30]}
    rows = [(p, i, n) for p, ns in papers.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "paper string, o int, n long").repartition(7)
    got = {}
    for r in R.char_budget(df, "paper", "o", "n", most, headers=headers).orderBy("o").collect():
        got.setdefault(r.paper, []).append(r.o)
        assert r.ord == r.o + 1
    assert got == {p: budget(ns, most, headers) for p, ns in papers.items()}
    assert R.char_budget(df.limit(0), "paper", "o", "n", most).count() == 0


def test_walk(spark):
    ranked = spark.createDataFrame([(p, q, 100 * q + r, r) for p, n in ((1, 2), (2, 1)) for q in range(n) for r in range(1, 21)], "paper int, query int, passage int, rank int")
    got = R.walk_evidence(ranked, 6).collect()
    assert sorted((r.paper, r.ord, r.passage) for r in got) == [(1, i, i) for i in range(1, 13)] + [(2, i, i) for i in range(1, 7)]


def test_tallies(spark):
    rows = [("p", a) for a in ("revise", "keep", "keep", "unrepairable", None, "else")] + [("q", None)]
    got = {r.paper: tuple(r)[1:] for r in narrowing.refine_tallies(spark.createDataFrame(rows, "paper string, action string")).collect()}
    assert got == {"p": (1, 2, 1, 2), "q": (0, 0, 0, 1)}


def test_excerpts(spark):
    row = spark.createDataFrame([("x" * 6000,), (None,)], "t string").select(*[F.length(X.excerpt(F.col("t"), v)).alias(v) for v in X.EXCERPTS]).collect()
    assert [tuple(r) for r in row] == [(200, 300, 200, 5000), (0, 0, 0, 0)]


ITEMS = [
    ("p", 0, "concepts", "k", "low", "S1", 0, ["One", "ONE ", None], "c1"), ("p", 1, "concepts", "k", "high", "S2", 1, ["two", "one"], "c2"), ("p", 2, "concepts", "k", None, "S1", 2, None, "c3"),
    ("p", 2, "concepts", "l", None, " ", 3, [""], "c4"),
]


def test_aliases_and_contexts_everywhere(spark):
    """The aggregation, the fold and the stream keep the same aliases and contexts."""
    items = spark.createDataFrame(ITEMS, "paper string, chunk_id int, category string, key string, confidence string, sentence string, ord int, aliases array<string>, context string")
    pick = lambda df: sorted((r.key, r.mentions, r.confidence, r.evidence, r.aliases, r.contexts) for r in df.collect())
    want = [("k", 3, "high", ["S1", "S2"], ["One", "two"], ["c1", "c2"]), ("l", 1, "medium", [], [], [])]
    assert pick(state.merge_items(items)) == pick(state.fold(items)) == want
    assert pick(run_available(items, {"concepts": 25}, ("key", "mentions", "confidence", "evidence", "aliases", "contexts"))) == want


def test_archetype_folders_hold_statistics(spark, tmp_path):
    questions = spark.createDataFrame([("g1", "A", "q"), ("g2", "B", "q")], "group_id string, archetype string, gen_question string")
    reverse = spark.createDataFrame([("m1", "g1"), ("m2", "g2"), ("m3", "g2")], "id string, group_id string")
    stats = narrowing.in_out(spark.createDataFrame([("A",), ("B",), ("B",), ("C",)], "archetype string"), questions, "archetype")
    sinks.split_by_archetype(questions, reverse, str(tmp_path), stats)
    got = {r.archetype: (r.n_in, r.n_out, r.reduction) for r in spark.read.json(str(tmp_path / "stats")).collect()}
    assert got == {"A": (1, 1, 0.0), "B": (2, 1, 0.5)}
    assert spark.read.parquet(str(tmp_path / "reverse_index/archetype=B")).count() == 2


class Partly(HeuristicBackend):
    """A first-stage reply with usable rows that forgets a group."""

    def reply(self, role, prompt, schema=None):
        said = json.loads(super().reply(role, prompt, schema))
        if role == "consolidate_a":
            said["consolidated_cqs"] = said["consolidated_cqs"][:1]
        return json.dumps(said)


def test_no_group_is_lost_by_a_partly_usable_reply(spark):
    import tests.test_lists_and_views as own

    groups = spark.createDataFrame([(f"g{i}", "X", f"q{i}") for i in range(4)], "group_id string, archetype string, gen_question string")
    members = spark.createDataFrame([(f"g{i}", f"m{i}", 0) for i in range(4)], "group_id string, id string, ord int")
    originals = spark.createDataFrame([(f"m{i}", f"p{i}", "X") for i in range(4)], "id string, paper string, archetype string")
    final = flows.consolidate(groups, members, originals, own.Partly())
    assert final["audit"].count() == 0
    assert sorted(p for r in final["consolidated"].collect() for p in r.papers_covered) == ["p0", "p1", "p2", "p3"]


def test_configuration_files_reach_the_prompts(spark, tmp_path):
    from lectern.__main__ import _who

    (tmp_path / "personas.json").write_text(json.dumps({"_note": "n", "personas": [{"code": "A", "perspective": "bench work", "question_style": "short"}, {"code": "B"}]}))
    (tmp_path / "archetypes.json").write_text(json.dumps({"archetypes": [{"id": x} for x in "VWXYZ"], "persona_archetype_affinity": {"_note": "n", "A": ["Z", "V", "none"]}}))
    who, liked = _who(spark, argparse.Namespace(personas=str(tmp_path / "personas.json"), archetypes=str(tmp_path / "archetypes.json")))
    assert [tuple(r) for r in who.orderBy("persona").collect()] == [("A", "bench work", "short"), ("B", "", "")]
    got = {}
    for r in liked.orderBy("ord").collect():
        got.setdefault(r.persona, []).append(r.archetype)
    assert got == {"A": ["V", "Z"], "B": ["V", "W", "X", "Y"]}
    assert _who(spark, argparse.Namespace(personas=None, archetypes=None))[1] is None
    assert files.persona_table(spark, "{}").count() == 0


def test_items_without_a_paper(spark):
    items = spark.createDataFrame([(None, 0, "concepts", "k", None, None, 0), (None, 1, "concepts", None, "high", "s", 1), ("p", 0, "concepts", " | ", "high", "s", 0)], "paper string, chunk_id int, category string, key string, confidence string, sentence string, ord int")
    for df in (state.merge_items(items), state.fold(items), run_available(items, {"concepts": 2}, ("paper", "key", "mentions", "confidence", "evidence"))):
        assert [(r.paper, r.key, r.mentions, r.confidence, r.evidence) for r in df.collect()] == [(None, "k", 1, "medium", [])]
    assert state.fold(items.limit(0)).count() == state.merge_items(items.limit(0)).count() == 0
