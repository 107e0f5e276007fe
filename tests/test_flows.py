"""Sources, sinks, replies and the flows end to end with the offline backend."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import replies, state, validation
from lectern.plans import flows
from lectern.plans.text_queries import personas
from lectern.sources import files, index, sinks
from lectern.sources.backends import HeuristicBackend, ReplayBackend, ask
from lectern.sources.calls import Unreachable


@pytest.fixture(scope="module")
def papers(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet").where("doc_id < 2").select(F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("paper_id"), "text")


@pytest.fixture(scope="module")
def phase_a(spark, papers):
    out = flows.phase_a(papers, personas(spark).limit(2), HeuristicBackend())
    return {k: v.cache() for k, v in out.items()}


def test_phase_a(phase_a):
    q = phase_a["questions"]
    assert q.count() == q.select("id").distinct().count() > 0
    assert {r.verdict for r in q.select("verdict").collect()} <= {"pass", "borderline", "fail"}
    assert phase_a["diversity"].count() == phase_a["specificity"].count() == 2


def test_phase_a_evaluates(spark, phase_a, tmp_path):
    """Families, composite and rule checks of every paper, and records that the corpus report reads."""
    quality = {r.paper: r for r in phase_a["quality"].collect()}
    for r in quality.values():
        parts = [r.concept_usage, r.judge, r.persona_coverage, r.question_count, r.redundancy, r.section_validity]
        assert r.quality == pytest.approx(round(sum(parts) / 6, 3), abs=1e-3)
    phase_a["evaluation"].repartition(2, "paper_id").write.option("maxRecordsPerFile", 1).json(str(tmp_path / "eval"))
    read = {r.paper_id: r for r in files.evaluations(spark, str(tmp_path / "eval/*.json")).collect()}
    whole = {r.paper: r.overall for r in phase_a["composite"].collect()}
    assert read.keys() == whole.keys() == quality.keys() and len(read) == 2
    for paper, r in read.items():
        weighted = 0.38 * r.coverage + 0.44 * r.faithfulness + 0.12 * r.diversity + 0.06 * r.triplifiability
        assert r.overall == pytest.approx(weighted, abs=2e-3) and whole[paper] == r.overall
    assert {r.stage for r in phase_a["timings"].collect()} >= {"extract", "generate", "judge", "evaluation"}
    assert phase_a["answer_verifiability"].count() == 2


def test_gap_pass(spark, phase_a):
    """Gap questions only for papers with gaps; the prompts name the gaps and carry the passages near them."""
    paper = phase_a["gaps"].first()
    known, passages = phase_a["state"], phase_a["passages"].withColumn("query", F.lit(1).cast("long"))
    one = phase_a["gaps"].limit(0).unionByName(spark.createDataFrame([(phase_a["state"].first().paper, "missing thing", 3, 1)], "paper string, name string, mentions long, rank int"), allowMissingColumns=True)
    rows = flows.generate(known, passages, personas(spark).limit(2), Echo(), gaps=one).collect()
    assert rows and {r.paper for r in rows} == {phase_a["state"].first().paper} and all("_GAP" in r.id for r in rows)
    assert all("missing thing" in r.question and "Ask at most 1 " in r.question for r in rows)
    assert paper is None or paper.rank >= 1


def test_persona_passages(spark, phase_a):
    who = spark.createDataFrame([("A", "apples", "and pears"), ("B", "zebra", "")], "persona string, perspective string, question_style string")
    rows = flows.persona_passages(phase_a["chunks"], phase_a["chunks"].select("paper"), who, k=2).collect()
    assert {(r.paper, r.persona) for r in rows} == {(p.paper, c) for p in phase_a["chunks"].select("paper").distinct().collect() for c in "AB"}
    assert max(r["rank"] for r in rows) <= 2


class Echo:
    """Says the prompt back as a question."""

    def reply(self, role, prompt, schema=None):
        return json.dumps({"questions": [{"question": prompt, "expected_answer": "a", "archetype": "X", "source_section": "Body"}]})


class Forgetful(HeuristicBackend):
    """A second stage that mentions only one of its inputs, and a first stage that fails for one archetype."""

    def reply(self, role, prompt, schema=None):
        if role == "consolidate_a" and "fails here" in prompt:
            return "no json"
        said = json.loads(super().reply(role, prompt, schema))
        if role == "consolidate_b":
            said["consolidated_cqs"] = said["consolidated_cqs"][:1]
        return json.dumps(said)


def test_consolidation_keeps_orphans(spark):
    """Questions that the second stage forgets, and those of an unusable first-stage reply, stay in the output."""
    groups = spark.createDataFrame([("g1", "X", "q1"), ("g2", "X", "q2"), ("g3", "Y", "fails here"), ("g4", "Z", "q4")], "group_id string, archetype string, gen_question string")
    members = spark.createDataFrame([(f"g{i}", f"m{i}", 0) for i in range(1, 5)], "group_id string, id string, ord int")
    originals = spark.createDataFrame([(f"m{i}", f"p{i}", "X") for i in range(1, 5)], "id string, paper string, archetype string")
    final = flows.consolidate(groups, members, originals, Forgetful())
    rows = {r.out_id: r for r in final["consolidated"].collect()}
    assert len(rows) == 4 and sum(i.startswith("FB_") for i in rows) == 3
    assert sorted(p for r in rows.values() for p in r.papers_covered) == ["p1", "p2", "p3", "p4"]
    assert "fails here" in {r.competency_question for r in rows.values()}
    assert final["audit"].count() == 0


def test_unreachable_server_stops_extraction(spark):
    from pyspark.errors import PythonException

    import tests.test_flows as own

    with pytest.raises(PythonException):
        flows.extract(spark.createDataFrame([("p", 0, "t")], "paper string, chunk_id int, text string"), own.Down()).collect()


def test_persona_archetypes(spark):
    known = spark.createDataFrame([(f"A{i}", i) for i in range(6)], "archetype string, ord int")
    liked = spark.createDataFrame([("P", "A5"), ("P", "A1"), ("P", "gone"), ("Q", "_note"), ("R", "gone")], "persona string, archetype string")
    got = {}
    for r in validation.persona_archetypes(spark.createDataFrame([("P",), ("Q",), ("R",), ("S",)], "persona string"), liked, known).orderBy("ord").collect():
        got.setdefault(r.persona, []).append(r.archetype)
    first = ["A0", "A1", "A2", "A3"]
    assert got == {"P": ["A1", "A5"], "Q": first, "R": first, "S": first}
    assert validation.persona_archetypes(spark.createDataFrame([("P",)], "persona string"), liked, known.limit(0)).count() == 0


def test_aliases_and_contexts(spark):
    rows = [("p", 0, "concepts", "k", "low", "S1", 0, ["One", "ONE ", None], "c1"), ("p", 1, "concepts", "k", "high", "S2", 0, ["two", "one"], "c2"), ("p", 2, "concepts", "k", None, "S1", 0, None, "c3")]
    got = state.fold(spark.createDataFrame(rows, "paper string, chunk_id int, category string, key string, confidence string, sentence string, ord int, aliases array<string>, context string")).first()
    assert (got.mentions, got.confidence, got.evidence, got.contexts, got.aliases) == (3, "high", ["S1", "S2"], ["c1", "c2"], ["One", "two"])


def test_narrowing(phase_a):
    q = phase_a["questions"].withColumn("bloom_level", F.lit("analysis"))
    first = flows.dedup(q, HeuristicBackend())
    assert first["invariant"].first().accounted
    rep = first["representatives"].cache()
    groups = flows.generalise(rep, HeuristicBackend())
    assert groups["members"].count() == rep.count()
    checked = flows.validate(groups["groups"], groups["members"], rep, phase_a["chunks"], HeuristicBackend())
    assert checked["per_paper"].count() == rep.count()
    final = flows.consolidate(groups["groups"], groups["members"], rep, HeuristicBackend())
    assert final["audit"].count() == 0
    assert final["consolidated"].count() > 0


def frame(spark, *texts):
    return spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "call_id string, reply string")


def test_dedup_repairs(spark):
    inputs = spark.createDataFrame([("a", "X", "q"), ("b", "X", "q"), ("c", "Y", "q"), ("d", "X", "q")], "id string, archetype string, question string")
    said = json.dumps({"duplicate_groups": [{"keep_id": "a", "discard_ids": ["b", "c", "ghost", "a"]}, {"keep_id": "d", "discard_ids": ["a"]}], "singletons": []})
    kept, gone = replies.dedup_groups(frame(spark, said), inputs)
    assert {r.id for r in gone.collect()} == {"b"}  # c: other archetype; ghost: unknown; a: itself a keeper
    assert {r.id for r in kept.collect()} == {"a", "c", "d"}


@pytest.mark.parametrize("said", ["", "no json at all", '{"groups": [', None])
def test_unusable_replies_fall_back(spark, said):
    inputs = spark.createDataFrame([("a", "X", "q1"), ("b", "X", "q2")], "id string, archetype string, question string")
    kept, gone = replies.dedup_groups(frame(spark, said), inputs)
    assert (kept.count(), gone.count()) == (2, 0)
    assert replies.general_groups(frame(spark, said), inputs).count() == 2
    assert replies.questions(frame(spark, said)).first().archetype == "PARSE_ERROR"


def test_verdict_edges(spark):
    said = json.dumps({"verdicts": [{"question_id": "a", "score": 7}, {"question_id": "a", "score": 0.1}, {"score": 1}]})
    rows = replies.verdicts(frame(spark, said)).collect()
    assert [(r.id, r.score) for r in rows] == [("a", 1.0)]


def test_fidelity_contradiction(spark):
    row = replies.fidelity(frame(spark, json.dumps({"fidelity_score": 0.9, "verdict": "fail"}))).first()
    assert (row.verdict, row.consistent) == ("FAIL", False)


def test_consolidated_needs_sources(spark):
    said = json.dumps({"consolidated_cqs": [{"cq_id": "1", "competency_question": "q", "merged_from": []}, {"cq_id": "2", "competency_question": "q", "merged_from": ["x"]}]})
    assert [r.cq_id for r in replies.consolidated(frame(spark, said)).collect()] == ["2"]


def test_replay_and_quarantine(spark):
    prompts = spark.createDataFrame([("1", "judge", "known"), ("2", "judge", "unknown")], "call_id string, role string, prompt string")
    got = {r.call_id: (r.reply, r.error) for r in ask(prompts, ReplayBackend({ReplayBackend.key("known"): "yes"})).collect()}
    assert got["1"] == ("yes", None)
    assert got["2"][0] is None and "KeyError" in got["2"][1]


class Down:
    def reply(self, role, prompt, schema=None):
        raise Unreachable("down")


def test_unreachable_server_stops(spark):
    prompts = spark.createDataFrame([("1", "judge", "x")], "call_id string, role string, prompt string")
    from pyspark.errors import PythonException

    import tests.test_flows as own  # by reference, so that workers import the class

    with pytest.raises(PythonException):
        ask(prompts, own.Down()).collect()


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/B.TXT").write_text("## Head\nTable 1 and Table 2, TABLE IV.")
    (tmp_path / "in/a.md").write_text("é")
    (tmp_path / "in/.hidden.txt").write_text("no")
    (tmp_path / "in/c.csv").write_text("no")
    listed = files.list_inputs(spark, str(tmp_path / "in"))
    assert [r.name for r in listed.collect()] == ["B.TXT", "a.md"]
    texts = files.read_texts(spark, str(tmp_path / "in"))
    stats = {r.path.rsplit("/", 1)[1]: r for r in files.paper_stats(texts.where("error is null")).collect()}
    assert (stats["B.TXT"].n_sections, stats["B.TXT"].n_tables) == (1, 2)  # arabic numerals match as an empty roman one
    assert files.target_paper(listed.withColumn("paper_id", F.lit("x")), "b").count() == 1


def test_json_scan_skips_corrupt(spark, tmp_path):
    good = {"paper_id": "p", "evaluation": {"n_questions": 3, "overall_score": 0.5, "families": {"coverage": {"score": None}}}}
    (tmp_path / "a_eval.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b_eval.json").write_text('{"paper_id": ')
    rows = files.evaluations(spark, str(tmp_path / "*_eval.json")).collect()
    assert [(r.paper_id, r.n_questions, r.coverage) for r in rows] == [("p", 3, None)]


def test_sinks(spark, tmp_path):
    df = spark.range(3).withColumn("archetype", F.lit("A"))
    path = str(tmp_path / "t")
    assert sinks.write_once(df, path) and not sinks.write_once(df, path) and sinks.write_once(df.limit(1), path, overwrite=True)
    assert sinks.append_new(df, path, ["id"]) == 2
    assert spark.read.parquet(path).count() == 3


def test_index_reuse(spark, tmp_path):
    chunks = spark.createDataFrame([("p", 0, "t", [1.0]), ("q", 0, "u", [0.5])], "paper_id string, chunk_id int, text string, vec array<float>")
    sinks.save_index(chunks, str(tmp_path / "i"), "m")
    stored = index.read(spark, str(tmp_path / "i"))
    changed = chunks.withColumn("text", F.when(F.col("paper_id") == "q", "new").otherwise(F.col("text")))
    assert [r.paper_id for r in sinks.reusable_papers(changed, str(tmp_path / "i"), "m").collect()] == ["p"]
    assert sinks.reusable_papers(chunks, str(tmp_path / "i"), "other").count() == 0
    assert files.load_index(spark, str(tmp_path / "i"), "p", "other").first().stale
    cache = stored.select("text_hash", "model_name")
    assert [r.text for r in sinks.missing_embeddings(changed, cache, "m").collect()] == ["new"]


def test_rich_text(spark):
    rows = [("d", 0, i, t, s, b) for i, (t, s, b) in enumerate([("Title", 14.0, False), ("body", 10.0, False), ("more", 10.0, False), ("Bold", 11.0, True), ("big", 11.0, False)])]
    got = files.rich_text(spark.createDataFrame(rows, "doc string, page int, ord int, text string, size double, bold boolean")).first().markdown
    assert got == "## Title\nbody\nmore\n## Bold\nbig"


def test_cli_schema(capsys):
    from lectern.__main__ import main

    assert main(["consolidate", "out", "--dump-schema"]) == 0
    assert json.loads(capsys.readouterr().out)["required"] == ["consolidated_cqs"]
