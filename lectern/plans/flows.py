"""The flows: a paper to validated questions (A), and narrowing, validating and consolidating them across papers (B).

Each step is a function of DataFrames. Wherever the text model speaks, its prompts and replies are tables, so a run
can be replayed from kept replies. Branches are row-level filters: only questions that fail are refined, only papers with
gaps get a gap pass, only pairs with relevant evidence are judged.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, evaluation, narrowing, replies, state, validation
from ..operators import vectors as R
from ..session import keep
from ..sources.backends import ask
from ..sources.calls import Backend, Caller, Unreachable, caller, pooled
from ..sources.embedding import Embedder, Hashed, embedding

_RULE = "\n---\n"


def prompt(role: str, task: str, *parts: Column) -> Column:
    """Task first, then a rule, then the material."""
    return F.concat_ws("\n", F.lit(f"{task} Answer with one JSON object.{_RULE}"), *parts)


def metadata(papers: DataFrame, backend: Backend) -> DataFrame:
    """LLM-1: papers(paper_id, text) with metadata from the opening 5,000 characters (the feature's own limit)."""
    asked = papers.select(F.col("paper_id").alias("call_id"), F.lit("metadata").alias("role"), prompt("metadata", "Give title, first_author_lastname, year, journal, doi, paper_type and keywords.", F.substring("text", 1, 5000)).alias("prompt"))
    return papers.join(replies.metadata(ask(asked, backend)).withColumnRenamed("call_id", "paper_id"), "paper_id", "left")


def chunks_of(papers: DataFrame, embedder: Embedder = Hashed()) -> DataFrame:
    """paper, chunk_id, text with overlap, and a vector."""
    rows = chunking.overlap(chunking.chunk(papers, "paper_id", "text"), "paper_id")
    return rows.select(F.col("paper_id").alias("paper"), "chunk_id", "text", embedding(F.col("text"), embedder).alias("vec"))


_FIELDS = {"concepts": ["name"], "relations": ["subject", "predicate", "object"], "properties": ["material", "property_name", "numeric_value"], "findings": ["statement"]}


def _chunk_items(reply: str) -> list[dict]:
    """The items of one extraction reply, as rows the fold takes; ValueError if it is no JSON object."""
    got = json.loads(reply)
    if not isinstance(got, dict):
        raise ValueError("not a JSON object")
    rows = []
    for category in replies.CATEGORIES:
        for ord_, item in enumerate(x for x in got.get(category) or [] if isinstance(x, dict)):
            key = "|".join(" ".join(str(item.get(f) if item.get(f) is not None else ("none" if f == "numeric_value" else "")).lower().split()) for f in _FIELDS[category])
            rows.append({"category": category, "key": key, "confidence": item.get("confidence"), "sentence": item.get("evidence_sentence"), "ord": ord_, "aliases": item.get("aliases"), "context": item.get("evidence_context")})
    return rows


def _extract_paper(job: tuple[str, list[tuple[int, str]]], by: Caller, caps: dict[str, int]) -> list[tuple]:
    """State rows of one paper, chunk after chunk. A reply is in the log before the next chunk is asked about."""
    paper, chunks = job
    held: dict[str, dict] = {}
    failed = 0
    for number, body in chunks:
        seen = {c: list(v)[: state.KEEP.get(c, 20)] for c, v in held.items()}
        text = f"List concepts, relations, properties and findings. Known so far: {json.dumps(seen)} Answer with one JSON object.{_RULE}{body}"
        try:
            rows = _chunk_items(by.call("extract", text, scope=f"{paper}/{number}").reply)
            failed = 0
        except Unreachable:  # the server is gone: the run stops, instead of going on with empty states
            raise
        except Exception:
            failed += 1
            if failed == 3:
                break
            continue
        held = state.fold_chunks(held, rows, caps)
    return list(state.state_rows(paper, held))


def _papers(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[tuple[int, str]]]]:
    """(paper, [(chunk, text)]) from rows sorted by paper and chunk, a paper at a time."""
    rows = ((r.paper, r.chunk_id, r.text or "") for frame in frames for r in frame.itertuples(index=False))
    for paper, own in groupby(rows, lambda r: r[0]):
        yield paper, [(int(n), text) for _, n, text in own]


def extract(chunks: DataFrame, backend: Backend | Caller, caps: dict[str, int] | None = None) -> DataFrame:
    """ST-1 with LLM-2 inside: chunk by chunk, each prompt shows the compact state so far. A task has as many papers under way as its pool is wide.

    A chunk whose reply is unusable adds nothing; three in a row end the paper with what it has; an unreachable server ends the run.
    With a log (see `calls`) each reply is durable before the next chunk, and a retried task or a new run goes on where the last one ended.
    """
    caps, by = state.CAPS if caps is None else caps, caller(backend)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in pooled(_papers(frames), lambda job: _extract_paper(job, by, caps), by.width):
            yield pd.DataFrame(rows, columns=state.COLUMNS)

    dealt = chunks.select(F.col("paper").cast("string").alias("paper"), "chunk_id", "text").where("paper is not null").repartition("paper")
    return dealt.sortWithinPartitions("paper", "chunk_id").mapInPandas(run, state.STATE)


def retrieve(chunks: DataFrame, queries: DataFrame, k: int, embedder: Embedder = Hashed()) -> DataFrame:
    """TOP-1 / TOP-8 / TOP-9: (paper, query, rank, score, text) of the k best chunks for queries(paper, query_id, text)."""
    q = R.pack(queries.withColumn("vec", embedding(F.col("text"), embedder)), "paper", "query_id", "vec")
    p = R.pack(chunks, "paper", "chunk_id", "vec")
    best = R.top_k(q, p, "string", k)
    return best.join(chunks.select("paper", F.col("chunk_id").cast("long").alias("passage"), "text"), ["paper", "passage"])


def _hint(personas: DataFrame) -> Column:
    """What a persona looks for: its perspective and question style, else its code."""
    told = [F.col(c) for c in ("perspective", "question_style") if c in personas.columns]
    return F.concat_ws(" ", *told) if told else F.col("persona")


def persona_passages(chunks: DataFrame, papers: DataFrame, personas: DataFrame, k: int = 6, embedder: Embedder = Hashed()) -> DataFrame:
    """TOP-8: the k passages of each paper nearest to what each persona looks for: (paper, persona, query, rank, score, passage, text)."""
    hints = personas.select("persona", _hint(personas).alias("hint"))
    asked, _ = validation.each_persona(papers.select("paper").distinct(), personas)
    asked = asked.join(hints, "persona").withColumn("query_id", F.xxhash64("persona"))
    found = retrieve(chunks, asked.select("paper", "query_id", F.col("hint").alias("text")), k, embedder)
    return found.join(asked.select("paper", "persona", F.col("query_id").alias("query")), ["paper", "query"])


def generate(known: DataFrame, passages: DataFrame, personas: DataFrame, backend: Backend, most: int = 5, gaps: DataFrame | None = None, archetypes: DataFrame | None = None) -> DataFrame:
    """LLM-3 / LLM-4: questions of each paper and persona from its compact state and passages.

    passages: paper, query, rank, text, and persona where they differ by it. With gaps(paper, name, rank) only papers that have some are asked,
    one question a gap and two at most, and the prompt names the gaps. archetypes(persona, archetype, ord) are suggested to their persona.
    """
    role = "generate" if gaps is None else "gap"
    views = state.compact(known, budget=5500)
    by = ["paper", "persona"] if "persona" in passages.columns else ["paper"]
    shown = passages.groupBy(*by).agg(F.array_join(F.array_distinct(F.array_sort(F.collect_list(F.struct("query", "rank", "text")))["text"]), "\n\n").alias("evidence"))
    grid, _ = validation.each_persona(views, personas)
    if gaps is None:
        grid = grid.withColumn("wanted", F.lit("")).withColumn("n", F.lit(most))
    else:
        listed = F.array_join(F.array_sort(F.collect_list(F.struct("rank", "name")))["name"], ", ")
        missed = gaps.groupBy("paper").agg(F.concat(F.lit("No question touches these concepts yet, ask about them: "), listed).alias("wanted"), F.least(F.lit(2), F.count("*")).cast("int").alias("n"))
        grid = grid.join(missed, "paper")
    if archetypes is not None:
        liked = archetypes.groupBy("persona").agg(F.concat(F.lit("Archetypes: "), F.array_join(F.array_sort(F.collect_list(F.struct("ord", "archetype")))["archetype"], ", ")).alias("archetypes"))
        grid = grid.join(liked, "persona", "left")
    hint = F.coalesce("archetypes", F.lit("")) if archetypes is not None else F.lit("")
    task = F.concat(F.lit("Ask at most "), F.col("n").cast("string"), F.lit(f" competency questions with expected answers. Answer with one JSON object.{_RULE}"))
    text = F.concat_ws("\n", task, F.col("persona"), hint, F.col("wanted"), F.col("view"), F.coalesce("evidence", F.lit("")))
    asked = grid.join(shown, by, "left").select("paper", "persona", F.concat_ws("/", F.lit(role), "paper", "persona").alias("call_id"), F.lit(role).alias("role"), text.alias("prompt"))
    asked = keep(asked)
    rows = replies.questions(ask(asked.select("call_id", "role", "prompt"), backend)).drop("id").join(asked.select("call_id", "paper", "persona"), "call_id")
    mark = "_GAP" if role == "gap" else "_Q"
    return narrowing.assign_ids(rows, F.concat("paper", F.lit("_"), "persona", F.lit(mark)), ["paper", "persona"], ["ord"], "id")


def judge(questions: DataFrame, evidence: DataFrame, backend: Backend, budget: int = 25_000) -> DataFrame:
    """LLM-5: a verdict for every question, judged by paper and persona with evidence cut at a character budget."""
    cut = R.char_budget(evidence.withColumn("n", F.length("text").cast("long")), "paper", "ord", "n", budget)
    shown = cut.groupBy("paper").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "text")))["text"], "\n\n").alias("evidence"))
    block = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("[id:"), "id", F.lit("] "), "question"))), "\n")
    asked = questions.groupBy("paper", "persona").agg(block.alias("block")).join(shown, "paper", "left")
    asked = asked.select(F.concat_ws("/", F.lit("judge"), "paper", "persona").alias("call_id"), F.lit("judge").alias("role"), prompt("judge", "Score each question from 0 to 1 under 'verdicts'.", F.col("block"), F.coalesce("evidence", F.lit(""))).alias("prompt"))
    return validation.judge(questions, replies.verdicts(ask(asked, backend)))


def refine(judged: DataFrame, backend: Backend) -> DataFrame:
    """LLM-6 and JOIN-6: only failing questions are asked about; the answers overlay the originals."""
    failing = judged.where("refine")
    block = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("[id:"), "id", F.lit("] "), "question"))), "\n")
    asked = failing.groupBy("paper", "persona").agg(block.alias("block")).select(F.concat_ws("/", F.lit("refine"), "paper", "persona").alias("call_id"), F.lit("refine").alias("role"), prompt("refine", "Revise, keep or mark unrepairable each question.", F.col("block")).alias("prompt"))
    return validation.overlay(judged, replies.refinements(ask(asked, backend)), ["id"], ["question", "expected_answer", "source_section"])


def evaluate(questions: DataFrame, known: DataFrame, passages: DataFrame, embedder: Embedder = Hashed()) -> dict[str, DataFrame]:
    """The four families, the diagnostics and the composite of each paper's questions(paper, id, question, answer), without a model.

    known: the rolling state; passages(paper, passage, vec): what questions and answers are held against.
    """
    rows = keep(evaluation.with_blob(questions).withColumn("n", F.row_number().over(_by_paper()).cast("long")))
    part = lambda i: F.split_part("key", F.lit("|"), F.lit(i))
    concepts = known.where("category = 'concepts'").select("paper", F.col("key").alias("name"))
    properties = known.where("category = 'properties'").select("paper", part(1).alias("material"), part(2).alias("property"))
    relations = known.where("category = 'relations'").select("paper", part(1).alias("subject"), part(3).alias("object"))
    covered = keep(evaluation.coverage(concepts, properties, relations, rows))
    packed = keep(R.pack(passages, "paper", "passage", "vec"))

    def best(text: str) -> DataFrame:
        asked = R.pack(rows.select("paper", "n", embedding(F.col(text), embedder).alias("vec")), "paper", "n", "vec")
        return R.top_k(asked, packed, "string", 1).select("paper", "query", F.col("score").alias("cosine"))

    faithful = keep(evaluation.faithfulness(best("question")))
    flagged = keep(evaluation.names_concept(rows, evaluation.named(concepts), ["id"]))
    sums = keep(R.pair_sums(R.clustered(rows.select("paper", "n", embedding(F.col("question"), embedder).alias("vec")), "paper", "n", "vec"), "string"))
    diverse, triple = evaluation.diversity(sums), evaluation.triplifiability(flagged)
    families = None
    for name, one in (("coverage", covered), ("question_faithfulness", faithful), ("diversity", diverse), ("triplifiability", triple)):
        scores = one.select("paper", F.lit(name).alias("family"), "score")
        families = scores if families is None else families.unionByName(scores)
    return {
        "coverage": covered, "faithfulness": faithful, "diversity": diverse, "triplifiability": triple, "specificity": evaluation.specificity(flagged),
        "answer_verifiability": evaluation.answer_verifiability(best("answer")), "composite": evaluation.composite(families), "pair_sums": sums, "flagged": flagged,
    }


def rule_checks(questions: DataFrame, personas: DataFrame, known: DataFrame, scored: dict[str, DataFrame], each: int = 5) -> DataFrame:
    """Per paper the score of every rule check, the judge's mean and their mean, the quality score. questions carry the judge's `score`."""
    names = known.where("category = 'concepts'").select("paper", F.col("key").alias("name"))
    names = names.unionByName(known.where("category = 'properties'").select("paper", F.split_part("key", F.lit("|"), F.lit(1)).alias("name")))
    names = keep(evaluation.named(names))
    flagged = evaluation.names_concept(evaluation.with_blob(questions), names, ["id"])
    some = names.select("paper").distinct().withColumn("any", F.lit(True))
    flagged = flagged.join(some, "paper", "left").withColumn("any_concept", F.coalesce("any", F.lit(False)))
    parts = {
        "persona_coverage": validation.persona_coverage(questions, personas),
        "question_count": validation.question_count(questions, personas, each),
        "section_validity": validation.section_validity(questions.withColumn("section", F.col("source_section"))),
        "concept_usage": validation.concept_usage(flagged),
        "redundancy": validation.redundancy(scored["pair_sums"], questions.groupBy("paper").agg(F.count("*").alias("n"))),
        "judge": questions.groupBy("paper").agg(F.round(F.avg("score"), 3).alias("score")),
    }
    rows = None
    for name, one in parts.items():
        one = one.select("paper", F.lit(name).alias("component"), F.col("score").cast("double").alias("score"))
        rows = one if rows is None else rows.unionByName(one)
    rows = keep(rows)
    return rows.groupBy("paper").pivot("component", sorted(parts)).agg(F.first("score")).join(validation.mean_score(rows), "paper")


def evaluation_records(questions: DataFrame, scored: dict[str, DataFrame]) -> DataFrame:
    """(paper_id, evaluation): the nested record of each paper that the corpus report reads."""
    counts = questions.groupBy("paper").agg(F.count("*").alias("n_questions"))
    c, f, d, t, m = scored["coverage"], scored["faithfulness"], scored["diversity"], scored["triplifiability"], scored["composite"]
    ratio = lambda kind: F.struct(F.col(f"{kind}_total").alias("total"), F.col(f"{kind}_hit").alias("referenced"), F.col(f"{kind}_ratio").alias("ratio"))
    c = c.select("paper", F.struct("score", ratio("concept").alias("concepts"), ratio("property").alias("properties"), ratio("relation").alias("relations")).alias("coverage"))
    f = f.select("paper", F.struct("score", "mean_cosine", "min_cosine", F.col("n_well").alias("n_well_faithful"), "n_weak", F.col("n_off").alias("n_off_paper")).alias("question_faithfulness"))
    d = d.select("paper", F.struct("score", F.col("mean_pairwise").alias("mean_pairwise_cos"), F.col("max_pairwise").alias("max_pairwise_cos"), "n_near_duplicates").alias("diversity"))
    t = t.select("paper", F.struct("score", F.col("pct_full").alias("pct_full_triples"), "pct_partial").alias("triplifiability"))
    rows = counts.join(m, "paper", "left")
    for one in (c, f, d, t):
        rows = rows.join(one, "paper", "left")
    families = F.struct("coverage", "question_faithfulness", "diversity", "triplifiability").alias("families")
    return rows.select(F.col("paper").alias("paper_id"), F.struct("n_questions", F.col("overall").alias("overall_score"), families).alias("evaluation"))


def phase_a(papers: DataFrame, personas: DataFrame, backend: Backend, gap_concepts: int = 8, archetypes: DataFrame | None = None, embedder: Embedder = Hashed()) -> dict[str, DataFrame]:
    """A paper table to questions, verdicts, scores and evaluation records; every stage's table is returned, and how long each took."""
    took, began = [], time.time()

    def done(name: str, df: DataFrame) -> DataFrame:
        nonlocal began
        out = keep(df)
        took.append((name, time.time() - began))
        began = time.time()
        return out

    chunks = done("chunks", chunks_of(papers, embedder))
    known = done("extract", extract(chunks, backend))
    concepts = state.top_concepts(known, 20)
    found = retrieve(chunks, concepts.select("paper", F.col("rank").cast("long").alias("query_id"), F.col("key").alias("text")), 2, embedder)
    found = done("retrieve", found)
    biased = done("persona_passages", persona_passages(chunks, papers.select(F.col("paper_id").alias("paper")), personas, embedder=embedder))
    first = done("generate", generate(known, biased, personas, backend, archetypes=archetypes))
    asked = evaluation.with_blob(first.withColumn("answer", F.col("expected_answer")))
    gaps = done("gaps", evaluation.gap_concepts(known.where("category = 'concepts'").select("paper", F.col("key").alias("name"), "mentions", "ord"), asked, gap_concepts))
    near_gaps = done("gap_passages", retrieve(chunks, gaps.select("paper", F.col("rank").cast("long").alias("query_id"), F.col("name").alias("text")), 2, embedder))
    extra = generate(known, near_gaps, personas, backend, gaps=gaps)
    questions = done("gap_questions", first.unionByName(extra))
    # concepts first, then personas, then gaps; a passage counts where it comes first
    order = F.struct(F.col("turn"), F.col("query")).alias("query")
    every = found.withColumn("turn", F.lit(0)).unionByName(biased.drop("persona").withColumn("turn", F.lit(1))).unionByName(near_gaps.withColumn("turn", F.lit(2)))
    passages = done("passages", R.union_evidence(every.select("paper", "passage", order, "rank", "score")).join(chunks.select("paper", F.col("chunk_id").cast("long").alias("passage"), "text", "vec"), ["paper", "passage"]))
    judged = done("judge", judge(questions, passages, backend))
    final = done("refine", refine(judged, backend))
    answered = final.withColumn("answer", F.col("expected_answer"))
    scored = evaluate(answered, known, passages, embedder)
    quality = done("rule_checks", rule_checks(answered, personas, known, scored))
    records = done("evaluation", evaluation_records(final, scored))
    tables = {k: v for k, v in scored.items() if k not in ("pair_sums", "flagged")}
    timings = papers.sparkSession.createDataFrame(took, "stage string, seconds double")
    return {"chunks": chunks, "state": known, "passages": passages, "questions": final, "gaps": gaps, "quality": quality, "evaluation": records, "timings": timings} | tables


def _by_paper():
    from pyspark.sql import Window

    return Window.partitionBy("paper").orderBy("id")


def _listed(rows: DataFrame, by: str, role: str, task: str) -> DataFrame:
    block = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("[id:"), "id", F.lit("] "), "question"))), "\n")
    return rows.groupBy(by).agg(block.alias("block")).select(F.concat_ws("/", F.lit(role), by).alias("call_id"), F.lit(role).alias("role"), prompt(role, task, F.col("block")).alias("prompt"))


def dedup(questions: DataFrame, backend: Backend) -> dict[str, DataFrame]:
    """LLM-7: duplicates inside a paper, never across archetypes; ids, provenance, flags and statistics."""
    questions = keep(questions)
    rep, gone = replies.dedup_groups(ask(_listed(questions, "paper", "dedup", "Group duplicates under 'duplicate_groups'."), backend), questions)
    rep = narrowing.assign_ids(rep, F.concat("paper", F.lit("_DEDUP_")), ["paper"], ["id"]).withColumn("flags", X.vague_flags(F.col("expected_answer")))
    rep = keep(rep)
    gone = narrowing.absorbed_into(gone, rep.select(F.col("id").alias("source_id"), "new_id"))
    return {"representatives": rep, "discarded": gone, "in_out": narrowing.in_out(questions, rep, "archetype"), "invariant": narrowing.partition_audit(questions, rep, gone)}


def generalise(questions: DataFrame, backend: Backend) -> dict[str, DataFrame]:
    """LLM-8: groups across papers inside an archetype."""
    groups = replies.general_groups(ask(_listed(questions, "archetype", "generalise", "Group questions that generalise to one under 'groups'."), backend), questions)
    named = keep(groups.join(questions.select(F.col("id").alias("member"), "archetype", "paper", F.col("bloom_level").alias("bloom")), "member"))
    one = named.groupBy("group").agg(F.min("archetype").alias("archetype"), F.min("gen_question").alias("gen_question"))
    one = keep(narrowing.assign_ids(one, F.concat(F.lit("GEN_"), "archetype", F.lit("_")), ["archetype"], ["group"], "group_id"))
    members = named.join(one.select("group", "group_id"), "group").select("group_id", F.col("member").alias("id"), "ord")
    facts = narrowing.gather_members(members, named.select(F.col("member").alias("id"), "paper", "bloom"))
    return {"groups": one.join(facts, "group_id"), "members": members, "reverse_index": narrowing.reverse_index(members)}


def validate(groups: DataFrame, members: DataFrame, questions: DataFrame, chunks: DataFrame, backend: Backend, k: int = 5, embedder: Embedder = Hashed()) -> dict[str, DataFrame]:
    """LLM-9 behind FLT-8: (group, member) pairs with relevant evidence are judged; the others are NOT_FOUND or INDEX_MISSING."""
    pairs = members.join(groups.select("group_id", "gen_question"), "group_id").join(questions.select("id", "paper", "expected_answer"), "id")
    pairs = keep(pairs.withColumn("query_id", F.xxhash64("group_id", "id")))
    found = retrieve(chunks, pairs.select("paper", "query_id", F.col("gen_question").alias("text")), k, embedder)
    best = found.groupBy("paper", F.col("query").alias("query_id")).agg(F.max("score").alias("best"), F.array_join(F.array_sort(F.collect_list(F.struct("rank", "text")))["text"], "\n\n").alias("evidence"))
    rows = keep(pairs.join(best, ["paper", "query_id"], "left"))
    relevant = rows.where("best >= 0.40").select(F.col("query_id").cast("string").alias("call_id"), F.lit("fidelity").alias("role"), prompt("fidelity", "Answer from the evidence, compare with the expected answer.", F.col("gen_question"), F.col("expected_answer"), F.col("evidence")).alias("prompt"))
    said = replies.fidelity(ask(relevant, backend)).withColumn("query_id", F.col("call_id").cast("long")).drop("call_id")
    verdict = F.when(F.col("best").isNull(), "INDEX_MISSING").when(F.col("best") < 0.40, "NOT_FOUND").otherwise(F.coalesce("verdict", F.lit("FAIL")))
    per_paper = rows.drop("evidence").join(said, "query_id", "left").withColumn("verdict", verdict).withColumn("score", F.coalesce("score", F.lit(0.0)))
    return {"per_paper": per_paper, "groups": narrowing.group_verdicts(per_paper)}


def consolidate(groups: DataFrame, members: DataFrame, originals: DataFrame, backend: Backend, constrained: bool = True) -> dict[str, DataFrame]:
    """LLM-10 per archetype, LLM-11 over the results; fallbacks, orphans, id expansion, repaired fields and audit. No question of a group gets lost by a reply."""
    rows = groups.select(F.col("group_id").alias("id"), "archetype", F.col("gen_question").alias("question"))
    rows = keep(rows)
    stage_a = replies.consolidated(ask(_listed(rows, "archetype", "consolidate_a", "Merge questions with one triple signature under 'consolidated_cqs'.").withColumn("schema", F.lit(replies.CONSOLIDATION_SCHEMA if constrained else None).cast("string")), backend))
    # a question that its archetype's reply does not account for stays unmerged
    accounted = stage_a.select(F.explode("merged_from").alias("id")).distinct()
    unmerged = rows.withColumn("call_id", F.concat_ws("/", F.lit("consolidate_a"), "archetype")).join(accounted, "id", "left_anti")
    unmerged = unmerged.select("call_id", F.col("id").alias("cq_id"), F.col("question").alias("competency_question"), F.array("id").alias("merged_from"), F.concat_ws("/", "call_id", "id").alias("out_id"))
    stage_a = keep(stage_a.unionByName(unmerged, allowMissingColumns=True))
    a_members = stage_a.select(F.col("out_id").alias("ref"), F.explode("merged_from").alias("id"))
    whole = stage_a.select(F.lit("all").alias("part"), F.col("out_id").alias("id"), F.col("competency_question").alias("question"))
    stage_b = replies.consolidated(ask(_listed(whole, "part", "consolidate_b", "Merge across archetypes under 'consolidated_cqs'.").withColumn("schema", F.lit(replies.CONSOLIDATION_SCHEMA if constrained else None).cast("string")), backend))
    refs = stage_b.select("out_id", F.explode("merged_from").alias("ref"))
    fallback = keep(narrowing.orphans(stage_a.select(F.col("out_id").alias("ref")), refs))  # first-stage questions the second stage forgot stay as they are
    refs = refs.unionByName(fallback.select("out_id", "ref"))
    out = keep(narrowing.expand_ids(refs, a_members).select("out_id", "id").distinct())
    facts = narrowing.repaired_fields(out.join(members.select(F.col("group_id").alias("id"), F.col("id").alias("source")), "id").select("out_id", F.col("source").alias("id")), originals)
    kept = fallback.join(stage_a.withColumnRenamed("out_id", "ref"), "ref")
    fields = ["out_id", "competency_question", "triple_pattern", "variables", "sparql_sketch"]
    final = stage_b.select(*fields).unionByName(kept.select(*fields)).withColumn("variables", F.coalesce("variables", X.variables(F.col("sparql_sketch")))).drop("sparql_sketch")
    final = final.join(facts, "out_id", "left")
    return {"consolidated": final, "sources": out, "audit": narrowing.audit(rows, out), "repeated": narrowing.repeated_texts(final, X.norm(F.col("competency_question")))}


def figure_captions(images: DataFrame, backend: Backend) -> DataFrame:
    """LLM-12: captions of images(call_id, encoded)."""
    return ask(images.select("call_id", F.lit("caption").alias("role"), prompt("caption", "Caption the figure.", F.col("encoded")).alias("prompt")), backend)
