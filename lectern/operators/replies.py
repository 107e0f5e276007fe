"""Model replies to typed rows: tolerant parsing, repairs and safe fallbacks, as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from .narrowing import only_known, singletons_for_rest
from .validation import clean_hints, clean_question

QUESTION = "struct<id:string,question:string,expected_answer:string,archetype:string,source_section:string,bloom_level:string,ontology_hints:array<struct<role:string,term:string>>>"
VERDICT = "struct<question_id:string,score:double,reasons:array<string>>"
REFINED = "struct<id:string,question:string,expected_answer:string,source_section:string,archetype:string,refiner_action:string,revise_reason:string>"
GROUP = "struct<keep_id:string,keep_reason:string,discard_ids:array<string>,merge_reasoning:string>"
GENERAL = "struct<gen_question:string,abstraction_reasoning:string,member_ids:array<string>>"
TRIPLE = "struct<subject:string,predicate:string,object:string>"
CONSOLIDATED = f"struct<cq_id:string,competency_question:string,variables:array<string>,triple_pattern:array<{TRIPLE}>,sparql_sketch:string,source_archetypes:array<string>,merged_from:array<string>,consolidation_reasoning:string>"
ITEM = "struct<name:string,category:string,aliases:array<string>,subject:string,predicate:string,object:string,material:string,property_name:string,numeric_value:string,unit:string,method:string,statement:string,evidence_sentence:string,evidence_context:string,confidence:string>"
METADATA = "struct<title:string,first_author_lastname:string,year:string,journal:string,doi:string,paper_type:string,keywords:array<string>>"
CATEGORIES = ("concepts", "relations", "properties", "findings")

# Fixed value: JSON schema of a consolidation reply, as given to schema-constrained decoding.
CONSOLIDATION_SCHEMA = (
    '{"type":"object","required":["consolidated_cqs"],"properties":{"consolidated_cqs":{"type":"array","minItems":1,"items":{"type":"object",'
    '"required":["cq_id","competency_question","merged_from"],"properties":{"cq_id":{"type":"string"},"competency_question":{"type":"string","minLength":1},'
    '"variables":{"type":"array","items":{"type":"string"}},"triple_pattern":{"type":"array","items":{"type":"object","required":["subject","predicate","object"]}},'
    '"sparql_sketch":{"type":"string"},"source_archetypes":{"type":"array","items":{"type":"string"}},"merged_from":{"type":"array","minItems":1,"items":{"type":"string"}},'
    '"coverage_breadth":{"enum":["narrow","medium","broad"]}}}}}}'
)


def metadata(replies: DataFrame) -> DataFrame:
    """(call_id, metadata): null fields where the reply is unusable."""
    return replies.select("call_id", F.from_json(V.json_object(F.col("reply")), METADATA).alias("metadata"))


def items(replies: DataFrame) -> DataFrame:
    """(call_id, category, ord, item) of the four lists of an extraction reply."""
    parts = None
    for category in CATEGORIES:
        one = replies.select("call_id", F.lit(category).alias("category"), F.posexplode(V.json_rows(F.col("reply"), [category], ITEM)).alias("ord", "item"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def questions(replies: DataFrame) -> DataFrame:
    """(call_id, ord, cleaned fields); an unusable reply gives one PARSE_ERROR placeholder."""
    rows = replies.select("call_id", V.json_rows(F.col("reply"), ["questions", "cqs", "competency_questions"], QUESTION).alias("rows"))
    stand_in = F.from_json(F.lit('[{"question":"","expected_answer":"","archetype":"PARSE_ERROR","source_section":"Body"}]'), f"array<{QUESTION}>")
    rows = rows.select("call_id", F.posexplode(F.when(F.size(F.coalesce("rows", F.array().cast(f"array<{QUESTION}>"))) > 0, F.col("rows")).otherwise(stand_in)).alias("ord", "q")).select("call_id", "ord", "q.*")
    return rows.withColumn("question", clean_question("question", "question")).withColumn("expected_answer", clean_question("expected_answer", "answer")).withColumn("source_section", clean_question("source_section", "section")).withColumn("ontology_hints", clean_hints(F.col("ontology_hints")))


def verdicts(replies: DataFrame) -> DataFrame:
    """(id, score clamped to 0..1, reasons), one a question; the first answer counts."""
    rows = replies.select("call_id", F.posexplode(V.json_rows(F.col("reply"), ["verdicts", "results", "scores"], VERDICT)).alias("ord", "v")).select("call_id", "ord", "v.*")
    rows = rows.where("question_id is not null")
    first = F.min_by(F.struct(V.clamp(F.col("score")).alias("score"), "reasons"), F.struct("call_id", "ord"))
    return rows.groupBy(F.col("question_id").alias("id")).agg(first.alias("v")).select("id", "v.*")


def refinements(replies: DataFrame) -> DataFrame:
    """(id, action, fields); actions other than revise, keep and unrepairable count as keep."""
    rows = replies.select(F.explode(V.json_rows(F.col("reply"), ["questions", "refined", "cqs"], REFINED)).alias("r")).select("r.*")
    action = F.when(F.col("refiner_action").isin("revise", "keep", "unrepairable"), F.col("refiner_action")).otherwise("keep")
    return rows.where("id is not null").withColumn("action", action).drop("refiner_action").dropDuplicates(["id"])


def dedup_groups(replies: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives, discarded): every input id in exactly one of them.

    A discard needs a known keeper of the same archetype and an id that is not kept; everything else is kept, and
    ids the reply forgot are kept too. inputs: id, archetype.
    """
    groups = replies.select(F.explode(V.json_rows(F.col("reply"), ["duplicate_groups"], GROUP)).alias("g")).select("g.*")
    pairs = groups.select(F.col("keep_id"), F.explode("discard_ids").alias("id"), F.col("merge_reasoning")).where("keep_id <> id")
    known = inputs.select("id", "archetype")
    keeper = known.select(F.col("id").alias("keep_id"), F.col("archetype").alias("keep_archetype"))
    pairs = pairs.join(known, "id").join(keeper, "keep_id").where("archetype = keep_archetype")
    pairs = pairs.join(groups.select(F.col("keep_id").alias("id")).distinct(), "id", "left_anti")
    discarded = pairs.groupBy("id").agg(F.min("keep_id").alias("keep_id"), F.min("merge_reasoning").alias("merge_reasoning"))
    return singletons_for_rest(inputs, discarded), discarded


def general_groups(replies: DataFrame, inputs: DataFrame) -> DataFrame:
    """(group, gen_question, member, ord): known members only, each in one group, the forgotten as groups of their own."""
    rows = None
    for key in ("groups", "singletons"):
        one = replies.select("call_id", F.lit(key).alias("kind"), F.posexplode(V.json_rows(F.col("reply"), [key], GENERAL)).alias("at", "g"))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.select(F.concat_ws("/", "call_id", "kind", F.col("at").cast("string")).alias("group"), "g.gen_question", F.posexplode("g.member_ids").alias("ord", "member"))
    rows = only_known(rows, inputs)
    once = rows.groupBy("member").agg(F.min_by(F.struct("group", "gen_question", "ord"), F.struct("group", "ord")).alias("x")).select("member", "x.*")
    rest = singletons_for_rest(inputs, once.select(F.col("member").alias("id")))
    return once.unionByName(rest.select(F.col("id").alias("member"), F.concat(F.lit("rest/"), "id").alias("group"), F.col("question").alias("gen_question"), F.lit(0).alias("ord")))


def fidelity(replies: DataFrame) -> DataFrame:
    """(call_id, answer, score, verdict, consistent): the reply's own verdict, and whether its score agrees."""
    r = F.from_json(V.json_object(F.col("reply")), "generated_answer string, fidelity_score double, verdict string, fidelity_reasoning string")
    rows = replies.select("call_id", r.alias("r")).select("call_id", F.col("r.generated_answer").alias("answer"), V.clamp(F.coalesce("r.fidelity_score", F.lit(0.0))).alias("score"), F.upper("r.verdict").alias("said"))
    by_score = F.when(F.col("score") >= V.PASS, "PASS").when(F.col("score") >= V.BORDERLINE, "PARTIAL").otherwise("FAIL")
    verdict = F.when(F.col("said").isin("PASS", "PARTIAL", "FAIL"), F.col("said")).otherwise(by_score)
    return rows.select("call_id", "answer", "score", verdict.alias("verdict"), (verdict == by_score).alias("consistent"))


def consolidated(replies: DataFrame) -> DataFrame:
    """(call_id, out_id, fields) rows that satisfy the schema: an id, a question, at least one source."""
    rows = replies.select("call_id", F.explode(V.json_rows(F.col("reply"), ["consolidated_cqs"], CONSOLIDATED)).alias("c")).select("call_id", "c.*")
    return rows.where("cq_id is not null and trim(competency_question) <> '' and size(merged_from) > 0").withColumn("out_id", F.concat_ws("/", "call_id", "cq_id"))
