"""Queries over documents, conversations and pages: text operators and question checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import chunking
from ..operators import validation as C
from ..session import table
from .registry import query

NB = "chr(160)"


def _text(name: str = "text") -> str:
    return f"replace(coalesce({name}, ''), {NB}, ' ')"


def _norm(name: str) -> str:
    return rf"trim(regexp_replace(lower({_text(name)}), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, CAST(length({_norm('text')}) AS BIGINT) AS n_chars, md5({_norm('text')}) AS digest FROM documents")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1 over whole texts."""
    n = X.norm(X.plain_spaces(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(n).cast("long").alias("n_chars"), F.md5(n).alias("digest"))


_STRIP = rf"""regexp_replace(array_to_string(list_filter(string_split(regexp_replace(regexp_replace({_text()}, '[ \t]+', ' ', 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), chr(10)), lambda x: NOT regexp_full_match(x, '\s*[0-9]{{1,4}}\s*')), chr(10)), '^\s+|\s+$', '', 'g')"""


@query(f"SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, {_STRIP} AS t FROM documents)")
def strip_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-2."""
    t = X.strip_boilerplate(X.plain_spaces(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@query(
    """SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS char_count, CAST(length(coalesce(text, '')) // 4 AS BIGINT) AS estimated_tokens,
    CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: starts_with(x, '## '))) AS BIGINT) AS n_sections, substr(text, 1, 200) AS excerpt FROM documents"""
)
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-4 and the truncation view PRJ-5."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce(t, F.lit(""))).cast("long").alias("char_count"), X.estimated_tokens(t).alias("estimated_tokens"), X.section_count(t).alias("n_sections"), F.substring(t, 1, 200).alias("excerpt"))


_MD5 = ", ".join(f"md5(substr(coalesce(text, ''), 1, {n})) AS {view}" for view, n in X.EXCERPTS.items())


@query(f"SELECT doc_id, {_MD5} FROM documents")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-5: all four truncation views of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", *[F.md5(X.excerpt(F.col("text"), view)).alias(view) for view in X.EXCERPTS])


_HEDGE = "CASE " + " ".join(f"WHEN contains(lower(text), '{p}') THEN '{p}'" for p in X.HEDGES) + " END"


@query(
    rf"""SELECT conv_id, turn, len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '')) < 8 AS too_short, {_HEDGE} AS hedge
    FROM conversations WHERE role = 'assistant'"""
)
def vague_answer_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-4 on answers."""
    answers = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return answers.select("conv_id", "turn", X.too_short(F.col("text")).alias("too_short"), X.hedge_phrase(F.col("text")).alias("hedge"))


# Word boundaries differ between engines next to letters outside ASCII. The SQL reads such characters as an ASCII letter, so
# it equals these three queries only on texts where that finds the same; the queries read the text itself.
_ASCII = r"regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'x', 'g')"


@query(rf"SELECT doc_id, regexp_matches({_ASCII}, '{X.NUMERIC}') AS has_number, regexp_matches({_ASCII}, '(?i){X.UNIT}') AS has_unit FROM documents")
def numeric_unit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-4."""
    return table(spark, sf_dir, "documents").select("doc_id", X.has_number(F.col("text")).alias("has_number"), X.has_unit(F.col("text")).alias("has_unit"))


_TRIPLE = " OR ".join(f"regexp_matches({_ASCII}, '(?i){p}')" for p in X.TRIPLE_PHRASES)


@query(f"SELECT conv_id, turn, ({_TRIPLE}) AS has_phrase FROM conversations")
def triple_phrase_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-5."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.has_triple_phrase(F.col("text")).alias("has_phrase"))


@query(r"SELECT page_id, CAST(len(v) AS BIGINT) AS n, array_to_string(v, ',') AS names FROM (SELECT page_id, regexp_extract_all(url, '\?([a-zA-Z]\w*)', 1) AS v FROM pages)")
def var_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-6 on addresses, which hold ?names."""
    v = X.variables(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(v).cast("long").alias("n"), F.array_join(v, ",").alias("names"))


@query(rf"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(replace({_ASCII}, 'The ', 'Table '), '{X.TABLE_LABEL}', 1))) AS BIGINT) AS n_tables FROM documents")
def table_label_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-24 / STR-7; 'The ' stands in for 'Table ', which the synthetic prose lacks."""
    return table(spark, sf_dir, "documents").select("doc_id", X.table_labels(F.replace("text", F.lit("The "), F.lit("Table "))).alias("n_tables"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-3 then WIN-3: chunks of every document with overlap (recursion is beyond SQL; tested by properties)."""
    chunks = chunking.chunk(table(spark, sf_dir, "documents"), "doc_id", "text")
    rows = chunking.overlap(chunks, "doc_id")
    return rows.select("doc_id", "chunk_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(
    """WITH p AS (SELECT doc_id, i, substr(text, 1 + 3500 * i, 3500) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 3499) // 3500))) AS i FROM documents))
    SELECT doc_id, CAST(i AS BIGINT) AS chunk_id, md5(coalesce(right(lag(piece) OVER (PARTITION BY doc_id ORDER BY i), 200), '') || piece) AS digest FROM p"""
)
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-3 on fixed-width pieces."""
    last = F.greatest(F.lit(0), F.ceil(F.length("text") / 3500) - 1)
    pieces = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_id"))
    pieces = pieces.select("doc_id", "chunk_id", F.substring("text", F.lit(1) + 3500 * F.col("chunk_id").cast("int"), F.lit(3500)).alias("chunk"))
    return chunking.overlap(pieces, "doc_id").select("doc_id", "chunk_id", F.md5("text").alias("digest"))


@query("SELECT md5(text) AS digest, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def exact_text_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-5: first occurrence of repeated texts; partial aggregation keeps a huge group of copies to a row a task."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


@query(f"WITH t AS (SELECT {_norm('text')} AS text FROM documents UNION ALL SELECT {_norm('text')} FROM conversations WHERE role = 'user') SELECT text, count(*) AS n FROM t GROUP BY 1 HAVING count(*) > 1")
def duplicate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23: normalised texts asked more than once, of questions and documents (only documents repeat in the synthetic tables)."""
    from ..operators.narrowing import repeated_texts

    asked = table(spark, sf_dir, "conversations").where(F.col("role") == "user").select("text")
    return repeated_texts(table(spark, sf_dir, "documents").select("text").unionByName(asked), X.norm(X.plain_spaces(F.col("text"))))


_QA = """SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer, lead(turn) OVER w AS answer_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""


@query(f"SELECT conv_id, turn, answer_turn, length(text) AS question_chars, length(answer) AS answer_chars FROM ({_QA}) WHERE role = 'user' AND next_role = 'assistant'")
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer of neighbouring turns (shape of D15)."""
    return qa(spark, sf_dir).select("conv_id", "turn", "answer_turn", F.length("question").cast("long").alias("question_chars"), F.length("answer").cast("long").alias("answer_chars"))


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("*", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"), F.lead("turn").over(w).alias("answer_turn"))
    return rows.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).withColumnRenamed("text", "question")


PERSONAS = ["SYNTH", "CHAR", "PROC", "THEO", "STU", "PHD", "ONTO"]


def personas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PERSONAS], "persona string")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions: paper = conversation mod 10, persona by turn, a section that may be a placeholder."""
    rows = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    code = F.element_at(F.array(*[F.lit(p) for p in PERSONAS]), (F.pmod(F.col("turn") + F.col("conv_id"), F.lit(7)) + 1).cast("int"))
    section = F.when(F.length("text") % 5 == 0, F.lit(" Unknown ")).otherwise("Body")
    return rows.select((F.col("conv_id") % 10).alias("paper"), "conv_id", "turn", code.alias("persona"), section.alias("section"), F.col("text").alias("question"))


_ASKED = "SELECT conv_id % 10 AS paper, conv_id, turn, list_extract(['SYNTH','CHAR','PROC','THEO','STU','PHD','ONTO'], CAST((turn + conv_id) % 7 + 1 AS INTEGER)) AS persona, CASE WHEN length(text) % 5 = 0 THEN ' Unknown ' ELSE 'Body' END AS section, text AS question FROM conversations WHERE role = 'user'"
_PERSONAS = "SELECT unnest(['SYNTH','CHAR','PROC','THEO','STU','PHD','ONTO']) AS persona"


@query(
    f"""WITH q AS ({_ASKED}), p AS ({_PERSONAS}), g AS (SELECT paper, persona FROM (SELECT DISTINCT paper FROM q), p),
    s AS (SELECT g.paper, g.persona, count(q.turn) AS n FROM g LEFT JOIN q ON q.paper = g.paper AND q.persona = g.persona GROUP BY ALL)
    SELECT paper, CAST(sum(greatest(0, 5 - n)) AS BIGINT) AS shortfall, round(greatest(0.0, 1 - sum(greatest(0, 5 - n)) / 35.0), 3) AS score FROM s GROUP BY paper"""
)
def question_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11."""
    return C.question_count(asked(spark, sf_dir), personas(spark))


@query(
    f"""WITH q AS ({_ASKED}), h AS (SELECT paper, count(DISTINCT persona) AS present FROM q GROUP BY paper)
    SELECT paper, present, 7 - present AS missing, CASE WHEN present < 7 THEN round(present / 7.0, 3) ELSE 1.0 END AS score FROM h"""
)
def persona_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10."""
    return C.persona_coverage(asked(spark, sf_dir), personas(spark))


@query(f"WITH q AS ({_ASKED}) SELECT paper, CAST(count(*) FILTER (WHERE lower(trim(section)) IN ('', 'unknown', '...', 'n/a', 'none')) AS BIGINT) AS issues, round(1 - count(*) FILTER (WHERE lower(trim(section)) = 'unknown') / count(*), 3) AS score FROM q GROUP BY paper")
def section_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-3 and AGG-12."""
    return C.section_validity(asked(spark, sf_dir))


@query(
    """WITH s AS (SELECT d.doc_id, CAST(CASE WHEN l.quality IS NULL THEN 0.5 ELSE 0.35 + 0.45 * l.quality - 0.15 * l.toxic END AS DOUBLE) AS score, l.quality IS NULL AS defaulted FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT doc_id, round(score, 6) AS score, defaulted, CASE WHEN score >= 0.75 THEN 'pass' WHEN score >= 0.4 THEN 'borderline' ELSE 'fail' END AS verdict, score < 0.75 AS refine FROM s"""
)
def judged_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-7 and AGG-15: replies by id, default 0.5 borderline where none came."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    replies = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (0.35 + 0.45 * F.col("quality") - 0.15 * F.col("toxic")).alias("score"))
    return C.judge(docs, replies).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "defaulted", "verdict", "refine")


@query(
    """SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'revised ' || d.source ELSE d.source END AS section, CASE WHEN l.quality = 1 THEN 'revise' WHEN l.toxic = 1 THEN 'unrepairable' ELSE 'keep' END AS action,
    coalesce(l.quality <> 1 AND l.toxic = 1, false) AS unrepairable FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def left_join_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-6: refined rows over originals."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("section"))
    action = F.when(F.col("quality") == 1, "revise").when(F.col("toxic") == 1, "unrepairable").otherwise("what?")
    refined = table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", action.alias("action"), F.concat(F.lit("revised "), F.col("section")).alias("section"))
    return C.overlay(docs, refined, ["doc_id"], ["section"])


@query(
    """WITH c AS (SELECT conv_id, turn, CASE (turn + length(text)) % 4 WHEN 0 THEN '...' WHEN 1 THEN '<your question text here>' WHEN 2 THEN '' ELSE text END AS q, CASE length(text) % 3 WHEN 0 THEN '<section>' WHEN 1 THEN '...' ELSE 'Methods' END AS s FROM conversations)
    SELECT conv_id, turn, CASE WHEN q IN ('...', '<your question text here>') THEN '' ELSE trim(q, ' ') END AS question, CASE WHEN s = 'Methods' THEN s ELSE 'Body' END AS section FROM c"""
)
def placeholder_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-7 on placeholders mixed into turns."""
    n = F.length("text")
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when((F.col("turn") + n) % 4 == 0, "...").when((F.col("turn") + n) % 4 == 1, "<your question text here>").when((F.col("turn") + n) % 4 == 2, "").otherwise(F.col("text")).alias("q"),
        F.when(n % 3 == 0, "<section>").when(n % 3 == 1, "...").otherwise("Methods").alias("s"),
    )
    return rows.select("conv_id", "turn", C.clean_question("q", "question").alias("question"), C.clean_question("s", "section").alias("section"))


@query(
    """WITH h AS (SELECT c_custkey, unnest([c_custkey, c_custkey + 1, c_custkey + 2]) AS i, c_mktsegment FROM customer),
    c AS (SELECT c_custkey, i, CASE i % 5 WHEN 0 THEN '...' WHEN 1 THEN '<domain term>' WHEN 2 THEN ' ' WHEN 3 THEN '<term>' ELSE c_mktsegment END AS term, CASE i % 4 WHEN 0 THEN ' Class' WHEN 1 THEN 'verb' WHEN 2 THEN 'PROPERTY' END AS role FROM h),
    k AS (SELECT * FROM c WHERE i % 5 = 4 AND i % 4 IN (0, 2))
    SELECT c.c_custkey, coalesce((SELECT string_agg(term || ':' || role, ',' ORDER BY i) FROM k WHERE k.c_custkey = c.c_custkey), '') AS hints FROM customer c"""
)
def hint_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-7 on hints: placeholders, blanks, unknown and missing roles go."""
    term = lambda i: F.when(i % 5 == 0, "...").when(i % 5 == 1, "<domain term>").when(i % 5 == 2, " ").when(i % 5 == 3, "<term>").otherwise(F.col("c_mktsegment"))
    role = lambda i: F.when(i % 4 == 0, " Class").when(i % 4 == 1, "verb").when(i % 4 == 2, "PROPERTY")
    given = F.transform(F.sequence(F.col("c_custkey"), F.col("c_custkey") + 2), lambda i: F.struct(term(i).alias("term"), role(i).alias("role")))
    kept = F.transform(C.clean_hints(given), lambda h: F.concat(h["term"], F.lit(":"), h["role"]))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(kept, ",").alias("hints"))


@query("SELECT event_id, event_type, upper(event_type) AS archetype FROM (SELECT event_id, event_type FROM events)")
def archetype_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11: spellings of the event types to canonical ids."""
    known = table(spark, sf_dir, "events").select(F.upper("event_type").alias("id")).distinct()
    spelled = F.when(F.col("event_id") % 3 == 0, F.initcap("event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.substring("event_type", 1, 2), F.lit("_"), F.expr("substring(event_type, 3)"))).otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", spelled.alias("archetype"))
    return C.canonical_archetype(rows, known).select("event_id", "event_type", "archetype")


@query(
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS parsed FROM events"""
)
def json_reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-1: replies bare, fenced (closed and open), in prose, and truncated; truncated ones parse to null."""
    p = F.col("props")
    reply = (
        F.when(F.col("event_id") % 5 == 0, F.substring(p, 1, 4))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit("```\n"), p))
        .when(F.col("event_id") % 5 == 3, F.concat(F.lit("Here it is: "), p, F.lit(" Hope that helps.")))
        .otherwise(p)
    )
    rows = table(spark, sf_dir, "events").select("event_id", F.get_json_object(p, "$.k").cast("long").alias("k"), V.json_object(reply).alias("object"))
    return rows.select("event_id", "k", F.from_json("object", "k long")["k"].alias("parsed"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'der1-32b' WHEN 1 THEN 'll4-sco' WHEN 2 THEN 'bgm3' ELSE 'qw3-235b' END AS slug,
    CASE WHEN h > 0 THEN h || 'h ' ELSE '' END || CASE WHEN m > 0 OR h > 0 THEN m || 'm ' ELSE '' END || s || 's ' || ms || 'ms' AS took
    FROM (SELECT o_orderkey, CAST(floor(x / 3600) AS BIGINT) AS h, CAST(floor((x % 3600) / 60) AS BIGINT) AS m, CAST(floor(x % 60) AS BIGINT) AS s, CAST(round((x - floor(x)) * 1000) AS BIGINT) AS ms FROM (SELECT o_orderkey, floor(o_totalprice) / 16 AS x FROM orders))"""
)
def slug_and_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-8 and STR-10."""
    k = F.col("o_orderkey") % 4
    name = F.when(k == 0, "deepseek-r1:32b").when(k == 1, "llama4:scout").when(k == 2, "bge-m3:latest").otherwise("qwen3:235b-a22b")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.model_slug(name).alias("slug"), X.duration(F.floor("o_totalprice") / 16).alias("took"))


@query(
    r"""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Unknown' ELSE replace(c_name, '#', '') END || CASE WHEN c_custkey % 7 = 0 THEN '0000' ELSE CAST(1990 + c_custkey % 35 AS VARCHAR) END AS paper_id,
    'P' || c_custkey AS stem_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS code FROM customer"""
)
def paper_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-9, STR-12, STR-13."""
    k = F.col("c_custkey")
    author = F.when(k % 5 == 0, F.lit("  ")).otherwise(F.replace("c_name", F.lit("#"), F.lit("")))
    year = F.when(k % 7 == 0, F.lit(None)).otherwise((1990 + k % 35).cast("string"))
    stem = F.concat(F.lit("P"), k.cast("string"), F.when(k % 2 == 0, "_cq_v2_ext-a").otherwise("_ext-qw_g-x"))
    issue = F.when(k % 2 == 0, F.concat(F.lit("["), F.col("c_mktsegment"), F.lit("] trouble"))).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.paper_id(author, year).alias("paper_id"), X.stem_paper_id(stem).alias("stem_id"), X.issue_code(issue).alias("code"))


@query(
    """SELECT conv_id, md5(string_agg(CAST(n AS VARCHAR) || '. ' || text, chr(10) ORDER BY n)) AS prompt FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id"""
)
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-14: numbered blocks in turn order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(X.numbered_block(turns["text"])).alias("prompt"))


@query(
    """WITH f AS (SELECT page_id, generate_subscripts(raws, 1) AS ord, unnest(raws) AS raw FROM (SELECT page_id, string_split_regex(html, '(?i)</(?:p|h1|h2|li|div|title)>') AS raws FROM pages)),
    l AS (SELECT page_id, ord, trim(regexp_replace(raw, '(?s)<script\\b.*?</script>|<style\\b.*?</style>|<[^>]*>', ' ', 'g')) AS text, CASE WHEN regexp_matches(raw, '(?i)<h[12]\\b') THEN 14.0 ELSE 10.0 END AS size FROM f),
    b AS (SELECT page_id, arg_max(size, (n, -size)) AS body FROM (SELECT page_id, size, count(*) AS n FROM l WHERE text <> '' GROUP BY ALL) GROUP BY page_id),
    m AS (SELECT page_id, string_agg(CASE WHEN size >= 1.25 * body THEN '## ' || text ELSE text END, chr(10) ORDER BY ord) AS md FROM l JOIN b USING (page_id) WHERE text <> '' GROUP BY page_id)
    SELECT page_id, length(md) AS n_chars, CAST(len(list_filter(string_split(md, chr(10)), lambda x: starts_with(x, '## '))) AS BIGINT) AS n_headings FROM m"""
)
def page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3 / SRC-4 stand-in: sized fragments of pages to markdown with headings, and counts."""
    from ..sources.files import rich_text

    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.posexplode(F.split("html", "(?i)</(?:p|h1|h2|li|div|title)>")).alias("ord", "raw"))
    body = F.trim(F.regexp_replace("raw", r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " "))
    lines = pages.select("doc", F.lit(0).alias("page"), "ord", body.alias("text"), F.when(F.col("raw").rlike("(?i)<h[12]\\b"), 14.0).otherwise(10.0).alias("size"), F.lit(False).alias("bold")).where("text <> ''")
    md = rich_text(lines)
    return md.select(F.col("doc").alias("page_id"), F.length("markdown").cast("long").alias("n_chars"), X.section_count(F.col("markdown")).alias("n_headings"))


@query("SELECT doc_id, md5(CASE WHEN lower('BAAI/bge-small-en-v1.5') LIKE '%bge%' THEN '" + X.QUERY_INSTRUCTION + "' || text ELSE text END) AS digest, sha1(coalesce(text, '')) AS cache_key FROM documents")
def query_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-3 instruction prefix and VEC-4 content key."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.query_text(F.col("text"), F.lit("BAAI/bge-small-en-v1.5"))).alias("digest"), F.sha1(F.coalesce("text", F.lit(""))).alias("cache_key"))
