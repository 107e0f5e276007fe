"""Queries for source, cache, union and reply-repair operators on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import lists
from ..operators import replies as P
from ..operators import validation as C
from ..session import scratch, table
from ..sources import backends, files, index, sinks
from ..sources.embedding import Hashed, VectorCache
from ..streaming import ingest
from .registry import query


@query("SELECT o_custkey AS paper, round((avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) + max(o_totalprice) / 500000.0) / 2, 3) AS quality FROM orders GROUP BY o_custkey")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14: mean of the enabled components."""
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("paper")).agg(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("a"), (F.max("o_totalprice") / 500_000.0).alias("b"))
    return C.mean_score(g.unpivot(["paper"], ["a", "b"], "component", "score"))


@query("SELECT DISTINCT n_name AS model FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9950)")
def models_not_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-15: needed names the server does not list."""
    nation = table(spark, sf_dir, "nation")
    served = table(spark, sf_dir, "customer").where("c_acctbal > 9950").select(F.col("c_nationkey").alias("n_nationkey")).distinct().join(nation, "n_nationkey")
    return backends.required_models(nation.select(F.col("n_name").alias("model")), served.select(F.col("n_name").alias("model")))


@query(
    """WITH m AS (SELECT p_brand AS source_filename, min(p_name) AS title FROM part GROUP BY p_brand) SELECT s.s_suppkey AS paper, m.title, m.title IS NOT NULL AS cached FROM supplier s LEFT JOIN m ON m.source_filename = 'Brand#' || (s.s_suppkey % 40)"""
)
def metadata_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7: first cached metadata by file name; the rest needs extraction."""
    papers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("paper"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 40).cast("string")).alias("name"))
    cache = table(spark, sf_dir, "part").select(F.col("p_brand").alias("source_filename"), F.col("p_name").alias("title"))
    return files.with_cached_metadata(papers, cache).select("paper", F.col("metadata.title").alias("title"), "cached")


@query("SELECT DISTINCT sha1(text) AS text_hash FROM documents WHERE sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE lang = 'en')")
def embedding_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-4: texts the content-addressed cache lacks."""
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    cache = docs.where("lang = 'en'").select(F.sha1("text").alias("text_hash"), F.lit("m").alias("model_name")).distinct()
    return sinks.missing_embeddings(docs, cache, "m").select("text_hash")


@query("SELECT sha1(text) AS text_hash, CAST(count(*) AS BIGINT) AS n_texts, CAST(1 AS BIGINT) AS n_vectors, 16 AS dim, max(CAST(lang = 'en' AS INTEGER)) = 1 AS known FROM documents WHERE text IS NOT NULL GROUP BY sha1(text)")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-4 / EMB-1: English texts are embedded first, then all; the second run embeds what the first did not."""
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    cache, model = VectorCache(spark, f"{scratch(spark)}/vectors-{uuid.uuid4().hex}", 8), Hashed(16)
    first = docs.where("lang = 'en'").select("text")
    cache.embed(first, model)
    known = cache.vectors(model.name).select(F.col("text_hash").alias("hash"))
    rows = cache.embed(docs, model).where("text is not null").withColumn("text_hash", F.sha1("text"))
    per_text = rows.groupBy("text_hash").agg(F.count("*").alias("n_texts"), F.count_distinct("vec").alias("n_vectors"), F.max(F.size("vec")).alias("dim"))
    english = first.select(F.sha1("text").alias("hash")).distinct().join(known, "hash", "left_semi").withColumn("was", F.lit(True))
    return per_text.join(english, per_text["text_hash"] == english["hash"], "left").select("text_hash", "n_texts", "n_vectors", "dim", F.coalesce("was", F.lit(False)).alias("known"))


@query("SELECT s_suppkey AS paper_id FROM supplier WHERE s_suppkey = 7 OR contains(lower(s_name), '#7') OR contains('supplier#7', lower(s_name))")
def target_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-9: id equality, else mutual containment of stem and name."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("paper_id"), F.concat("s_name", F.lit(".pdf")).alias("name"))
    found = files.target_paper(rows, "#7").unionByName(files.target_paper(rows, "supplier#7")).unionByName(rows.where("paper_id = '7'"))
    return found.select(F.col("paper_id").cast("long").alias("paper_id")).distinct()


@query("SELECT paper, source, segment, list(doc_id ORDER BY doc_id) AS passages FROM (SELECT lang AS paper, source, doc_id, (row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1) // 20 AS segment FROM (SELECT lang, source, doc_id FROM documents UNION ALL SELECT lang, source, doc_id FROM documents WHERE doc_id % 3 = 0)) GROUP BY ALL")
def passage_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-1 / SET-2: maps of passages appended key by key, nothing dropped; the lists come in segments."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("paper"), "source", "doc_id")
    both = files.union_all([docs, docs.where("doc_id % 3 = 0")])
    return lists.segmented(both, ["paper", "source"], ["doc_id"], "doc_id", 20).withColumnRenamed("items", "passages")


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 0 ELSE 1 END AS n_rows, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_type END AS name FROM events")
def json_rows_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-2: rows under different keys, as a bare array, or nowhere."""
    item = F.concat(F.lit('[{"name": "'), F.col("event_type"), F.lit('"}]'))
    k = F.col("event_id") % 4
    reply = F.when(k == 0, F.concat(F.lit('{"questions": '), item, F.lit("}"))).when(k == 1, F.concat(F.lit('```json\n{"cqs": '), item, F.lit("}\n```"))).when(k == 2, F.concat(F.lit("As asked: "), item)).otherwise("sorry")
    rows = table(spark, sf_dir, "events").select("event_id", V.json_rows(reply, ["questions", "cqs", "competency_questions"], "struct<name:string>").alias("r"))
    return rows.select("event_id", F.coalesce(F.size("r"), F.lit(0)).alias("n_rows"), F.col("r")[0]["name"].alias("name")).withColumn("n_rows", F.when(F.col("n_rows") > 0, F.col("n_rows")).otherwise(0))


@query("SELECT o_orderkey AS id, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_orderkey")
def schema_checked_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-3: rows without sources fail the schema."""
    k = F.col("o_orderkey").cast("string")
    source = F.when(F.col("o_orderkey") % 3 == 0, F.lit("[]")).otherwise(F.concat(F.lit('["'), k, F.lit('"]')))
    reply = F.concat(F.lit('{"consolidated_cqs": [{"cq_id": "'), k, F.lit('", "competency_question": "q", "merged_from": '), source, F.lit("}]}"))
    rows = P.consolidated(table(spark, sf_dir, "orders").select(F.lit("c").alias("call_id"), reply.alias("reply")))
    return rows.groupBy(F.col("cq_id").cast("long").alias("id")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, list(role ORDER BY turn) AS roles FROM (SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-1: names merged by normalised spelling, first spelling and order kept."""
    all_ = F.array_sort(F.collect_list(F.struct("turn", "role")))["role"]
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(all_.alias("names"))
    return rows.select("conv_id", V.merge_aliases(F.col("names"), F.transform("names", lambda n: F.concat(F.lit(" "), F.upper(n))), X.norm).alias("roles"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'der1-32b' ELSE 'g-ge4-31b_v-der1-32b_r-qw-35b' END AS slug FROM orders")
def pipeline_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-8 for a triple of models."""
    even = F.col("o_orderkey") % 2 == 0
    v = F.lit("deepseek-r1:32b")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.pipeline_slug(F.when(even, v).otherwise("gemma4:31b"), v, F.when(even, v).otherwise("qwen3.5:35b")).alias("slug"))


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')")
def incremental_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2 / ST-3: lines of finished orders are in the output; a stream of all lines adds those whose order is not there yet."""
    base = f"{scratch(spark)}/ingest-{uuid.uuid4().hex}"
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    ingest.append_batch(lines.join(done, "l_orderkey", "left_semi"), f"{base}/out", 0, ["l_orderkey"])
    lines.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(lines.schema).parquet(f"{base}/in")
    writer = stream.writeStream.foreachBatch(lambda rows, n: ingest.append_batch(rows, f"{base}/out", n + 1, ["l_orderkey"]) and None)
    writer.option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    return ingest.ingested(spark, f"{base}/out", lines.schema, since=1).drop("batch")


@query("SELECT CAST(label AS VARCHAR) AS paper_id, CAST(count(*) AS BIGINT) AS n_chunks, CAST(CASE WHEN label % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version, 64 AS dim, 2 AS latest, CAST(count(*) FILTER (WHERE label % 3 = 0) AS BIGINT) AS n_new FROM embeddings WHERE label IS NOT NULL GROUP BY label")
def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-4 / SRC-9 / ST-4: every paper is indexed, a third of them get new texts; the second version writes these only."""
    path = f"{scratch(spark)}/index-{uuid.uuid4().hex}"
    chunks = table(spark, sf_dir, "embeddings").select(F.col("label").alias("paper_id"), F.col("vec_id").alias("chunk_id"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"), F.col("embedding").alias("vec"))
    sinks.save_index(chunks, path, "m")
    text = F.when(F.col("paper_id") % 3 == 0, F.concat("text", F.lit(" anew"))).otherwise(F.col("text"))
    latest = sinks.save_index(chunks.withColumn("text", text), path, "m")
    found = index.read(spark, path).groupBy("paper_id", "version").agg(F.count("*").alias("n_chunks"), F.max(F.size("vec")).alias("dim"), F.count_if(F.col("text").endswith(" anew")).alias("n_new"))
    return found.withColumn("latest", F.lit(latest))


@query(
    """WITH liked AS (SELECT DISTINCT c_custkey % 200 AS persona, c_nationkey FROM customer WHERE c_acctbal > 9500), own AS (SELECT s_suppkey AS persona, n_name AS archetype, n_nationkey AS ord FROM supplier JOIN liked ON persona = s_suppkey JOIN nation ON n_nationkey = c_nationkey)
    SELECT * FROM own UNION ALL SELECT s_suppkey, n_name, n_nationkey FROM supplier CROSS JOIN (SELECT * FROM nation ORDER BY n_nationkey, n_name LIMIT 4) WHERE s_suppkey NOT IN (SELECT persona FROM own)"""
)
def persona_archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-14: suppliers as personas, nations as archetypes, nations of wealthy customers as what a persona favours."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("archetype"), F.col("n_nationkey").alias("ord"))
    wealthy = table(spark, sf_dir, "customer").where("c_acctbal > 9500").select((F.col("c_custkey") % 200).alias("persona"), F.col("c_nationkey").alias("ord"))
    personas = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("persona"))
    return C.persona_archetypes(personas, wealthy.join(nation, "ord").select("persona", "archetype"), nation)


@query(
    r"""SELECT doc_id, length(coalesce(text, '')) AS char_count, CAST(floor(length(coalesce(text, '')) / 4.0) AS BIGINT) AS estimated_tokens, CAST(len(regexp_extract_all(coalesce(text, ''), '!\[[^\]]*\]\(|<img\b')) AS BIGINT) AS n_images,
    round(strlen(coalesce(text, '')) / 1024, 1) AS size_kb FROM documents"""
)
def paper_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3: sizes and image references of every document."""
    from ..sources.files import paper_stats

    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text", F.lit(1).alias("n_pages"))
    return paper_stats(texts).select(F.col("path").alias("doc_id"), "char_count", "estimated_tokens", "n_images", "size_kb")
