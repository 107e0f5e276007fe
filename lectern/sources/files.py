"""File sources: listing, text and page extraction, JSON scans, caches and configuration."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import index, pdf

SUFFIXES = (".pdf", ".txt", ".md")
METADATA = "title string, first_author_lastname string, year string, journal string, doi string, paper_type string, keywords array<string>, source_filename string"
EVALUATION = (
    "paper_id string, evaluation struct<n_questions:bigint,overall_score:double,families:struct<"
    "coverage:struct<score:double,concepts:struct<total:bigint,referenced:bigint,ratio:double>>,"
    "question_faithfulness:struct<score:double,mean_cosine:double,n_off_paper:bigint>,"
    "diversity:struct<score:double,n_near_duplicates:bigint>,triplifiability:struct<score:double>>>, _corrupt_record string"
)


def list_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, suffix and size of the papers in a folder: known suffixes in any case, no dot-files."""
    name = F.substring_index("path", "/", -1)
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.*").load(folder).select("path", F.col("length").alias("bytes"))
    rows = rows.withColumn("name", name).withColumn("suffix", F.lower(F.concat(F.lit("."), F.substring_index("name", ".", -1))))
    return rows.where(F.col("suffix").isin(*SUFFIXES) & ~F.col("name").startswith(".")).orderBy("path")


def _pdf_text(body: bytes) -> tuple[str | None, int | None, str | None]:
    try:
        return *pdf.plain_text(body), None
    except Exception as problem:  # a broken file is a row, not the end of the job
        return None, None, str(problem)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path, text, n_pages, error: plain files as UTF-8, PDFs page by page; `pdf.pages` is for documents too long for one row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, body in zip(frame["path"], frame["content"], strict=True):
                low = path.lower()
                if low.endswith(".pdf"):
                    rows.append((path, *_pdf_text(body)))
                elif low.endswith((".txt", ".md")):
                    rows.append((path, body.decode("utf-8", "replace"), None, None))
                else:
                    rows.append((path, None, None, "unsupported suffix"))
            yield pd.DataFrame(rows, columns=["path", "text", "n_pages", "error"])

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(run, "path string, text string, n_pages int, error string")


def paper_stats(texts: DataFrame) -> DataFrame:
    """Character, token, section, table-label and image counts and the size of texts(path, text, n_pages)."""
    t = F.coalesce("text", F.lit(""))
    images = F.regexp_count(t, F.lit(r"!\[[^\]]*\]\(|<img\b")).cast("long").alias("n_images")
    return texts.select("path", images, F.round(F.octet_length(t) / 1024, 1).alias("size_kb"), "n_pages", F.length(t).cast("long").alias("char_count"), X.estimated_tokens(t).alias("estimated_tokens"), X.section_count(t).alias("n_sections"), X.table_labels(t).alias("n_tables"))


def rich_text(fragments: DataFrame) -> DataFrame:
    """Markdown of sized text lines(doc, page, ord, text, size, bold): a heading is 1.25 times the body size, or bold and 1.1 times.

    The body size of a document is the most frequent rounded size (the smaller on ties).
    """
    sizes = fragments.groupBy("doc", F.round("size").alias("s")).agg(F.count("*").alias("n")).groupBy("doc").agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("body"))
    heading = (F.col("size") >= 1.25 * F.col("body")) | (F.col("bold") & (F.col("size") >= 1.1 * F.col("body")))
    line = F.when(heading, F.concat(F.lit("## "), F.trim("text"))).otherwise(F.col("text"))
    rows = fragments.join(sizes, "doc").withColumn("line", line)
    return rows.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(F.struct("page", "ord", "line")))["line"], "\n").alias("markdown"))


def scan_json(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One row a JSON file, with its name; unreadable files keep a _corrupt_record if the schema has one."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(glob).select("*", F.col("_metadata.file_name").alias("file_name"))


def readable(scanned: DataFrame) -> DataFrame:
    """Rows whose file parsed; the others are for a warning."""
    return scanned.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def evaluations(spark: SparkSession, glob: str) -> DataFrame:
    """Per-paper metric rows of evaluation files; corrupt files are left out."""
    fam = "evaluation.families"
    rows = readable(scan_json(spark, glob, EVALUATION).cache())
    return rows.select(
        "paper_id",
        F.col("evaluation.n_questions").alias("n_questions"),
        F.col("evaluation.overall_score").alias("overall"),
        F.col(f"{fam}.coverage.score").alias("coverage"),
        F.col(f"{fam}.question_faithfulness.score").alias("faithfulness"),
        F.col(f"{fam}.diversity.score").alias("diversity"),
        F.col(f"{fam}.triplifiability.score").alias("triplifiability"),
        F.col(f"{fam}.coverage.concepts.ratio").alias("concept_cov"),
        F.col(f"{fam}.question_faithfulness.mean_cosine").alias("faith_cosine"),
        F.col(f"{fam}.question_faithfulness.n_off_paper").alias("n_off_paper"),
        F.col(f"{fam}.diversity.n_near_duplicates").alias("n_near_dupes"),
    )


def with_cached_metadata(papers: DataFrame, metadata: DataFrame) -> DataFrame:
    """papers left-joined with the first cached metadata of their file name; `cached` tells which still need extraction."""
    first = metadata.groupBy("source_filename").agg(F.min_by(F.struct(*[c for c in metadata.columns if c != "source_filename"]), "title").alias("metadata"))
    return papers.join(first, papers["name"] == first["source_filename"], "left").drop("source_filename").withColumn("cached", F.col("metadata").isNotNull())


def config_table(spark: SparkSession, text: str) -> DataFrame:
    """(pipeline, role, value) rows of a nested JSON configuration; keys that start with '_' are comments or options."""
    tree = json.loads(text)
    rows = [(p, k, v if isinstance(v, str) else json.dumps(v)) for p, entries in tree.items() if isinstance(entries, dict) for k, v in entries.items()]
    return spark.createDataFrame(rows, "pipeline string, role string, value string")


def role_model(needs: DataFrame, config: DataFrame, default: str) -> DataFrame:
    """needs(pipeline, role) with the configured model, or the default."""
    return needs.join(config, ["pipeline", "role"], "left").withColumn("model", F.coalesce("value", F.lit(default))).drop("value")


def target_paper(papers: DataFrame, wanted: str) -> DataFrame:
    """The paper asked for: its id, or a file stem that contains the text or is contained in it."""
    stem, w = F.lower(F.regexp_replace("name", r"\.[^.]*$", "")), F.lower(F.lit(wanted))
    return papers.where((F.col("paper_id") == wanted) | stem.contains(w) | w.contains(stem))


def load_index(spark: SparkSession, path: str, paper: str, model: str) -> DataFrame:
    """Chunk vectors of a paper, with `stale` where another model made them (a warning, not an error)."""
    return index.read(spark, path).where(F.col("paper_id") == paper).withColumn("stale", F.col("model_name") != model)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def persona_table(spark: SparkSession, text: str) -> DataFrame:
    """JSON of {"personas": [{code, perspective, question_style}, ...]} as (persona, perspective, question_style)."""
    rows = [(p["code"], p.get("perspective") or "", p.get("question_style") or "") for p in json.loads(text).get("personas", []) if p.get("code")]
    return spark.createDataFrame(rows, "persona string, perspective string, question_style string")


def archetype_tables(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """JSON of {"archetypes": [{id}, ...], "persona_archetype_affinity": {code: [id, ...]}} as (archetype, ord) and (persona, archetype); keys that start with '_' are comments."""
    tree = json.loads(text)
    known = [(a["id"], i) for i, a in enumerate(tree.get("archetypes", []))]
    liked = [(code, a) for code, names in tree.get("persona_archetype_affinity", {}).items() if not code.startswith("_") for a in names]
    return spark.createDataFrame(known, "archetype string, ord int"), spark.createDataFrame(liked, "persona string, archetype string")
