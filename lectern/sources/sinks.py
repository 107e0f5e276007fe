"""Sinks: idempotent writes, per-paper and per-archetype outputs, the vector index.

Defined cases: an empty table is written as an empty output, which counts as there; rows with a null in their key are always new to
`append_new` (a null equals nothing there; `streaming.ingest` takes nulls as equal); null texts are in no embedding cache.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import index


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def write_once(df: DataFrame, path: str, overwrite: bool = False, by: list[str] | None = None) -> bool:
    """Write unless the output is there already (or overwrite); tells whether it wrote."""
    if exists(df.sparkSession, path) and not overwrite:
        return False
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return True


def append_new(df: DataFrame, path: str, key: list[str]) -> int:
    """Append the rows whose key is not there yet; returns how many."""
    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.parquet(path).select(*key), key, "left_anti")
    new = df.cache()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def with_slug(spark: SparkSession, path: str, model: str) -> str:
    """The path with the short code of the model whose output goes there."""
    return f"{path}_{spark.range(1).select(X.model_slug(F.lit(model))).first()[0]}"


def export_json(df: DataFrame, path: str, by: str, model: str | None = None) -> None:
    """JSON lines, one folder for each value of `by`; with a model, its short code is part of the name."""
    path = with_slug(df.sparkSession, path, model) if model else path
    df.select(by, F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def export_records(df: DataFrame, path: str) -> None:
    """One JSON file a row, as the corpus report reads them."""
    df.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def split_by_archetype(questions: DataFrame, reverse: DataFrame, path: str, stats: DataFrame | None = None) -> None:
    """SNK-3: questions by archetype, with the part of the reverse index that points at them and the archetype's statistics (archetype, ...)."""
    questions.write.mode("overwrite").partitionBy("archetype").parquet(f"{path}/questions")
    own = reverse.join(questions.select("group_id", "archetype"), "group_id")
    own.write.mode("overwrite").partitionBy("archetype").parquet(f"{path}/reverse_index")
    if stats is not None:
        stats.join(questions.select("archetype").distinct(), "archetype", "left_semi").write.mode("overwrite").partitionBy("archetype").json(f"{path}/stats")


def save_index(chunks: DataFrame, path: str, model: str) -> int:
    """SNK-4: chunks(paper_id, chunk_id, text, vec) into the vector index; only papers that changed are written. The index's version."""
    return index.update(chunks, path, model)


def reusable_papers(chunks: DataFrame, path: str, model: str) -> DataFrame:
    """ST-4: papers whose stored vectors are of this model and of exactly these texts."""
    return chunks.select(F.col("paper_id").cast("string").alias("paper_id")).distinct().join(index.changed(chunks, path, model), "paper_id", "left_anti")


def missing_embeddings(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct texts the content-addressed cache has no vector of this model for."""
    keyed = texts.select(F.sha1("text").alias("text_hash"), "text").dropDuplicates(["text_hash"])
    return keyed.join(cache.where(F.col("model_name") == model).select("text_hash"), "text_hash", "left_anti")
