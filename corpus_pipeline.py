"""The corpus pipeline: five stages, each an operator of lectern.llm, from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Defined cases: rows that share a doc_id are separate documents, of which one of a group of near-duplicates stays; so it is with
rows without an id, which never give way to those with one (tests/llm/test_pipeline.py holds that); null texts have no letter, so language identification rejects them, as it does texts that no language's classifier takes;
an empty table passes through all stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import language_id as L
from lectern.llm.blocks import shared_folder
from lectern.llm.decontamination import without_leaks
from lectern.llm.ngram_join import without_near_copies
from lectern.llm.packing import pack
from lectern.llm.queries import tokenizer_path
from lectern.llm.suffix_dedup import suffix_dedup

LANGUAGES: tuple[str, ...] | None = None  # languages to keep; None: all that the labelled rows teach
FLOOR = 0.4  # least score of a kept document; 0.5 is where a one-versus-rest classifier is undecided


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of LANGUAGES, by the model's prediction; what it rejects goes: no letters, another language, or a score under FLOOR,
    which means that every language's own classifier clearly says no. Without labelled rows nothing is rejected."""
    model = L.train(docs)
    if model is None:
        return docs
    found = L.prediction(spark, model)(F.col("text"))
    known = found["lang_pred"] != L.UND if LANGUAGES is None else found["lang_pred"].isin(*LANGUAGES)
    return docs.where(known & (found["score"] >= FLOOR))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id, and one of those without an id."""
    return without_near_copies(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated 100-byte strings; a character cut in the middle goes whole. n_chars follows the text."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    rows = suffix_dedup(docs, carry=carry)
    for i, c in enumerate(carry):
        rows = rows.withColumnRenamed(f"x_{i}", c)
    if "n_chars" in carry:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens in as few sequences as the packing finds."""
    return pack(docs, tokenizer_path(), capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeated_spans),
    ("decontamination", decontamination),
    ("packing", packing),
]

# no stage but the second can be said in SQL, so the run is tested against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    shared_folder(spark)
    base = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # the stage before is read for the last time
            gone = jvm.org.apache.hadoop.fs.Path(before)
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
        before = path
    return docs
