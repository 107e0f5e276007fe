"""Embedders behind a protocol, and a cache of vectors that is only added to.

An embedder is a small picklable object with a name, a dimension and `load()`, which gives the function that embeds a batch of texts. It is
loaded once a task, and called with BATCH texts at a time.

The cache is a bucketed table of (model, text digest, vector) in a folder. Joins and the reader's grouping by digest find its rows already
dealt, so the cache side is never shuffled. Writers only append: two that embed one text at once leave two rows, of which every reader
takes the same one, so a text has one vector.

Defined cases: null texts have no vector and are never embedded; texts are told apart by their SHA-1; copies are embedded once; an empty
table embeds nothing; a model's vectors are never taken for another's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import keep

BATCH = 32
BUCKETS = 64


class Embedder(Protocol):
    name: str
    dim: int

    def load(self) -> Callable[[list[str]], np.ndarray]: ...


@dataclass(frozen=True)
class Hashed:
    """An offline stand-in for an embedding model: hashed words, unit length. Not equivalent to one."""

    dim: int = 384
    name: str = "hashed-words"

    def load(self) -> Callable[[list[str]], np.ndarray]:
        return lambda texts: np.stack([self.one(t) for t in texts])

    def one(self, text: str) -> np.ndarray:
        v = np.zeros(self.dim, np.float32)
        for w in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % self.dim] += 1.0 if h >> 63 else -1.0
        n = float(np.linalg.norm(v))
        return v / n if n else v


def embedding(text: Column, embedder: Embedder = Hashed(), batch: int = BATCH) -> Column:
    """The vectors of a column of texts; a null text counts as empty here."""

    @F.pandas_udf("array<float>")
    def embed(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = embedder.load()  # once a task
        for column in columns:
            texts = [t if isinstance(t, str) else "" for t in column]
            parts = [np.asarray(ready(texts[lo : lo + batch]), np.float32) for lo in range(0, len(texts), batch)]
            yield pd.Series([row for part in parts for row in part], index=column.index, dtype=object)

    return embed(text)


class VectorCache:
    """The vectors of texts, by model and digest, in a folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.table = "vectors_" + hashlib.sha1(folder.encode()).hexdigest()[:16]
        where = folder.replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (text_hash STRING, model_name STRING, vec ARRAY<FLOAT>) USING parquet CLUSTERED BY (text_hash) SORTED BY (text_hash) INTO {buckets} BUCKETS LOCATION '{where}'")

    def vectors(self, model: str) -> DataFrame:
        """(text_hash, vec) of a model, one a text; grouped where the rows are."""
        self.spark.catalog.refreshTable(self.table)
        rows = self.spark.table(self.table).where(F.col("model_name") == model)
        return rows.groupBy("text_hash").agg(F.min("vec").alias("vec"))

    def append(self, rows: DataFrame, model: str) -> None:
        """Add rows(text_hash, vec); nothing that is there is touched."""
        made = rows.select("text_hash", F.lit(model).alias("model_name"), F.col("vec").cast("array<float>").alias("vec"))
        made.write.bucketBy(self.buckets, "text_hash").sortBy("text_hash").format("parquet").mode("append").option("path", self.folder).saveAsTable(self.table)

    def missing(self, texts: DataFrame, model: str) -> DataFrame:
        """(text_hash, text): different texts without a vector of this model. texts: text."""
        keyed = texts.where("text is not null").select(F.sha1("text").alias("text_hash"), "text").dropDuplicates(["text_hash"])
        return keyed.join(self.vectors(model).select("text_hash"), "text_hash", "left_anti")

    def embed(self, texts: DataFrame, embedder: Embedder) -> DataFrame:
        """texts with `vec`; only texts the cache lacks are embedded, and their vectors are in the cache before anything reads them."""
        new = keep(self.missing(texts, embedder.name).select("text_hash", embedding(F.col("text"), embedder).alias("vec")))
        if not new.isEmpty():
            self.append(new, embedder.name)
        own = self.vectors(embedder.name).withColumnRenamed("text_hash", "_hash")
        return texts.join(own, F.sha1("text") == F.col("_hash"), "left").drop("_hash")
