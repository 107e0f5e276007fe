"""Embedders loaded once a task, and the cache: nothing is embedded twice, two writers leave one vector a text."""

import os
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from lectern.sources.embedding import Hashed, VectorCache, embedding


@dataclass(frozen=True)
class Counting:
    """Leaves a file for each load and each batch, with the batch's size in its name."""

    folder: str
    name: str = "counting"
    dim: int = 2
    shift: float = 0.0

    def load(self):
        open(f"{self.folder}/load-{uuid.uuid4().hex}", "w").close()

        def run(texts):
            open(f"{self.folder}/batch-{len(texts)}-{uuid.uuid4().hex}", "w").close()
            return np.array([[len(t), 1 + self.shift] for t in texts], np.float32)

        return run


def batches(folder):
    return [int(f.split("-")[1]) for f in os.listdir(folder) if f.startswith("batch")]


def test_one_load_a_task_and_batches(spark, tmp_path):
    import tests.test_embedding as own

    df = spark.range(300).selectExpr("cast(id as string) as t").repartition(3).union(spark.sql("select cast(null as string)").coalesce(1))
    rows = df.select("t", embedding(F.col("t"), own.Counting(str(tmp_path))).alias("v")).collect()
    assert all(r.v == [len(r.t or ""), 1.0] for r in rows) and len(rows) == 301
    assert sum(f.startswith("load") for f in os.listdir(tmp_path)) <= 4
    assert sum(batches(tmp_path)) == 301 and max(batches(tmp_path)) == 32
    assert abs(np.linalg.norm(Hashed().one("some words here")) - 1) < 1e-6 and not Hashed().one("").any()


def test_second_run_embeds_nothing(spark, tmp_path):
    import tests.test_embedding as own

    (tmp_path / "n").mkdir()
    cache, model = VectorCache(spark, str(tmp_path / "cache"), 4), own.Counting(str(tmp_path / "n"))
    df = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "text string")
    want = {("a", (1.0, 1.0)), ("bb", (2.0, 1.0)), (None, None)}
    assert {(r.text, r.vec and tuple(r.vec)) for r in cache.embed(df, model).collect()} == want
    assert sum(batches(tmp_path / "n")) == 2
    again = cache.embed(df, model)
    assert {(r.text, r.vec and tuple(r.vec)) for r in again.collect()} == want and again.count() == 4
    assert sum(batches(tmp_path / "n")) == 2
    cache.embed(spark.createDataFrame([("ccc",), ("a",)], "text string"), model)
    assert sum(batches(tmp_path / "n")) == 3
    assert cache.embed(df.limit(0), model).count() == 0 and cache.vectors("other").count() == 0


def test_two_writers_leave_one_vector(spark, tmp_path):
    import tests.test_embedding as own

    (tmp_path / "n").mkdir()
    cache = VectorCache(spark, str(tmp_path / "cache"), 4)
    df = spark.createDataFrame([("a",), ("bb",)], "text string")
    for shift in (0.0, 0.5):  # both found the cache empty
        made = df.select(F.sha1("text").alias("text_hash"), embedding(F.col("text"), own.Counting(str(tmp_path / "n"), shift=shift)).alias("vec"))
        cache.append(made, "counting")
    assert sorted(tuple(r.vec) for r in cache.vectors("counting").collect()) == [(1.0, 1.0), (2.0, 1.0)]
    plan = cache.vectors("counting")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SelectedBucketsCount" in plan
