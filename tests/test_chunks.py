"""The built-in splitter against recursive splitting in plain Python, on made-up texts and on a whole table."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import chunking
from lectern.plans import QUERIES
from tests.brute_chunks import split_chunks


@pytest.mark.parametrize("limit", [1, 3, 7, 40, 3500])
def test_splitter(spark, limit):
    rng = random.Random(limit)
    texts = ["".join(rng.choice("ab . \n\n  é..\xa0\t") for _ in range(rng.randrange(200))) for _ in range(400)]
    texts += ["", "a" * 100, "x. y. " * 40, "\n" * 60, ". . . . " * 20, "..  ..  " * 10, "word " * 20_000, " a\x1c", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunking.split_chunks(F.col("t"), limit).alias("c")).collect()
    assert [(r.t, r.c) for r in got] == [(t, split_chunks(t, limit)) for t in texts]


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = chunking.chunk(docs, "doc_id", "text")
    assert "Python" not in rows._jdf.queryExecution().toString() and "Arrow" not in rows._jdf.queryExecution().toString()
    got = {}
    for r in rows.orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    cleaned = {r.doc_id: r.t for r in docs.select("doc_id", X.strip_boilerplate(F.col("text")).alias("t")).collect()}
    assert got == {i: c for i, t in cleaned.items() if (c := split_chunks(t))}
    assert "Python" not in QUERIES["chunk_documents"](spark, small)._jdf.queryExecution().toString()
