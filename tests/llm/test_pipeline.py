"""The pipeline against brute force stage by stage, and the SQL of the queries that have some."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline as P
from lectern.llm import decontamination as D
from lectern.llm import queries

from .test_ngram_join import brute as components
from .test_repeats import by_bytes


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    want = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: repr(r)
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").cache()
    one = P.language(spark, docs, tiny)
    assert one.columns == docs.columns and one.count() == docs.count()
    two = P.near_duplicates(spark, one, tiny).cache()
    found = components([(r.doc_id, r.text) for r in one.collect()])
    assert {r.doc_id for r in two.collect()} == {i for i, (_, c) in found.items() if c == i}
    three = P.repeated_spans(spark, two, tiny).cache()
    assert three.columns == docs.columns and three.dtypes == docs.dtypes
    want = by_bytes([(r.doc_id, r.text) for r in two.collect()])
    for r in three.collect():
        n, gone, _, _ = want[r.doc_id]
        assert n - gone - 3 * want[r.doc_id][2] <= len(r.text.encode()) <= n - gone and r.n_chars == len(r.text)
    four = P.decontamination(spark, three, tiny).cache()
    bench = spark.read.parquet(f"{tiny}/benchmark.parquet").collect()
    items = [b" " + b" ".join(D.words_of(b.text)) + b" " for b in bench]
    clean = {r.doc_id for r in three.collect() if not any(i in b" " + b" ".join(D.words_of(r.text)) + b" " for i in items)}
    assert {r.doc_id for r in four.collect()} == clean
    five = P.packing(spark, four, tiny)
    assert {r.doc_id for r in five.select("doc_id").collect()} == clean


def test_language_stage_rejects(spark, small, monkeypatch):
    """Texts that no language's classifier takes go, all others stay; and only chosen languages stay where some are chosen."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = [(10_000 + i, t, None, "s", len(t)) for i, t in enumerate(["Ωμέγα και άλφα, πάντα ρεῖ, οὐδὲν μένει.", "xq zx qj vkq xzj qqx jxz kqv " * 5, "0x4f zq== 9931 kk##", "", "123 456"])]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    kept = P.language(spark, rows, small)
    assert kept.columns == docs.columns and "ArrowEvalPython" in kept._jdf.queryExecution().toString()
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert not [i for i in ids if i >= 10_000]
    gone = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in set(ids)}
    assert len(gone) <= 0.01 * docs.count() and all(len(t) < 200 for t in gone.values())
    monkeypatch.setattr(P, "LANGUAGES", ("de", "fr"))
    langs = [r.lang for r in P.language(spark, rows, small).collect()]
    assert langs and sum(x in ("de", "fr") for x in langs) >= 0.97 * len(langs)


def test_awkward_rows(spark, tiny):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, "a b c d e f", None, None, None), (2, None, "en", "s", None), (3, "", "en", "s", 0), (4, "12", "en", "s", 2), (5, "other words are here, five of them", "fr", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as block", "1 as text_hash")
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, tiny).cache()
        assert "text_hash" in docs.columns
    assert {r.doc_id for r in docs.collect()} == {None, 1, 5}
    assert P.STAGES[-1][1](spark, docs, tiny).count() == docs.count()


def test_repeated_and_null_ids(spark, tiny):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text, 0)] * 3 + [(7, text.replace("w59", "x"), 1), (9, text, 2), (None, text, 3), (None, text, 4), (None, text.upper(), 5)]
    rows += [(None, "quite another text", 6), (None, "quite another text", 7), (8, "alone here", 8), (8, "another one, alone", 9), (1, None, 10), (1, None, 11)]
    for n in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, tag int").repartition(n)
        got = P.near_duplicates(spark, docs, tiny)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        got = sorted(map(tuple, got.collect()), key=repr)
        assert all(r in rows for r in got)
        assert [r[0] for r in got if r[2] < 6] in ([7, None], [None, 7])
        assert sorted(r[2] for r in got if r[2] >= 6)[-4:] == [8, 9, 10, 11] and len(got) == 7


def test_run(spark, tiny):
    rows = P.run(spark, tiny)
    assert rows.count() > 0 and "sequence_id" in rows.columns
