"""Column functions, chunking, state and reports on small hand-made rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions import values as V
from lectern.operators import chunking, report, state
from tests.brute_chunks import split_chunks


def one(spark, column, **values):
    names = list(values)
    row = tuple(values.values())
    kinds = {str: "string", float: "double", int: "long", bool: "boolean", type(None): "string", list: "array<string>"}
    frame = spark.createDataFrame([row], ", ".join(f"{n} {kinds[type(v)]}" for n, v in values.items())) if names else spark.range(1)
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("  A \t b\n C ", "a b c"), (None, ""), ("ÉA B", "éa b")])
def test_norm(spark, raw, want):
    assert one(spark, X.norm(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw,want", [("a  b\n\n\n\n\n12\nc", "a b\n\n\nc"), ("\t7 \n x", "x"), ("12345\ny", "12345\ny"), (None, "")])
def test_boilerplate(spark, raw, want):
    assert one(spark, X.strip_boilerplate(F.col("t")), t=raw) == want


@pytest.mark.parametrize("name,want", [("deepseek-r1:32b", "der1-32b"), ("llama4:scout", "ll4-sco"), ("bge-m3:latest", "bgm3"), ("qwen3:235b-a22b", "qw3-235b"), ("m", "m")])
def test_slug(spark, name, want):
    assert one(spark, X.model_slug(F.col("t")), t=name) == want


@pytest.mark.parametrize("seconds,want", [(0.0, "0s 0ms"), (61.5, "1m 1s 500ms"), (3600.0, "1h 0m 0s 0ms"), (-5.0, "0s 0ms")])
def test_duration(spark, seconds, want):
    assert one(spark, X.duration(F.col("t")), t=seconds) == want


@pytest.mark.parametrize("text,want", [("at 70°C now", True), ("at 70 °C now", False), ("5 nm thick", True), ("no unit", False)])
def test_units(spark, text, want):
    assert one(spark, X.has_unit(F.col("t")), t=text) is want


@pytest.mark.parametrize("score,want", [(1.0, "pass"), (0.75, "pass"), (0.7499, "borderline"), (0.40, "borderline"), (0.3999, "fail"), (0.0, "fail")])
def test_verdicts(spark, score, want):
    assert one(spark, V.verdict(F.col("s")), s=score) == want


@pytest.mark.parametrize(
    "reply,want",
    [('{"k": 1}', '{"k": 1}'), ('```json\n{"k": 1}\n```', '{"k": 1}'), ('```\n{"k": 1}', '{"k": 1}'), ('Sure: {"k": {"j": 2}} done', '{"k": {"j": 2}}'), ("[1, 2]", None), ('{"k": ', None), (None, None)],
)
def test_json_object(spark, reply, want):
    assert one(spark, V.json_object(F.col("r")), r=reply) == want


@pytest.mark.parametrize("reply", ['{"questions": [{"a": "x"}]}', '{"cqs": [{"a": "x"}]}', '[{"a": "x"}]', 'text [{"a": "x"}] text'])
def test_json_rows(spark, reply):
    rows = one(spark, V.json_rows(F.col("r"), ["questions", "cqs"], "struct<a:string>"), r=reply)
    assert [r.a for r in rows] == ["x"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400), st.integers(5, 60))
def test_chunks_are_short_verbatim_and_complete(text, limit):
    pieces = split_chunks(text, limit)
    assert all(0 < len(p) <= limit for p in pieces)
    at = 0
    for p in pieces:  # in order and verbatim
        at = text.index(p, at) + len(p)
    assert "".join("".join(pieces).split()) == "".join(text.split()) or set("".join(text.split())) <= {"."} or "." in text
    assert sum(p.count("a") + p.count("b") for p in pieces) == text.count("a") + text.count("b")


def test_sentence_keeps_one_period():
    assert split_chunks("aaaa. bbbb. cccc", 11) == ["aaaa. bbbb.", "cccc"]


def test_overlap(spark):
    rows = spark.createDataFrame([("p", 0, "abcdef"), ("p", 1, "xyz"), ("q", 0, "m")], "paper string, chunk_id int, chunk string")
    got = {(r.paper, r.chunk_id): r.text for r in chunking.overlap(rows, "paper", 2).collect()}
    assert got == {("p", 0): "abcdef", ("p", 1): "efxyz", ("q", 0): "m"}


def item_rows():
    return [("p", c, "concepts", k, conf, s, o) for o, (c, k, conf, s) in enumerate([(0, "a", None, "s1"), (0, "b", "low", ""), (1, "a", "high", "s2"), (1, "a", "low", "s1"), (2, "|", "high", "x"), (2, "c", "low", "s3"), (3, "a", None, "s4"), (3, "a", None, "s5")])]


SCHEMA = "paper string, chunk_id int, category string, key string, confidence string, sentence string, ord long"


def test_fold_equals_aggregation_below_the_cap(spark):
    items = spark.createDataFrame(item_rows(), SCHEMA)
    a = {r.key: (r.mentions, r.confidence, list(r.evidence)) for r in state.merge_items(items).collect()}
    b = {r.key: (r.mentions, r.confidence, list(r.evidence)) for r in state.fold(items, {}).collect()}
    assert a == b == {"a": (5, "high", ["s1", "s2", "s4"]), "b": (1, "low", []), "c": (1, "low", ["s3"])}


def test_evicted_key_starts_again(spark):
    rows = [("p", 0, "concepts", "a", "high", "", 0), ("p", 0, "concepts", "b", "low", "", 1), ("p", 1, "concepts", "b", "low", "", 2)]
    got = {r.key: r.mentions for r in state.fold(spark.createDataFrame(rows, SCHEMA), {"concepts": 1}).collect()}
    assert got == {"a": 1}


def test_stream_equals_fold(spark):
    from lectern.streaming.rolling import run_available

    items = spark.createDataFrame(item_rows(), SCHEMA)
    a = sorted((r.paper, r.key, r.mentions) for r in state.fold(items, {"concepts": 2}).collect())
    b = sorted((r.paper, r.key, r.mentions) for r in run_available(items, {"concepts": 2}).collect())
    assert a == b


def test_compact_fits(spark):
    rows = [("p", "concepts", f"k{i:03d}" * 5, i, "high", [], i) for i in range(60)]
    frame = spark.createDataFrame(rows, "paper string, category string, key string, mentions long, confidence string, evidence array<string>, ord long")
    for budget in (10_000, 1_000, 30):
        view = state.compact(frame, budget).first().view
        assert len(view) <= budget + 60
        assert ("k059" in view) or budget == 30


OVERALL = [0.691, 0.621, 0.667, 0.702, 0.686, 0.735, 0.764, 0.685, 0.713, 0.674, 0.669, 0.679, 0.692, 0.703]
QUESTIONS = [49, 49, 48, 48, 49, 49, 49, 49, 49, 49, 49, 49, 48, 48]


def test_published_summary(spark):
    rows = spark.createDataFrame([(o, q, 0, 0) for o, q in zip(OVERALL, QUESTIONS)], "overall double, n_questions long, n_off_paper long, n_near_dupes long")
    got = report.metric_summary(rows, ["overall"], 4).first()
    assert (got["mean"], got["sd"], got["min"], got["max"], got["n"]) == (0.6915, 0.0321, 0.621, 0.764, 14)
    assert report.totals(rows).first().total_questions == 682


def test_empty_summary(spark):
    rows = spark.createDataFrame([(None,)], "overall double")
    assert tuple(report.metric_summary(rows, ["overall"]).first())[1:] == (0.0, 0.0, 0.0, 0.0, 0)


def test_running_sums_split_hot_groups(spark):
    """One group with most rows, null groups, and the same answer as one window over each group; the hot group is in several ranges."""
    from pyspark.sql import Window

    from lectern.operators import ranges

    rows = spark.range(5000).selectExpr("case when id % 10 < 7 then 'hot' when id % 10 = 9 then null else cast(id % 50 as string) end as g", "(id * 7919) % 5000 as o", "id % 13 as v")
    got = ranges.running_sums(rows, ["g"], ["o"], {"n": F.lit(1).cast("long"), "total": F.col("v")})
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("n", F.row_number().over(w).cast("long")).withColumn("total", F.sum("v").over(w))
    key = lambda r: repr(tuple(r))
    assert sorted(got.collect(), key=key) == sorted(want.select(*got.columns).collect(), key=key)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be merged
    try:
        split = ranges.running_sums(rows, ["g"], ["o"], {"n": F.lit(1).cast("long"), "total": F.col("v")})
        assert sorted(split.collect(), key=key) == sorted(want.select(*got.columns).collect(), key=key)
        dealt = rows.repartitionByRange("g", "o").withColumn("p", F.spark_partition_id()).where("g = 'hot'")
        assert dealt.select("p").distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranges.running_sums(rows.limit(0), ["g"], ["o"], {"n": F.lit(1).cast("long")}).count() == 0
