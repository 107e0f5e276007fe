"""Groups of blocks: the rows of all pairs for papers of many groups, and vectors sent a fixed number of times."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import vectors as R

from .test_near_pairs import SCHEMA, brute, rows


@pytest.mark.parametrize("kind", ["loose", "tight"])
@pytest.mark.parametrize("most", [R.GROUP_VALUES, 600])
def test_many_groups_give_all_pairs(spark, monkeypatch, kind, most):
    """Paper 0 has 1,000 vectors: eight groups, or twenty where a group may hold 600 components."""
    monkeypatch.setattr(R, "GROUP_VALUES", most)
    data = rows(kind, n=1500)
    packed = R.clustered(spark.createDataFrame(data, SCHEMA).repartition(3), "paper", "item", "v", block=25)
    assert R.meetings(packed.where("paper = 0").withColumn("limit", F.lit(0.0))).agg(F.max("gy")).first()[0] == (7 if most > 600 else 19)
    sums, pairs = brute(data, 0.92)
    got = {r.paper: (r.pairs, r.cosine_sum, r.near, r.cosine_max) for r in R.pair_sums(packed, "int", 0.92).collect() if r.paper is not None}
    assert got == {p: (n, pytest.approx(s, abs=1e-6), k, pytest.approx(m)) for p, (n, s, k, m) in sums.items()}
    near = [tuple(r) for r in R.near_pairs(packed, "int", 0.92).select("paper", "a", "b", F.round("cosine", 6)).collect()]
    assert sorted(near) == sorted(pairs)


def test_vectors_sent_follow_the_input(spark):
    """Four times the vectors, in four times the blocks, are sent four times as often and not sixteen; every two groups are a task of their own."""
    sent = {}
    for n in (600, 2400):
        packed = R.pack(spark.range(n).selectExpr("1 AS paper", "id", "array(double(id), 1.0D) AS v"), "paper", "id", "v", block=10)
        met = R.meetings(packed.withColumn("limit", F.lit(0.0)))
        sent[n] = met.agg(F.sum(F.size("items"))).first()[0]
        assert met.select("gx", "gy").distinct().count() == R.GROUPS * (R.GROUPS + 1) // 2
    assert sent == {600: 600 * R.GROUPS, 2400: 2400 * R.GROUPS}
