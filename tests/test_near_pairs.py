"""Near pairs with bounded blocks: the rows of all pairs, and fewer block pairs on clustered data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import vectors as R

SCHEMA = "paper int, item long, v array<double>"


def rows(kind, n=600, dim=12, seed=2):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) if kind == "loose" else np.repeat(rng.normal(size=(12, dim)), n // 12, 0) + 0.02 * rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = [(0 if i % 3 else 1 + i % 5, i, x.tolist()) for i, x in enumerate(v)]
    return out + [(7, 1000, v[0].tolist()), (8, 1001, None), (9, 1002, [float("nan")] * dim), (9, 1002, [1.0] + [0.0] * (dim - 1)), (None, 1003, v[1].tolist())]


def brute(data, threshold):
    sums, pairs = {}, set()
    for paper in {p for p, _, v in data if v is not None and p is not None}:
        own = [(i, np.nan_to_num(np.array(v))) for p, i, v in data if p == paper and v is not None]
        cos = [(own[x][0], own[y][0], float(own[x][1] @ own[y][1])) for x in range(len(own)) for y in range(x + 1, len(own))]
        if cos:
            sums[paper] = (len(cos), sum(c for _, _, c in cos), sum(c >= threshold for _, _, c in cos), max(c for _, _, c in cos))
        pairs |= {(paper, min(a, b), max(a, b), round(c, 6)) for a, b, c in cos if c >= threshold}
    return sums, pairs


@pytest.mark.parametrize("kind", ["loose", "tight"])
@pytest.mark.parametrize("make", [R.clustered, R.pack])
def test_same_rows_as_all_pairs(spark, kind, make):
    data = rows(kind)
    packed = make(spark.createDataFrame(data, SCHEMA).repartition(3), "paper", "item", "v", block=25)
    sums, pairs = brute(data, 0.92)
    got = {r.paper: (r.pairs, r.cosine_sum, r.near, r.cosine_max) for r in R.pair_sums(packed, "int", 0.92).collect() if r.paper is not None}
    assert got == {p: (n, pytest.approx(s, abs=1e-6), k, pytest.approx(m)) for p, (n, s, k, m) in sums.items()}
    near = [tuple(r) for r in R.near_pairs(packed, "int", 0.92).select("paper", "a", "b", F.round("cosine", 6)).collect()]
    assert sorted(near) == sorted(pairs) and (kind == "loose" or len(near) > 1000)


def test_block_pairs_fall_on_clustered_data(spark):
    """Of all pairs of blocks few can hold a near pair, where vectors come in clusters."""
    packed = R.clustered(spark.createDataFrame(rows("tight"), SCHEMA), "paper", "item", "v", block=25).where("paper = 0").cache()
    n = packed.count()
    blocks = R.summaries(packed, "int").select("paper", "block", "center", "radius", F.lit(0.92).alias("limit"))
    live = R.live_pairs(blocks, "int", group=5).count()
    assert n >= 16 and live < 0.25 * n * (n - 1) / 2
    assert R.live_pairs(blocks.withColumn("limit", F.lit(-2.0)), "int", group=5).count() == n * (n - 1) / 2  # each pair once, over all groups


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.pair_sums(R.clustered(none, "paper", "item", "v"), "int").count() == 0
    assert R.near_pairs(R.clustered(none, "paper", "item", "v"), "int").count() == 0
