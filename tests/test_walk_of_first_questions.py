"""The refiner's walk ranks a paper's first question only, and ranks are counted over ranges."""

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import vectors as R
from lectern.plans import vector_queries as Q


def test_only_first_questions_are_scored(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(i if i < 595 else 3, [float(x) for x in np.round(rng.normal(size=4), 1)], i % 2 if i < 590 else 2 + (i == 599)) for i in range(600)] + [(900, None, 0), (-7, None, 1)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    asked, scored = [], R.scored
    monkeypatch.setattr(R, "scored", lambda queries, *more: asked.append(queries.agg(F.sum(F.size("items"))).first()[0]) or scored(queries, *more))
    got = {(r.paper, r.query, r.rank): r.passage for r in Q.refiner_walk(spark, str(tmp_path)).collect()}
    want = {}
    for paper in range(4):
        own = [(i, np.array(v, np.float32).astype(float)) for i, v, p in data if p == paper and v is not None]
        first, most = min(i for i, _ in own), 6 * len({i for i, _ in own})
        pairs = sorted((-round(float(a @ b), 12), j) for i, a in own if i == first for j, b in own if j != first)
        want |= {(paper, first, n): j for n, (_, j) in enumerate(pairs, 1) if n <= most}
    assert got == want
    assert asked == [1 + 1 + 4 + 1]  # papers 2 and 3 hold id 3 four times and once: a row each, of some 600 questions
