"""N-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.ngram_join import deal, family_links, ngram_join, postings, row_ids


def brute(rows, share=80):
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def answers(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_tiny(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert answers(ngram_join(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def chained(n=60):
    rng, words = random.Random(3), [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(words))]
    for i in range(1, n):  # each copy drifts away from the one before
        words = list(words)
        words[rng.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(n, "Same few words"), (n + 1, "same FEW words"), (n + 2, "same few"), (n + 3, None), (n + 4, ""), (n + 5, " \t\n"), (n + 6, rows[0][1]), (n + 7, rows[0][1].upper())]
    return rows


def test_drift_and_awkward_rows(spark):
    rows = chained()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("*", "1 as rep", "2 as token", "3 as family")
    want = brute(rows)
    assert answers(ngram_join(docs)) == want
    assert answers(ngram_join(docs, task_shingles=300)) == want  # families in several chunks


def dealt(spark, prefixes, chunks):
    members = spark.createDataFrame([(i, 100 + i % 3, p) for i, p in enumerate(prefixes)], "rep long, n_shingles long, prefix array<long>")
    sizes = spark.createDataFrame([(0, chunks)], "family long, chunks long")
    near = members.selectExpr("rep", "n_shingles", "0L as family", "array_min(transform(prefix, t -> xxhash64(t))) as near")
    rows = deal(near, postings(members, 80), sizes, 1000).collect()
    at = {}
    for r in rows:
        assert r.own in (r.x, r.y) and r.x <= r.y
        at.setdefault(r.rep, set()).add((r.x, r.y))
    assert sum(map(len, at.values())) == len(rows)
    own = {r.rep: r.own for r in rows}
    for i, p in enumerate(prefixes):  # what shares an indexed shingle meets in the group of the two chunks
        for j in range(i):
            if set(p) & set(prefixes[j]):
                assert tuple(sorted((own[i], own[j]))) in at[i] & at[j]
    return at, own


def test_a_family_of_few_meetings_costs_its_meetings(spark):
    at, own = dealt(spark, [[i, i + 1] for i in range(400)], 60)  # one long chain; 60 chunks, all of one family
    assert len(set(own.values())) > 40
    assert max(map(len, at.values())) <= 3 and sum(map(len, at.values())) <= 3 * 400  # by pairs of chunks: 60 a set


def test_a_dense_family_is_dealt_evenly(spark):
    at, own = dealt(spark, [[7, 1000 + i] for i in range(300)], 30)
    held = np.bincount(list(own.values()), minlength=30)
    assert held.max() <= 5 * 300 / 30
    assert max(map(len, at.values())) <= 30


def test_empty(spark):
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_row_ids_never_repeat():
    blocks = [(task << 32) + serial for task in (0, 1, 4095, 4096, 4097, (1 << 23) - 1) for serial in (0, 1, (1 << 20) - 1)]
    all_ids = np.concatenate([row_ids(b, 3) for b in blocks])
    assert len(np.unique(all_ids)) == 3 * len(blocks) and all_ids.min() >= 0
    for block, n in [(1 << 55, 1), (1 << 20, 1), (0, (1 << 20) + 1)]:
        with pytest.raises(OverflowError):
            row_ids(block, n)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 40), st.integers(1, 12))
def test_family_links(seed, m, changes):
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 1 << 60, 60, dtype=np.uint64)
    sets = []
    for _ in range(m):
        s = base[rng.random(60) < 1 - changes / 60]
        sets.append(np.unique(np.concatenate([s, rng.integers(1, 1 << 60, rng.integers(0, changes + 1), dtype=np.uint64)])))
    root = family_links(np.array([len(s) for s in sets]), sets, 80)
    want = list(range(m))
    for i in range(m):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = want[i], want[j]
                want = [min(a, b) if w in (a, b) else w for w in want]
    assert len({*zip(root.tolist(), want)}) == len(set(want)) == len(set(root.tolist()))


def test_links_across_sides_only():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(1, 1 << 60, 100, dtype=np.uint64))
    sets, side = [base[:95], base[2:97], base[4:99], base[10:]], np.array([0, 0, 1, 0])
    assert len(set(family_links(np.array([len(s) for s in sets]), sets, 80, side).tolist())) == 1  # all through the third
    apart = family_links(np.array([len(s) for s in sets]), sets, 80, np.zeros(4, int))
    assert sorted(apart.tolist()) == [0, 1, 2, 3]
