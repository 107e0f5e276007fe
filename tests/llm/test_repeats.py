"""Repeated-window operators against brute force over whole tables and over awkward rows."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import repeats as R
from lectern.llm.substring_dedup import longest_matches, parse, substring_dedup
from lectern.llm.suffix_dedup import radix_order, suffix_dedup

AWKWARD = [
    (5, "x" * 350), (1, "ab" * 120), (2, "x" * 350), (3, None), (4, ""), (6, "é" * 80 + "plain tail " * 30), (7, "é" * 80 + "other tail " * 30),
    (8, " ".join(f"w{i % 7}" for i in range(90))), (9, " ".join(f"w{i % 7}" for i in range(60)) + " end"), (10, "short"), (11, "short"),
    (12, " ".join(f"u{i}" for i in range(60))), (13, "lead " + " ".join(f"u{i}" for i in range(5, 40)) + " mid " + " ".join(f"u{i}" for i in range(30, 60))),
]


def brute(rows, split, join, length):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        tokens = split((text or "").encode())
        gone = [False] * len(tokens)
        for s in range(len(tokens) - length + 1):
            key = tuple(tokens[s : s + length]) if isinstance(tokens, list) else tokens[s : s + length]
            if key in seen:
                gone[s : s + length] = [True] * length
            seen.add(key)
        kept = join([t for t, g in zip(tokens, gone) if not g])
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(tokens), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def by_bytes(rows):
    return brute(rows, lambda b: b, bytes, 100)


def by_words(rows):
    return brute(rows, lambda b: b.split(), b" ".join, 20)


@pytest.fixture(params=["tiny", "awkward"])
def table(request, spark, tiny):
    if request.param == "tiny":
        return spark.read.parquet(f"{tiny}/documents.parquet")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    extra = ("block", "part", "body", "n_removed")
    return spark.createDataFrame(AWKWARD, schema).repartition(3).select("*", *(F.lit(None).cast("string").alias(c) for c in extra))


def test_suffix_dedup(table):
    want = by_bytes([(r.doc_id, r.text) for r in table.collect()])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(table).collect()}
    assert got == want


def test_suffix_dedup_on_more_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = by_bytes([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(docs).collect()} == want


def test_substring_dedup(table):
    want = by_words([(r.doc_id, r.text) for r in table.collect()])
    got = {r.doc_id: (r.n_words, r.n_removed, len(r.factors), r.kept_sha256) for r in substring_dedup(table).collect()}
    assert got == want


def test_shared_and_null_ids(spark):
    rows = [(None, "x" * 120), (1, "x" * 120), (1, "x" * 120), (None, None)]
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    want = [(True, 0, 0), (True, 120, 119), (False, 120, 120), (False, 120, 120)]
    assert sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in got) == sorted(want)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup(none).count() == 0
    assert substring_dedup(none).count() == 0


def boilerplate(n=150):
    """Many documents that share passages with varied text around them, so that one gram has very many contexts."""
    rng = random.Random(7)
    passages = [" ".join(f"p{i}w{j}" for j in range(size)) for i, size in enumerate((14, 19, 20, 26, 45))]
    some = lambda k: " ".join(f"{rng.choice('abcdef')}{rng.randrange(10_000)}" for _ in range(k))
    rows = [(i, f"{some(rng.randrange(30))} {passages[i % 5]} {some(rng.randrange(30))} {passages[(i * 7) % 5]}") for i in range(n)]
    return rows + [(n + i, rows[i * 3][1]) for i in range(20)]


@pytest.mark.parametrize("hot", [1, 20, 1 << 17])
@pytest.mark.parametrize("partitions", [1, 5])
def test_hot_grams(spark, hot, partitions):
    rows = boilerplate()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    assert {r.doc_id: (r.n_words, r.n_removed, len(r.factors), r.kept_sha256) for r in substring_dedup(df, hot=hot).collect()} == by_words(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, hot=hot).collect()} == by_bytes(rows)


@pytest.mark.parametrize("hot", [1, 1 << 17])
def test_parse_copies_its_references(spark, tiny, hot):
    """Every factor is a copy of earlier words, and as the parse is greedy, no factor could have begun with its reference any longer in one piece."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()] + [(10_000 + i, t) for i, t in boilerplate(60)]
    words = {i: (t or "").split() for i, t in rows}
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot).collect()
    assert sum(len(r.parse) for r in got) > 50
    for r in got:
        covered = set()
        for f in r.parse:
            size = f.word_end - f.word_start
            assert size >= 20 and (f.ref_doc, f.ref_word) < (r.doc_id, f.word_start)
            assert words[r.doc_id][f.word_start : f.word_end] == words[f.ref_doc][f.ref_word : f.ref_word + size]
            covered |= set(range(f.word_start, f.word_end))
        assert covered == {i for s in r.factors for i in range(s.word_start, s.word_end)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=3, max_size=14), min_size=1, max_size=8))
def test_greedy_parse(stretches):
    """Longest earlier matches, and the factors a plain left-to-right parse takes."""
    tokens = np.array([t for s in stretches for t in s], np.uint64)
    stop = np.cumsum([len(s) for s in stretches])
    begin = stop - [len(s) for s in stretches]
    end = np.repeat(stop, stop - begin)

    def match(p, q):
        n = 0
        while p + n < end[p] and q + n < end[q] and tokens[p + n] == tokens[q + n]:
            n += 1
        return n

    want = [max((match(p, q) for q in range(p)), default=0) for p in range(len(tokens))]
    length, source = longest_matches(tokens, begin, stop, 3)
    assert length.tolist() == [n if n >= 3 else 0 for n in want]
    assert all(q < p and match(p, q) == n for p, (n, q) in enumerate(zip(length, source)) if n)
    plain = []
    for i in range(len(stretches)):
        p = begin[i]
        while p < stop[i]:
            if length[p]:
                plain.append((i, p, length[p]))
                p += length[p] - 2
            else:
                p += 1
    who, at, size, _ = parse(tokens, begin, stop, 3)
    assert sorted(zip(who.tolist(), at.tolist(), size.tolist())) == plain


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=30, max_size=300), st.integers(1, 30), st.integers(1, 3))
def test_radix_order(data, depth, letters):
    """The order is that of the bytes themselves, and ties are exactly equal prefixes."""
    raw = np.frombuffer(data, np.uint8) % letters + 200
    starts = np.arange(len(raw) - depth + 1)[::-1].copy()
    order, tied = radix_order(raw, starts, depth)
    text = [raw[s : s + depth].tobytes() for s in starts[order]]
    assert text == sorted(text) and sorted(order) == list(range(len(starts)))
    assert tied.tolist() == [i > 0 and text[i] == text[i - 1] for i in range(len(text))]


def test_anchors_alone_decide_nothing_open():
    """Open units are left to the methods: the shared pass only finds copies of whole contexts and k-grams that stand alone."""
    arrays = lambda gram, context, doc: [np.array(gram, np.uint64), np.array(context, np.uint64), np.zeros(len(doc), np.uint32), np.array(doc, np.int64), np.zeros(len(doc), np.uint32), np.ones(len(doc), np.uint32)]
    one, two = R._settle_anchors(1 << 17)([arrays([1, 2, 3], [7, 7, 7], [5, 5, 5]), arrays([2, 3], [7, 8], [4, 9])])
    assert one[0].tolist() == [R.CLEAN, R.REPEATED, R.OPEN] and one[1].tolist() == [4]
    assert two[0].tolist() == [R.CLEAN, R.OPEN]


@pytest.mark.parametrize("hot", [1, 1 << 17])
def test_very_many_contexts_of_one_gram(spark, hot):
    """200,000 texts around one passage: no two share a window, so nothing may go, however many contexts the passage has."""
    rng = random.Random(11)
    gram = "".join(rng.choice("abcdefghij") for _ in range(32))
    side = lambda: "".join(rng.choices("klmnopqrstuvwxyz0123456789", k=68))
    df = spark.createDataFrame([(i, side() + gram + side()) for i in range(200_000)], "doc_id long, text string").repartition(8)
    assert suffix_dedup(df, with_text=False, hot=hot).where("n_removed > 0").count() == 0
    middle = " ".join(f"g{i}" for i in range(10))
    words = lambda: " ".join(f"{x:x}" for x in rng.choices(range(1 << 30), k=10))
    df = spark.createDataFrame([(i, f"{words()} {middle} {words()}") for i in range(60_000)], "doc_id long, text string").repartition(8)
    assert substring_dedup(df, with_text=False, hot=hot).where("n_removed > 0").count() == 0


def test_contexts_are_told_apart_by_96_bits():
    """Contexts that agree in 64 bits, or in the other 32, are two."""
    entry = lambda one, two, doc: [np.array([1], np.uint64), np.array([one], np.uint64), np.array([two], np.uint32), np.array([doc], np.int64), np.zeros(1, np.uint32), np.ones(1, np.uint32)]
    settle = R._settle_anchors(1 << 17)
    for one, two in ((7, 8), (8, 7)):
        assert [r[0].tolist() for r in settle([entry(7, 7, 1), entry(one, two, 2)])] == [[R.OPEN], [R.OPEN]]
    assert [r and r[0].tolist() for r in settle([entry(7, 7, 1), entry(7, 7, 2)])] == [None, [R.REPEATED]]


def test_a_text_of_several_blocks(spark):
    """One text longer than a block, whose second half repeats the first."""
    rng = random.Random(5)
    half = " ".join(f"w{rng.randrange(1 << 30):x}" for _ in range(160_000))
    rows = [(1, half + " " + half), (2, half[:5000]), (3, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(df, with_text=False).collect()}
    assert got == {1: (320_000, 160_000), 2: (len(half[:5000].split()), len(half[:5000].split()) - (half[4999] != " " and half[5000] != " ")), 3: (1, 0)}
    size = len(half)
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup(df, with_text=False).collect()}
    assert got[2] == (5000, 5000) and got[3] == (5, 0)
    assert got[1][0] == 2 * size + 1 and size <= got[1][1] <= size + 1
