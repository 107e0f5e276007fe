"""Periodic runs against brute force: on toy sequences, on a whole small table, and on awkward rows."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import periodic_runs as R
from lectern.llm.queries import op11_periodic_runs

EMPTY = hashlib.sha256(b"").hexdigest()


def brute(words, least=6, times=4):
    """Every maximal stretch of every lag whose smallest period is that lag, word by word."""
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                part = words[i : j + q]
                if next(p for p in range(1, q + 1) if part[p:] == part[: len(part) - p]) == q:
                    found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found)


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 9), st.integers(1, 5))
def test_runs(body, period, copies):
    """Texts with and without planted repeats, with all lags and with the live ones only."""
    words = body + body[:period] * copies + body[::-1]
    ids = np.array(words, np.int64)
    assert R.find_runs(ids) == R.find_runs(ids, full=0) == brute(words)


@pytest.mark.parametrize("letters", [1, 3, 5000])
def test_long_texts(letters):
    """Beyond `full` words only live lags are tried: the same runs, and time that does not grow with the square."""
    rng = random.Random(letters)
    words = [rng.randrange(letters) for _ in range(3000)]
    words[700:] = [words[700 + i % 310] for i in range(2300)]
    ids = np.array(words, np.int64)
    assert R.find_runs(ids, full=0) == R.find_runs(ids) == brute(words)
    ids = np.random.default_rng(0).integers(0, 50_000, 200_000)
    ids[50_000:] = ids[50_000 + np.arange(150_000) % 30_000]
    began = time.time()
    assert (50_000, 150_000, 30_000) in R.find_runs(ids)
    assert time.time() - began < 20


def test_query(spark, tiny):
    """The query on the whole small table; some documents do get a planted run."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in op11_periodic_runs(spark, tiny).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    assert got == {expected(*r) for r in docs}
    assert sum(r[1] > 0 for r in got) > 10


def test_awkward_rows(spark):
    same = " ".join(["a b c"] * 9)
    rows = [(None, same), (1, None), (2, ""), (3, " \t\n"), (4, "x " * 2_000), (5, same), (5, same), (11, "é é " * 7), (12, "a\x0bb\x1cb"), (13, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as runs", "2 as w", "3 as a", "4 as p", "5 as g").repartition(3)
    got = sorted((tuple(r) for r in R.digests(R.periodic_runs(R.with_planted_runs(df))).collect()), key=str)
    assert got == sorted((expected(*r) if r[0] is not None else (None, *expected(5, same)[1:]) for r in rows), key=str)
    plain = {(r.doc_id, r.n_words, len(r.runs), r.collapsed) for r in R.periodic_runs(df).collect()}
    assert {(1, 0, 0, None), (2, 0, 0, ""), (4, 2_000, 1, "x"), (5, 27, 1, "a b c")} <= plain
    none = R.digests(R.periodic_runs(R.with_planted_runs(df.limit(0)))).collect()
    assert none == []
    with pytest.raises(ValueError):
        R.periodic_runs(df, times=2)
