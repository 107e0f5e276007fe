"""Periodic run detection (11): bit-parallel lags.

The words of a text get dense ids, and bit b of all ids is one big integer, a *plane* with one bit a word. For a lag q every
plane is XORed with itself shifted by q, and the results are ORed: a zero bit says that the words q apart are identical. A stretch
of z zeros is a stretch of z + q words with period q, so only stretches of max(least, times * q) - q zeros matter; ANDing the
complement with itself, shifted by 1, 2, 4, ..., leaves a bit exactly where such a stretch begins. Planes are added a few at a
time: further planes only add mismatches, so a lag without a long stretch of zeros so far is done.

Every lag that can have a run (q <= n / times) is tried in texts of up to `full` words. A longer text would cost the square of its
length, so there only lags are tried for which a necessary condition holds (`live_lags`); what is a run is decided by the planes
alone in both. Lags go up, and a stretch that a smaller lag found is skipped: two periods of one stretch at least four of them
long imply their greatest common divisor as a period (Fine and Wilf), so the smaller lag is its smallest period.

Every text is a row of its own: no exchange, and memory is that of one Arrow batch of whole texts.

Defined cases: a null text has no words, no runs and a null collapsed text; an empty one the same with an empty collapsed text;
rows that share an id, null ids and repeated rows are separate documents; an empty table gives no rows. Words are maximal runs of
characters other than space and U+0009 to U+000D, compared as they are. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string"
PLANES_AT_ONCE = 4
FULL = 1 << 14


def planes(ids: np.ndarray) -> list[int]:
    """Bit b of every id as one integer: bit i of plane b belongs to word i."""
    depth = max(1, int(ids.max()).bit_length()) if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(depth)]


def stretches(bits: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First place of each maximal stretch of ones, and one past its last."""
    flags = np.unpackbits(np.frombuffer(bits.to_bytes(-(-size // 8), "little"), np.uint8), bitorder="little")
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def long_zeros(mismatch: int, mask: int, least: int) -> int:
    """Bits where at least `least` zeros of `mismatch` begin, inside `mask`."""
    same = mask ^ (mismatch & mask)
    have = 1
    while same and have * 2 <= least:
        same &= same >> have
        have *= 2
    return same & (same >> (least - have)) if same and have < least else same


def live_lags(ids: np.ndarray, times: int) -> np.ndarray:
    """Lags up to n / times, without those that cannot be the smallest period of a run of `times` periods (at least four).

    A run of smallest period q, where Q <= q < 2Q and Q is a power of two, holds a window of 2Q words that begins at a multiple of
    Q and lies a whole period before the run's end; as the window is longer than the period and the period is the smallest, the next
    place where it occurs is q on. So a lag without such a window is none. Windows are compared by hash: one that agrees by chance only
    adds a lag to try.
    """
    found, n, q, now = [np.zeros(0, np.int64)], len(ids), 1, B.mix(ids.astype(np.uint64) + np.uint64(1))
    while q * times <= n:
        now = B.mix2(now[:-q], now[q:])  # hashes of all windows of 2q words
        order = np.argsort(now, kind="stable")
        again = now[order][1:] == now[order][:-1]
        at, on = order[:-1][again], order[1:][again]
        lag = (on - at)[at % q == 0]
        found.append(lag[(lag >= q) & (lag < 2 * q)])
        q *= 2
    lags = np.unique(np.concatenate(found))
    return lags[lags * times <= n]


def find_runs(ids: np.ndarray, least: int = 6, times: int = 4, full: int = FULL) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period: maximal stretches of smallest period q and length >= max(least, times * q)."""
    n = len(ids)
    if n < least:
        return []
    lags = range(1, n // times + 1) if n <= full else live_lags(ids, times).tolist()
    bits, out, seen = planes(ids), [], set()
    every = (1 << n) - 1
    for q in lags:
        zeros, mask, mismatch, left = max(least, times * q) - q, every >> q, 0, 0
        for lo in range(0, len(bits), PLANES_AT_ONCE):
            for plane in bits[lo : lo + PLANES_AT_ONCE]:
                mismatch |= plane ^ (plane >> q)
            left = long_zeros(mismatch, mask, zeros)
            if not left:
                break
        if left:
            for first, stop in zip(*(x.tolist() for x in stretches(left, n)), strict=True):
                run = (first, stop - 1 + zeros + q - first)  # the last bit begins the stretch's last `zeros` zeros
                if run not in seen:
                    seen.add(run)
                    out.append((*run, q))
    return sorted((start, length, q) for start, length, q in out)


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words without those a run holds after its first period, joined by one space."""
    if not runs:
        return " ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        step[start + q] += 1
        step[start + length] -= 1
    return " ".join(w for w, gone in zip(words, (np.cumsum(step)[:-1] > 0).tolist(), strict=True) if not gone)


def word_list(text: str) -> list[str]:
    return [w.decode() for w in text.encode().split()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4, full: int = FULL) -> DataFrame:
    """One row a document: n_words, its runs (word number, length, period; by start, then period) and its text with each run cut to its first period.

    A run is a maximal stretch of words with smallest period q and length >= max(least, times * q); times is at least four.
    """
    if times < 4:
        raise ValueError("times is at least four: below that, two periods of a stretch need not imply a smaller one")
    B.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, texts = [], [], []
            for text in batch["text"]:
                words = word_list(text.as_py() or "")
                names: dict[str, int] = {}
                ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
                runs = find_runs(ids, least, times, full)
                sizes.append(len(words))
                found.append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                texts.append(collapse(words, runs) if text.is_valid else None)
            yield pa.record_batch([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(B.quoted(id_col).cast("long").alias("doc_id"), B.quoted(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's test rows: with h = crc32 of the decimal id and g = h / 10, where h % 10 = 0, the words from a = g % n on repeat with
    period 1 + (n - a) / (3 + g % 8). Other rows, and rows without an id or words, stay as they are. Built-in functions only."""
    h = F.crc32(B.quoted(id_col).cast("long").cast("string").cast("binary"))
    words = F.filter(F.split(B.quoted(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select(B.quoted(id_col).cast("long").alias("doc_id"), B.quoted(text_col).cast("string").alias("text"), F.when(h % 10 == 0, words).alias("w"), (h / 10).cast("long").alias("g"))
    n = F.size("w").cast("long")
    chosen = chosen.withColumn("a", F.when(n > 0, F.col("g") % n))
    chosen = chosen.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int")))
    return chosen.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """The contract's columns of periodic_runs: the run of greatest length (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = rows.withColumn("best", best)
    length, period = -F.col("best.shorter"), F.col("best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")).cast("binary"), 256).alias("collapsed_sha256"),
    )
