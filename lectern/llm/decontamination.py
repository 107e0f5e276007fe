"""Benchmark decontamination (10): latent semantic retrieval, then subsequence and answer checks.

1. Statistics. Document frequencies of the benchmark's words are counted over all documents, in one scan for SCAN_BLOCKS blocks of
   passages; a block has at most 1,000 passages and BLOCK_WORDS words, which bounds its model, and one more scan searches for all of them.
2. Latent space. The benchmark passages' TF-IDF matrix A gets a distributed randomised SVD: every partition
   returns its part of A^T (A Omega) for a few power rounds, and of (A Q)^T (A Q); only words-by-rank matrices
   reach the driver. Words outside the benchmark have no place in that row space and project to zero.
3. Candidates. Windows of every whole document, of a length for each passage's, are projected (sums of word
   vectors) and compared with all passages by one matrix product; cosine >= `cosine` makes a candidate pair. A
   passage's heavy words are its words of highest IDF that carry 1 - `mass` / 2 of it. A window is projected only
   if some passage's heavy words there carry what its other words must leave open for `mass` of the whole. A pair
   that passes step 4 always has that, so the filter loses nothing; no number of candidates is capped.
4. Decision. The longest common subsequence of the passage and the window's words (bit-parallel) must cover
   `share` of the passage; or `loose` of it while its answer (the last sentence) is there in order as well, which
   catches paraphrases; the matched words must carry `mass` of the passage's IDF.

Defined cases: null or wordless texts and passages match nothing; a passage under `least_words` words counts only
verbatim; equal passages and equal documents each get their own pairs; empty tables give no rows; rows with
a null id keep it; of a passage that a document holds more than once the best window is reported.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import small_batches

_marks = bytes(ord(" ") if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" or i < 32 else i for i in range(256))
_sentence = re.compile(r"(?<=[.!?])\s+")
LEAKS = "doc_id long, item_id long, word_start long, word_end long, cosine double, lcs double, kind string"


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "replace").translate(_marks).split()


def lcs_length(pattern: dict[bytes, int], size: int, words: list[bytes]) -> int:
    """Longest common subsequence of a pattern (word -> positions as bits) and words, one integer step a word."""
    state = (1 << size) - 1
    full = state
    for w in words:
        match = state & pattern.get(w, 0)
        state = ((state + match) | (state - match)) & full
    return size - state.bit_count()


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    bits: dict[bytes, int]
    answer: list[bytes]
    answer_bits: dict[bytes, int]
    mass: float = 0.0


def _bits(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def make_item(item_id: int, text: str) -> Item:
    words = words_of(text)
    parts = [p for p in (words_of(s) for s in _sentence.split(text or "")) if len(p) >= 2]
    answer = parts[-1] if parts else words
    return Item(item_id, words, _bits(words), answer, _bits(answer))


@dataclass
class Model:
    items: list[Item]
    index: dict[bytes, int]
    idf: np.ndarray
    vectors: np.ndarray  # word -> latent vector, times its idf
    latent: np.ndarray  # passages, unit length
    first: np.ndarray  # word -> where its passages begin in `posts`; two more entries, for no word
    posts: np.ndarray  # passages of which a word is heavy
    need: np.ndarray  # heavy mass a window must have for the passage
    size: np.ndarray  # window length for the passage
    params: dict


def randomized_svd(rows: DataFrame, n_words: int, rank: int, n_partitions: int, rounds: int = 2) -> np.ndarray:
    """Right singular vectors (n_words x rank) of the TF-IDF rows (w array<int>, x array<double>)."""
    rows = rows.repartition(n_partitions).cache()

    def partial(matrix: np.ndarray, small: bool) -> np.ndarray:
        shipped = rows.sparkSession.sparkContext.broadcast(matrix)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, total = shipped.value, None
            for batch in batches:
                for w, x in zip(batch["w"], batch["x"], strict=True):
                    w, x = np.asarray(w.values), np.asarray(x.values)
                    y = x @ m[w]
                    if total is None:
                        total = np.zeros((m.shape[1],) * 2 if small else m.shape)
                    if small:
                        total += np.outer(y, y)
                    else:
                        total[w] += np.outer(x, y)
            if total is not None:
                yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["m"])

        got = [np.frombuffer(r.m) for r in rows.mapInArrow(run, "m binary").toLocalIterator()]
        shipped.unpersist()
        return np.sum(got, 0).reshape((matrix.shape[1],) * 2 if small else matrix.shape)

    q = np.random.default_rng(10).standard_normal((n_words, rank))
    for _ in range(rounds):
        q = np.linalg.qr(partial(q, False))[0]
    value, vector = np.linalg.eigh(partial(q, True))
    rows.unpersist()
    return q @ vector[:, ::-1]


def count_words(docs: DataFrame, words: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each of these words is, and how many documents there are."""
    order = sorted(words)
    shipped = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(order)})  # words of a bounded number of bounded blocks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, n = shipped.value, np.zeros(len(shipped.value), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch["text"].to_pylist():
                hit = known.keys() & set(words_of(text)) if text else ()
                if hit:
                    total[[known[w] for w in hit]] += 1
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array([-1, *used.tolist()], pa.int64()), pa.array([n, *total[used].tolist()], pa.int64())], ["w", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    shipped.unpersist()
    return {order[r.w]: r.n for r in counts if r.w >= 0}, max([1, *[r.n for r in counts if r.w < 0]])  # one row a benchmark word


def fit(spark: SparkSession, items: list[Item], found: dict[bytes, int], n_docs: int, rank: int, params: dict) -> Model:
    """Build the latent space of the items from their words' document frequencies."""
    index = {w: i for i, w in enumerate(sorted({w for item in items for w in item.words}))}
    df = np.array([found.get(w, 0) for w in index], float)
    idf = np.log((n_docs + 1) / (df + 1)) + 0.01
    rows = []
    for item in items:
        tf = Counter(index[w] for w in item.words)
        item.mass = float(idf[[index[w] for w in item.words]].sum())
        w = sorted(tf)
        x = np.array([tf[i] for i in w]) * idf[w]
        rows.append((w, (x / np.linalg.norm(x)).tolist()))
    table = spark.createDataFrame(rows, "w array<int>, x array<double>")
    basis = randomized_svd(table, len(index), min(rank, len(items), len(index)), max(1, len(items) // 256))
    vectors = (basis * idf[:, None]).astype(np.float32)
    latent = np.stack([vectors[[index[w] for w in item.words]].sum(0) for item in items])
    latent /= np.maximum(1e-9, np.linalg.norm(latent, axis=1, keepdims=True))
    posts: list[list[int]] = [[] for _ in index]
    need, size = np.zeros(len(items)), np.zeros(len(items), np.int64)
    for j, item in enumerate(items):
        weights = Counter(item.words)
        heavy = 0.0
        for w in sorted(weights, key=lambda w: (-idf[index[w]], w)):
            posts[index[w]].append(j)
            heavy += weights[w] * idf[index[w]]
            if heavy >= (1 - params["mass"] / 2) * item.mass:
                break
        need[j] = params["mass"] * item.mass - (item.mass - heavy) - 1e-6 * item.mass
        size[j] = 8
        while size[j] < 1.25 * len(item.words):  # lengths grow by a half; a window holds its passage a quarter longer
            size[j] = size[j] * 3 // 2
    first = np.concatenate([[0], np.cumsum([len(x) for x in posts])])
    return Model(items, index, np.append(idf, 0).astype(np.float32), vectors, latent.astype(np.float32), np.append(first, first[-1]), np.concatenate(posts).astype(np.int64), need, size, params)


def _starts(index: np.ndarray, model: Model) -> dict[int, np.ndarray]:
    """Window length -> starts of the windows that have enough heavy mass of some passage of that length."""
    count = model.first[index + 1] - model.first[index]
    count[index < 0] = 0
    at = np.flatnonzero(count)
    if not len(at):
        return {}
    n = count[at]
    where = np.repeat(model.first[index[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    item, pos = model.posts[where], np.repeat(at, n)
    order = np.argsort(item, kind="stable")
    item, pos = item[order], pos[order]
    key = item * (len(index) + 1) + pos
    total = np.concatenate([[0], np.cumsum(model.idf[index[pos]], dtype=np.float64)])
    out: dict[int, np.ndarray] = {}
    for stretch in (2, 3):  # windows of the passage's length, and half as long again for passages with insertions
        size = model.size[item] * stretch // 2
        stop = np.searchsorted(key, item * (len(index) + 1) + np.minimum(pos + size + 2 * (size // 4), len(index)))
        good = total[stop] - total[:-1] >= model.need[item]
        for length in np.unique(size[good]).tolist():
            step = max(1, length // 6)
            anchor = pos[good & (size == length)]
            last = max(0, -(-(len(index) - length) // step))
            mark = np.zeros(last + 2, np.int32)
            lo = np.maximum(0, -(-(anchor - length - length // 4) // step))
            hi = np.minimum(last, (anchor + length // 4) // step)
            np.add.at(mark, np.minimum(lo, last), 1)
            np.add.at(mark, hi + 1, -1)
            start = np.flatnonzero(np.cumsum(mark)[: last + 1] > 0) * step
            out[length] = np.union1d(out[length], start) if length in out else start
    return out


def scan_each(text: str | None, models: list[Model]) -> Iterator[list]:
    """The leaks of one whole text by each model in turn; its words are cut once."""
    words = words_of(text)
    return (scan(words, model) for model in models)


def scan_all(text: str | None, models: list[Model]) -> list:
    return [hit for hits in scan_each(text, models) for hit in hits]


def scan(words: list[bytes], model: Model) -> list[tuple[int, int, int, float, float, str]]:
    """(item, first word, last word + 1, cosine, lcs share, kind) of the leaks in one whole text; best window an item."""
    if not words or not model.items:
        return []
    p = model.params
    index = np.fromiter(map(model.index.get, words, repeat(-1)), np.int64, len(words))
    best: dict[int, tuple] = {}
    for size, start in _starts(index, model).items():
        stop = np.minimum(len(words), start + size)
        for lo in range(0, len(start), 512):
            a, b = start[lo : lo + 512], stop[lo : lo + 512]
            known = [index[x:y][index[x:y] >= 0] for x, y in zip(a, b, strict=True)]
            some = np.array([len(k) > 0 for k in known], bool)
            if not some.any():
                continue
            a, b, known = a[some], b[some], [k for k in known if len(k)]
            ends = np.cumsum([len(k) for k in known])
            flat = model.vectors[np.concatenate(known)]
            v = np.add.reduceat(flat, ends - [len(k) for k in known], axis=0)
            v /= np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
            near = v @ model.latent.T
            for i, j in zip(*np.nonzero(near >= p["cosine"]), strict=True):
                item = model.items[j]
                got = _judge(item, words[max(0, a[i] - size // 4) : b[i] + size // 4], model)
                if got and (j not in best or (got[0], near[i, j]) > (best[j][3], best[j][2])):
                    best[j] = (int(a[i]), int(b[i]), float(near[i, j]), *got)
    return [(model.items[j].item_id, *x) for j, x in sorted(best.items())]


def _judge(item: Item, window: list[bytes], model: Model) -> tuple[float, str] | None:
    n, p = len(item.words), model.params
    common = Counter(item.words) & Counter(window)
    carried = sum(model.idf[model.index[w]] * c for w, c in common.items())
    if carried < p["mass"] * item.mass:
        return None
    if n < p["least_words"]:
        text, part = b" ".join(window), b" ".join(item.words)
        return (1.0, "verbatim") if b" " + part + b" " in b" " + text + b" " else None
    share = lcs_length(item.bits, n, window) / n
    if share >= p["share"]:
        return share, "verbatim" if share >= 0.95 else "edited"
    if share >= p["loose"] and lcs_length(item.answer_bits, len(item.answer), window) >= p["answer"] * len(item.answer):
        return share, "paraphrase"
    return None


PARAMS = {"cosine": 0.5, "share": 0.6, "loose": 0.45, "answer": 0.8, "mass": 0.5, "least_words": 8}


BLOCK_WORDS = 1 << 17
SCAN_BLOCKS = 8


def item_blocks(benchmark: DataFrame, size: int = 1000, words: int = BLOCK_WORDS) -> Iterator[list[Item]]:
    """The passages in blocks of at most `size` passages and about `words` words, so that what is broadcast at once is bounded."""
    held: list[Item] = []
    total = 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        item = make_item(row.item_id, row.text or "")
        if item.words:
            held.append(item)
            total += len(item.words)
        if len(held) >= size or total >= words:
            yield held
            held, total = [], 0
    if held:
        yield held


def _models(docs: DataFrame, benchmark: DataFrame, rank: int, changes: dict, block: int, scan_blocks: int) -> Iterator:
    """Broadcast lists of models, one list a scan; what a list holds is bounded by its blocks."""
    spark = docs.sparkSession
    small_batches(spark)
    blocks = item_blocks(benchmark, block)
    while group := list(islice(blocks, scan_blocks)):
        found, n_docs = count_words(docs, {w for items in group for item in items for w in item.words})
        yield spark.sparkContext.broadcast([fit(spark, items, found, n_docs, rank, PARAMS | changes) for items in group])


def decontaminate(docs: DataFrame, benchmark: DataFrame, rank: int = 128, block: int = 1000, scan_blocks: int = SCAN_BLOCKS, **changes: float) -> DataFrame:
    """One row a leaked (document, passage) pair: its best window, how similar, and of what kind."""
    out = None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for shipped in _models(docs, benchmark, rank, changes, block, scan_blocks):

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(doc_id, *hit) for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for hit in scan_all(text, shipped.value)]
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "word_start", "word_end", "cosine", "lcs", "kind"])

        part = texts.mapInArrow(run, LEAKS)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], LEAKS)


def _has_leak(shipped):
    """A column function: whether a text holds a passage of these blocks."""

    @F.pandas_udf("boolean")
    def leaks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: any(scan_each(t if isinstance(t, str) else None, shipped.value))).astype(bool)

    return leaks


def without_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 128, block: int = 1000, scan_blocks: int = SCAN_BLOCKS, **changes: float) -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark passage."""
    kept = docs
    for shipped in _models(docs, benchmark, rank, changes, block, scan_blocks):
        kept = kept.where(~_has_leak(shipped)(F.col("text")))
    return kept
