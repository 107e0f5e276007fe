"""Best-fit packing (7): a grouping genetic algorithm on islands with elite migration.

Documents are tokenised once; a document longer than a sequence is cut so that only its first piece may be
shorter. Pieces are dealt to shards of bounded size, and a few islands evolve each shard independently: an
individual is an assignment of pieces to sequences; crossover injects whole well-filled sequences of one
parent into the other, takes the injected pieces out of the sequences they were in, dissolves those, and
best-fits what that displaced. After each epoch an island's elite migrates to the next island of its
shard, and the best island's packing wins. A shard wastes less than one sequence beyond its best packing, so shards cost less than
one sequence in some eight thousand.

Defined cases: a null or empty text is the end-of-text token alone; rows that share a doc_id are
separate documents (pieces are told apart by a row number); an empty table gives no rows; special-token strings
in a text are encoded as the tokenizer file says.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

PIECES = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
END = 0


@lru_cache(2)
def _encoder(path: str):
    """text -> ids of tokenizers' own encoding. Plain texts take the faster engine with the same ranks where it is beside."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    marks = [t.content for t in whole.get_added_tokens_decoder().values()]

    def slow(text: str) -> list[int]:
        return whole.encode(text, add_special_tokens=False).ids

    try:
        import public_tokenizers
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    except FileNotFoundError:
        return slow
    return lambda text: slow(text) if any(m in text for m in marks) else fast(text)


def pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """row_id, doc_id, piece, start, length, ids_crc32 of every piece."""
    B.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, serial = _encoder(tokenizer), B._task() << 36
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = array("I", encode(text or ""))
                ids.append(END)
                n, at, piece = len(ids), 0, 0
                while at < n:
                    size = n - at if n <= capacity else (n - at) % capacity or capacity
                    out.append((serial, doc_id, piece, at, size, zlib.crc32(memoryview(ids)[at : at + size])))
                    at, piece, serial = at + size, piece + 1, serial + 1
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row_id", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


class Gaps:
    """Open sequences by free space; finds the fullest one that still takes a piece."""

    def __init__(self, capacity: int):
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0

    def add(self, free: int, seq: int) -> None:
        if not self.by_free[free]:
            self.bits |= 1 << free
        self.by_free[free].append(seq)

    def take(self, size: int) -> tuple[int, int] | None:
        fits = self.bits >> size
        if not fits:
            return None
        free = size + (fits & -fits).bit_length() - 1
        seq = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        return free, seq


def best_fit(order: np.ndarray, sizes: np.ndarray, assign: np.ndarray, fill: np.ndarray, n_seq: int, capacity: int) -> tuple[np.ndarray, int]:
    """Place pieces in this order into the sequences with `fill` tokens (or new ones); updates assign in place."""
    gaps = Gaps(capacity)
    free = capacity - fill
    for seq in np.flatnonzero(free[:n_seq] > 0).tolist():
        gaps.add(int(free[seq]), seq)
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        got = gaps.take(size)
        if got is None:
            got = (capacity, n_seq)
            n_seq += 1
        left = got[0] - size
        assign[i] = got[1]
        if left:
            gaps.add(left, got[1])
    return assign, n_seq


def _fills(assign: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bincount(assign, weights=sizes).astype(np.int64)


def fitness(assign: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Falkenauer's mean squared fill of the sequences in use; higher is better and rewards full ones."""
    fill = _fills(assign, sizes)
    fill = fill[fill > 0]
    return float(np.mean((fill / capacity) ** 2)) - len(fill)


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """b with some well-filled sequences of a injected whole."""
    fill = _fills(a, sizes)
    full = np.flatnonzero(fill >= np.quantile(fill[fill > 0], 0.5))
    chosen = rng.choice(full, max(1, int(len(full) * rng.uniform(0.1, 0.4))), replace=False)
    injected = np.isin(a, chosen)
    broken = np.unique(b[injected])  # sequences of b that hold an injected piece are dissolved
    weak = np.flatnonzero(_fills(b, sizes) < capacity)
    broken = np.union1d(broken, rng.choice(weak, min(len(weak), 8), replace=False) if len(weak) else weak).astype(np.int64)
    displaced = np.flatnonzero(np.isin(b, broken) & ~injected)
    child = b.copy()
    child[injected] = a[injected] + (b.max() + 1)
    child[displaced] = -1
    placed = child >= 0
    names, dense = np.unique(child[placed], return_inverse=True)
    child[placed] = dense
    fill = np.bincount(dense, weights=sizes[placed], minlength=len(names)).astype(np.int64)
    order = displaced[np.lexsort((rng.random(len(displaced)), -sizes[displaced]))]
    return best_fit(order, sizes, child, fill, len(names), capacity)[0]


def evolve(sizes: np.ndarray, capacity: int, seed: int, elite: np.ndarray | None = None, population: int = 4, generations: int = 8) -> np.ndarray:
    """The best assignment found for these pieces; stops at the lower bound of sequences."""
    rng = np.random.default_rng(seed)
    bound = -(-int(sizes.sum()) // capacity)
    group = [] if elite is None else [elite]
    while len(group) < population:
        noise = 0 if not group else rng.normal(0, 4 * len(group), len(sizes))
        group.append(best_fit(np.argsort(-(sizes + noise), kind="stable"), sizes, np.full(len(sizes), -1), np.zeros(0, np.int64), 0, capacity)[0])
        if len(np.unique(group[-1])) == bound:
            return group[-1]
    score = [fitness(g, sizes, capacity) for g in group]
    for _ in range(generations):
        best = int(np.argmax(score))
        if len(np.unique(group[best])) == bound:
            break
        x, y = rng.choice(len(group), 2, replace=False)
        child = crossover(group[x], group[y], sizes, capacity, rng)
        value, worst = fitness(child, sizes, capacity), int(np.argmin(score))
        if value > score[worst]:
            group[worst], score[worst] = child, value
    return group[int(np.argmax(score))]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, shard_pieces: int = 16_384, islands: int = 2, epochs: int = 2) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    table = B.cut(pieces(docs, tokenizer, capacity))
    n_shards = max(1, -(-table.count() // shard_pieces))

    def bundle(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        rows = rows.drop_columns(["shard"]).sort_by("row_id").combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        return pa.table({"shard": pa.array([shard], pa.int64()), "body": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    shards = B.cut(table.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(n_shards))).groupBy("shard").applyInArrow(bundle, "shard long, body binary"))
    one = shards.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("elite", F.lit(None).cast("binary"))

    def epoch(round_: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    sizes = np.asarray(pa.ipc.open_stream(row["body"]).read_all()["length"].to_numpy())
                    loose = np.flatnonzero(sizes < capacity)  # full pieces are sequences already
                    elite = None if row["elite"] is None else np.frombuffer(row["elite"], np.int64)
                    best = evolve(sizes[loose], capacity, 1000 * round_ + row["island"], elite) if len(loose) else np.zeros(0, np.int64)
                    yield pa.record_batch(
                        [pa.array([row["shard"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([len(np.unique(best))], pa.int64()), pa.array([best.astype(np.int64).tobytes()], pa.binary())],
                        ["shard", "island", "sequences", "found"],
                    )

        return run

    state = one.repartition("shard", "island")
    for round_ in range(epochs):
        found = B.cut(state.mapInArrow(epoch(round_), "shard long, island int, sequences long, found binary"))
        if round_ + 1 < epochs:
            moved = found.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("found").alias("elite"))
            state = one.drop("elite").join(moved, ["shard", "island"])
    best = found.groupBy("shard").agg(F.min_by("found", F.struct("sequences", "island")).alias("found"))

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = pa.ipc.open_stream(row["body"]).read_all()
                sizes = np.asarray(rows["length"].to_numpy())
                seq = np.empty(len(sizes), np.int64)
                loose = sizes < capacity
                found = np.frombuffer(row["found"], np.int64)
                seq[loose] = found
                seq[~loose] = np.arange((~loose).sum()) + (found.max() + 1 if len(found) else 0)
                order = np.argsort(seq, kind="stable")
                total = np.cumsum(sizes[order]) - sizes[order]
                new = np.concatenate([[True], seq[order][1:] != seq[order][:-1]])
                offset = np.empty(len(sizes), np.int64)
                offset[order] = total - np.repeat(total[new], np.diff(np.concatenate([np.flatnonzero(new), [len(order)]])))
                out = rows.drop_columns(["row_id"]).append_column("sequence_id", pa.array((np.int64(row["shard"]) << np.int64(32)) + seq)).append_column("offset", pa.array(offset))
                yield from out.to_batches()

    return shards.join(best, "shard").mapInArrow(lay_out, PACKED)
