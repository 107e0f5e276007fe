"""Packed blocks of documents, and the block <-> key-range exchange the text operators share.

A *block* is one row holding a few megabytes of documents as a compressed Arrow stream. It is written once
to the shared checkpoint folder, so its id and the order of its documents are facts that later jobs (and
retries after a lost executor) can rely on. Operators then run the same round trip as often as they need:

    scatter   each block emits, for every key range, one payload with the keys it holds (one entry per
              distinct key and block, so that a key in a third of all rows costs one entry a block);
    resolve   each key range sees all blocks' payloads and decides about its keys;
    gather    each block gets its decisions back, in the order in which it emitted the keys.

Rows on the wire are payloads, not keys, so the JVM moves a few large rows instead of billions of small ones.
"""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# blocks and key ranges grow with the table, as messages are at most blocks x ranges (and never more than entries)
BLOCK_BYTES, MOST_BLOCK_BYTES = 2 << 20, 16 << 20
RANGE_BYTES, MOST_RANGE_BYTES = 16 << 20, 256 << 20
TASK_BYTES = 128 << 20
NO_ID = np.iinfo(np.int64).min
BLOCK_SCHEMA = "block long, n_docs int, n_bytes long, body binary"
MESSAGE_SCHEMA = "part int, block long, body binary"


# Workers live on between stages; large arrays go back to the system when they are freed, not into the next stage's footprint.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what a Python worker holds: one Arrow batch of whole texts, and freed memory it would keep."""
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):  # wherever the driver was started, workers can import the package
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    environment.update({k: v for k, v in WORKER_MEMORY.items() if k not in environment})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_folder(spark: SparkSession) -> None:
    """Use the checkpoint folder the cluster names; only a local master (tests) may go without and get one."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("name a shared folder in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and go on from there, so lost executors cost no recomputation."""
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint()
    # what earlier passes shuffled is garbage now; let the cleaner free its disk before the next pass fills more
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def plan_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate of a table's size; None where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def few_files(df: DataFrame, size: int | None = None) -> DataFrame:
    """Fewer, fuller partitions before a write: about TASK_BYTES each, never fewer than keep all cores busy. size: bytes, where known better than by the optimizer."""
    size = plan_bytes(df) if size is None else size
    return df if size is None else df.coalesce(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _task() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def encode_docs(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def decode_docs(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, null flags, n+1 byte offsets and all bytes of the block's documents."""
    table = pa.ipc.open_stream(body).read_all().combine_chunks()
    ids = np.asarray(table["doc_id"].fill_null(NO_ID).to_numpy())
    column = table["body"]
    column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_binary())
    missing = np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
    _, offsets, data = column.buffers() if len(column) else (None, None, None)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return ids, missing, at - at[0], raw


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of (id, UTF-8 text, carried columns as x_0, x_1, ...), ordered by id inside a block; null ids first, null texts kept as null."""
    small_batches(docs.sparkSession)
    source = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("binary").alias("body"), *[quoted(c).alias(f"x_{i}") for i, c in enumerate(carry)])
    block_bytes = block_bytes or min(MOST_BLOCK_BYTES, max(BLOCK_BYTES, (plan_bytes(source) or 0) >> 14))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, held, size = _task(), 0, [], 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            t = t.set_column(1, "body", t["body"].cast(pa.large_binary())).sort_by([("doc_id", "ascending")])
            nulls = t.filter(t["doc_id"].is_null())
            t = pa.concat_tables([nulls, t.filter(t["doc_id"].is_valid())]).combine_chunks()
            return pa.record_batch(
                [pa.array([(task << 32) + serial], pa.int64()), pa.array([t.num_rows], pa.int32()), pa.array([size], pa.int64()), pa.array([encode_docs(t)], pa.binary())],
                ["block", "n_docs", "n_bytes", "body"],
            )

        for batch in batches:
            # a batch of long texts is cut so that a block stays near its size
            step = max(1, int(batch.num_rows * block_bytes / max(1, batch.nbytes)))
            for lo in range(0, batch.num_rows, step):
                piece = batch.slice(lo, step)
                held.append(piece)
                size += piece.nbytes
                if size >= block_bytes:
                    yield flush()
                    serial, held, size = serial + 1, [], 0
        if held:
            yield flush()

    return cut(few_files(source).mapInArrow(pack, BLOCK_SCHEMA))


def ranges(blocks: DataFrame) -> int:
    """How many key ranges keep one range's payloads near RANGE_BYTES of text (more for very large tables), and all cores busy."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    size = min(MOST_RANGE_BYTES, max(RANGE_BYTES, total >> 12))
    return max(2 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // size))


def carried(body: bytes) -> pa.Table:
    """The carried columns of a block's documents, in their order."""
    table = pa.ipc.open_stream(body).read_all()
    return table.select([n for n in table.column_names if n.startswith("x_")])


_squeeze, _unsqueeze = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Little arrays as one compressed payload."""
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return _squeeze.compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack_arrays(body: bytes, *kinds: type) -> list[np.ndarray]:
    raw = _unsqueeze.decompress(body)
    at, out = 8 * len(kinds), []
    for kind, n in zip(kinds, np.frombuffer(raw, np.int64, len(kinds)).tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key range that has entries, with its entries in their order."""
    order = np.argsort(part, kind="stable")
    sorted_ = part[order]
    begin = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])[: len(part)])
    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(part)], strict=False):
        yield int(sorted_[lo]), order[lo:hi]


def messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, block, body = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(body, pa.binary())], ["part", "block", "body"])


def scatter(blocks: DataFrame, emit: Callable[[int, bytes], list[tuple[int, int, bytes]]]) -> DataFrame:
    """Run emit(block id, body) -> [(part, block, payload)] on each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch["block"].to_pylist(), batch["body"], strict=True):
                yield messages(emit(block, body.as_py()))

    return blocks.select("block", "body").mapInArrow(run, MESSAGE_SCHEMA)


def resolve(sent: DataFrame, decide: Callable[[int, list[int], list[bytes]], list[tuple[int, int, bytes]]]) -> DataFrame:
    """Run decide(part, blocks, payloads) -> [(part, block, reply)] on each key range."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = np.argsort(np.asarray(table["block"].to_numpy()), kind="stable")
        blocks, bodies = table["block"].to_pylist(), table["body"]
        part = table["part"][0].as_py()
        return pa.Table.from_batches([messages(decide(part, [blocks[i] for i in order], [bodies[int(i)].as_py() for i in order]))])

    return sent.groupBy("part").applyInArrow(run, MESSAGE_SCHEMA)


def gather(blocks: DataFrame, replies: DataFrame, apply: Callable[[int, bytes, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """Run apply(block, body, {part: reply}) on each block together with all replies to it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # a reply without a block cannot happen; an empty answer keeps the schema
            return apply(0, None, {})
        return apply(left["block"][0].as_py(), left["body"][0].as_py(), dict(zip(right["part"].to_pylist(), right["body"].to_pylist(), strict=True)))

    own = blocks.select("block", "body")
    return own.groupBy("block").cogroup(replies.select("block", "part", "body").groupBy("block")).applyInArrow(run, schema)


_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


_STRIPE = 1 << 15  # arrays are hashed in stripes that stay in the cache


def mix(a: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser on a whole array."""
    out, spare = np.empty(len(a), np.uint64), np.empty(min(len(a), _STRIPE), np.uint64)
    for lo in range(0, len(a), _STRIPE):
        x, o = a[lo : lo + _STRIPE], out[lo : lo + _STRIPE]
        t = spare[: len(x)]
        np.right_shift(x, np.uint64(32), out=t)
        np.bitwise_xor(x, t, out=o)
        o *= _C3
        np.right_shift(o, np.uint64(29), out=t)
        o ^= t
        o *= _C1
        np.right_shift(o, np.uint64(32), out=t)
        o ^= t
    return out


def mix2(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """An ordered, non-linear combination of two hash arrays; into `out` if given, which neither may share."""
    n = len(a)
    out = np.empty(n, np.uint64) if out is None else out[:n]
    spare = np.empty(min(n, _STRIPE), np.uint64)
    for lo in range(0, n, _STRIPE):
        x, y, o = a[lo : lo + _STRIPE], b[lo : lo + _STRIPE], out[lo : lo + _STRIPE]
        t = spare[: len(x)]
        np.multiply(x, _C1, out=o)
        np.right_shift(o, np.uint64(31), out=t)
        o ^= t
        o += y
        o *= _C2
        np.right_shift(o, np.uint64(29), out=t)
        o ^= t
    return out


def half_hash(tokens: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """Hash of every run of the largest power of two up to `length`, and how far on the run that completes `length` starts."""
    have, now, free = 1, tokens, None
    while have * 2 <= length:
        now, free = mix2(now[:-have], now[have:], free), (now if have > 1 else np.empty(len(tokens), np.uint64))
        have *= 2
    return now, length - have


def window_hash(tokens: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` tokens, by combining halves: log2(length) passes, no rolling polynomial."""
    n = len(tokens) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    now, shift = half_hash(tokens, length)
    return (mix2(now[:n], now[shift : shift + n]) if shift else now)[:n]


class WordHash(dict):
    """Word bytes -> 64-bit hash, remembered for the words a worker meets most recently."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHash()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def split_words(raw: np.ndarray, at: np.ndarray, lower: bool = False) -> list[list[bytes]]:
    """Words of each document: maximal runs of bytes other than 0x09-0x0D and 0x20; lower also lowers A-Z."""
    data = raw.tobytes()
    pieces = (data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    return [(p.lower() if lower else p).split() for p in pieces]
