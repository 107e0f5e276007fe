"""Cross-tokenizer alignment (12): which tokens of two vocabularies cover the same bytes, and how often across documents.

Both encodings of a text are cut by byte offsets: the cumulative sums of their tokens' sizes are the tokens' ends, intersect1d of the
two gives the *cuts* where both end, and searchsorted in the cuts gives every token its group. A link is an A and a B token of one group.
Links are made from the groups by repeats alone: each A token is repeated once for each B token of its group, beside positions that
count up through those. Groups with more than LINKS links are reduced to distinct ids with multiplicities first, and links are made
LINKS at a time, so memory stays bounded however large a group is.

A block of documents is written once: its different groups as a dictionary, and each document as a sequence of places in it. Links are
made once for each different group, and a document's are sums over its groups.

An id pair's count is the number of documents that hold it linked. Each task adds up its blocks' distinct pairs; a salted first
exchange (pair, salt) and a second one (pair) add up the tasks', so that a pair all tasks hold is no hot key. The greatest
count of each A id is one row an id of vocabulary A, which bounds what is broadcast. A block asks for the counts of its distinct pairs
by key range, and the answers come back to it: no document's links are shuffled.

Defined cases: a null or empty text, and one whose A or B bytes joined differ from space + text (U+2581 in it decodes to a space), has
no tokens: zeros and an empty groups text; rows that share an id, null ids and repeated rows are separate documents, each
counted; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import pieces as P
from .repeats import spans

LINKS = 1 << 20  # links made at a time
BLOCK_TEXT = 2 << 20  # bytes of text in a block of encodings, more for very large tables
PAIRS_PER_RANGE = 1 << 20
SALTS = 16
BLOCKS = "block long, n_pairs long, pairs binary, body binary"
PAIRS = "a int, b int, salt int, n long"
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
KINDS = (np.int64, np.uint8, np.uint32, np.uint32, np.uint32, np.int64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint8, np.uint8)


@lru_cache(2)
def byte_tokens(path: str):
    """(texts -> ids of ordinary encoding, bytes of each id) of a byte-level vocabulary; special tokens' strings are plain text."""
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    # the visible character of each byte: printable bytes are themselves, the others follow from U+0100 on
    shown = sorted(pre_tokenizers.ByteLevel.alphabet())
    own = [b for b in range(256) if chr(b) in shown]
    value = {chr(b): b for b in own} | dict(zip((c for c in shown if ord(c) > 255), (b for b in range(256) if b not in own), strict=True))
    names = whole.get_vocab(with_added_tokens=True)
    added = {t.content for t in whole.get_added_tokens_decoder().values()}
    out = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        out[i] = name.encode() if name in added else bytes(value[c] for c in name)
    try:
        import public_tokenizers
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [fast(t) for t in texts], out
    except FileNotFoundError:
        return lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)], out


class Bytes:
    """Bytes of every id of a vocabulary, to join tokens with."""

    def __init__(self, tokens: list[bytes]):
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def join(self, ids: np.ndarray) -> bytes:
        return self.raw[spans(self.first[ids], self.size[ids])].tobytes()


@lru_cache(2)
def coders(a_path: str, b_path: str):
    encode, tokens = byte_tokens(a_path)
    model = P.model(b_path)
    b = Bytes([model.bytes_of[f : f + s].tobytes() for f, s in zip(model.first.tolist(), model.size.tolist(), strict=True)])
    return encode, Bytes(tokens), model, b


def groups(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many A and how many B tokens each group holds, from the tokens' sizes in bytes; both encodings cover the same bytes, no size is zero."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    return np.bincount(np.searchsorted(cuts, a_end), minlength=len(cuts)), np.bincount(np.searchsorted(cuts, b_end), minlength=len(cuts))


def _weighted(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their weights in all."""
    if weight is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[head], np.add.reduceat(weight[order], head) if len(head) else weight[:0]


def group_links(a: np.ndarray, b: np.ndarray, a_count: np.ndarray, b_count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id pair a << 32 | b, multiplicity) of the distinct links of each group, by group."""
    a_first, b_first, size = np.cumsum(a_count) - a_count, np.cumsum(b_count) - b_count, a_count * b_count
    out = [(np.zeros(0, np.int64),) * 3]
    for g in np.flatnonzero(size > LINKS).tolist():  # distinct ids with multiplicities first
        x, m = np.unique(a[a_first[g] : a_first[g] + a_count[g]], return_counts=True)
        y, k = np.unique(b[b_first[g] : b_first[g] + b_count[g]], return_counts=True)
        out.append((np.full(len(x) * len(y), g), (x[:, None] << 32 | y[None]).ravel(), (m[:, None] * k[None]).ravel()))
    fine = np.flatnonzero(size <= LINKS)
    before, lo = np.concatenate([[0], np.cumsum(size[fine])]), 0
    while lo < len(fine):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + LINKS, "right")) - 1)
        g = fine[lo:hi]
        times = np.repeat(b_count[g], a_count[g])  # an A token is repeated once for each B token of its group
        pair = np.repeat(a[spans(a_first[g], a_count[g])], times) << 32 | b[spans(np.repeat(b_first[g], a_count[g]), times)]
        group = np.repeat(g, size[g])
        order = np.lexsort((pair, group))
        pair, group = pair[order], group[order]
        head = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (group[1:] != group[:-1])]))
        out.append((group[head], pair[head], np.diff(np.append(head, len(pair)))))
        lo = hi
    group, pair, times = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(group, kind="stable")
    return group[order], pair[order], times[order]


class Encoded:
    """A block of encoded documents: a dictionary of different groups, and each document's sequence of places in it."""

    def __init__(self, ids: np.ndarray, missing: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, n_groups: np.ndarray, parts: tuple, places: np.ndarray):
        self.ids, self.missing, self.n_a, self.n_b, self.places = ids, missing, n_a, n_b, places
        self.at = np.concatenate([[0], np.cumsum(n_groups, dtype=np.int64)])
        self.parts = parts  # A ids, B ids, A and B tokens of each different group
        group, pair, self.times = group_links(*parts)
        self.first = np.searchsorted(group, np.arange(len(parts[2]) + 1))
        self.pairs, self.pair = np.unique(pair, return_inverse=True)

    @classmethod
    def of(cls, docs: list[tuple]) -> Encoded:
        """From (id, A ids, B ids, A and B tokens of each group) of each document."""
        a, b, a_count, b_count = (np.concatenate([d[i] for d in docs]).astype(np.int64) for i in (1, 2, 3, 4))
        a_first, b_first = np.cumsum(a_count) - a_count, np.cumsum(b_count) - b_count
        places, left, total = np.empty(len(a_count), np.int64), np.ones(len(a_count), bool), 0
        parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]

        def add(at: np.ndarray, where: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> None:
            nonlocal total
            places[at] = where + total
            total += len(a_size)
            for part, x in zip(parts, (a_ids, b_ids, a_size, b_size), strict=True):
                part.append(x)

        bits = max(1, int(max(a.max(initial=0), b.max(initial=0))).bit_length())
        for p, q in ((1, 1), (1, 2), (2, 1)):  # most groups: their ids fit into one integer
            if (p + q) * bits > 63:
                continue
            at = np.flatnonzero((a_count == p) & (b_count == q))
            key = np.zeros(len(at), np.int64)
            for ids, first, n in ((a, a_first, p), (b, b_first, q)):
                for i in range(n):
                    key = key << bits | ids[first[at] + i]
            key, where = np.unique(key, return_inverse=True)
            flat = np.stack([key >> (bits * (p + q - 1 - i)) & ((1 << bits) - 1) for i in range(p + q)], 1)
            add(at, where, flat[:, :p].ravel(), flat[:, p:].ravel(), np.full(len(key), p), np.full(len(key), q))
            left[at] = False
        known: dict[tuple[bytes, bytes], int] = {}
        rest = np.flatnonzero(left)
        a_raw, b_raw = memoryview(a).cast("B"), memoryview(b).cast("B")
        ends = zip(*((8 * x[rest]).tolist() for x in (a_first, a_first + a_count, b_first, b_first + b_count)), strict=True)
        where = np.array([known.setdefault((bytes(a_raw[i:j]), bytes(b_raw[k:m])), len(known)) for i, j, k, m in ends], np.int64)
        more = [[np.frombuffer(key[i], np.int64) for key in known] for i in (0, 1)]
        add(rest, where, *(np.concatenate([parts[0][0], *m]) for m in more), *(np.array([len(x) for x in m], np.int64) for m in more))
        sizes = [np.array([len(d[i]) for d in docs], np.int64) for i in (1, 2, 3)]
        return cls(np.array([d[0] or 0 for d in docs], np.int64), np.array([d[0] is None for d in docs]), *sizes, tuple(np.concatenate(x) for x in parts), places)

    def pack(self) -> bytes:
        wide = self.places.astype(np.uint32).view(np.uint8).reshape(-1, 4)  # low bytes apart from high ones, which compress better
        flat = [x.astype(np.uint32) for x in self.parts]
        n = [x.astype(np.uint32) for x in (self.n_a, self.n_b, np.diff(self.at))]
        return B.pack_arrays(self.ids, self.missing.astype(np.uint8), *n, np.array([len(self.places)], np.int64), *flat, np.ascontiguousarray(wide[:, 0]), np.ascontiguousarray(wide[:, 1:].T).ravel())

    @classmethod
    def unpack(cls, body: bytes) -> Encoded:
        ids, missing, n_a, n_b, n_groups, n, *parts, low, high = B.unpack_arrays(body, *KINDS)
        places = low.astype(np.int64)
        for i, plane in enumerate(high.reshape(3, int(n[0]))):
            places |= plane.astype(np.int64) << (8 * (i + 1))
        return cls(ids, missing.astype(bool), *(x.astype(np.int64) for x in (n_a, n_b, n_groups)), tuple(x.astype(np.int64) for x in parts), places)

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in `pairs` of each document's links, and how many links each stands for; a place may come more than once."""
        for lo, hi in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True):
            group, times = np.unique(self.places[lo:hi], return_counts=True)
            size = self.first[group + 1] - self.first[group]
            rows = spans(self.first[group], size)
            yield self.pair[rows], self.times[rows] * np.repeat(times, size)

    def document_counts(self) -> np.ndarray:
        """How many documents of the block hold each of its pairs linked."""
        out = np.zeros(len(self.pairs), np.int64)
        for pair, _ in self.documents():
            out[np.unique(pair)] += 1
        return out


def spelled(a: np.ndarray, b: np.ndarray, a_count: np.ndarray, b_count: np.ndarray) -> list[str]:
    """a1,a2|b1,b2 of each group."""
    a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
    a_end, b_end = np.cumsum(a_count).tolist(), np.cumsum(b_count).tolist()
    return [f"{','.join(a_text[i:j])}|{','.join(b_text[k:m])}" for i, j, k, m in zip([0, *a_end], a_end, [0, *b_end], b_end, strict=False)]


def encoded_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """Blocks of encoded documents, written once; n_pairs: distinct id pairs of the block."""
    B.small_batches(docs.sparkSession)
    source = docs.select(B.quoted(id_col).cast("long").alias("doc_id"), B.quoted(text_col).cast("string").alias("text"))
    size = min(B.MOST_BLOCK_BYTES, max(BLOCK_TEXT, (B.plan_bytes(source) or 0) >> 14))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, a_bytes, model, b_bytes = coders(a_path, b_path)
        block, held, text_size = B._task() << 32, [], 0

        def flush() -> pa.RecordBatch:
            encoded = Encoded.of(held)
            pairs = B.pack_arrays(np.diff(encoded.pairs, prepend=0), encoded.document_counts())
            return pa.record_batch([pa.array([block], pa.int64()), pa.array([len(encoded.pairs)], pa.int64()), pa.array([pairs], pa.binary()), pa.array([encoded.pack()], pa.binary())], ["block", "n_pairs", "pairs", "body"])

        zero = np.zeros(0, np.int64)
        for batch in batches:
            step = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))  # a batch of long texts is encoded in parts
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                texts = [t or "" for t in part["text"].to_pylist()]
                a_all = encode([" " + t if t else "" for t in texts])
                b_all, at = model.encode(texts)
                for i, (doc_id, text) in enumerate(zip(part["doc_id"].to_pylist(), texts, strict=True)):
                    a, b, raw = np.array(a_all[i], np.int64), b_all[at[i] : at[i + 1]].astype(np.int64), (" " + text).encode()
                    # pieces spell the normalised text, so their bytes are those of space + text unless it holds the mark that stands for a space
                    if text and P.SPACE not in text and a_bytes.join(a) == raw:
                        held.append((doc_id, a, b, *groups(a_bytes.size[a], b_bytes.size[b])))
                    else:
                        held.append((doc_id, zero, zero, zero, zero))
                    text_size += len(raw) + 16
                    if text_size >= size:
                        yield flush()
                        block, held, text_size = block + 1, [], 0
        if held:
            yield flush()

    return B.cut(B.few_files(source).mapInArrow(run, BLOCKS))


def document_counts(blocks: DataFrame) -> DataFrame:
    """a, b, n: how many documents hold an A and a B id linked; added up in the task, by (pair, salt), then by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, held, rows = B._task() % SALTS, [], 0

        def flush() -> pa.RecordBatch:
            keys, n = _weighted(np.concatenate([k for k, _ in held]), np.concatenate([w for _, w in held]))
            return pa.record_batch(
                [pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(np.full(len(keys), salt, np.int32)), pa.array(n.astype(np.int64))], ["a", "b", "salt", "n"]
            )

        for batch in batches:
            for body in batch["pairs"]:
                steps, n = B.unpack_arrays(body.as_py(), np.int64, np.int64)
                held.append((np.cumsum(steps), n))
                rows += len(held[-1][0])
                if rows > 4 * PAIRS_PER_RANGE:
                    yield flush()
                    held, rows = [], 0
        if rows:
            yield flush()

    sums = blocks.select("pairs").mapInArrow(run, PAIRS)
    return sums.groupBy("a", "b", "salt").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its tokens, groups and links, how many links are the best of their A id, the sum of all links' counts, and its groups as text.

    a_path: a byte-level vocabulary of the tokenizers library; b_path: a SentencePiece model (see `pieces`). The A encoding is that of
    space + text, as the B model adds the space itself.
    """
    blocks = encoded_blocks(docs, a_path, b_path, id_col, text_col)
    asked = blocks.agg(F.sum("n_pairs")).first()[0] or 0
    n_parts = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-asked // PAIRS_PER_RANGE)) | 1
    counts = B.cut(document_counts(blocks))
    best = counts.groupBy("a").agg(F.max("n").alias("best"))  # a row an id of vocabulary A at most
    known = counts.join(F.broadcast(best), "a").select(
        F.pmod(F.col("a").cast("long") * 65_537 + F.col("b"), F.lit(n_parts)).cast("int").alias("part"), (F.col("a").cast("long") * (1 << 32) + F.col("b")).alias("pair"), "n", (F.col("n") == F.col("best")).cast("tinyint").alias("top")
    )

    def ask(block: int, body: bytes) -> list[tuple[int, int, bytes]]:
        pairs = np.cumsum(B.unpack_arrays(body, np.int64, np.int64)[0])
        return [(p, block, B.pack_arrays(np.diff(pairs[rows], prepend=0))) for p, rows in B.by_part(part_of(pairs))]

    def part_of(pairs: np.ndarray) -> np.ndarray:
        return ((pairs >> 32) * 65_537 + (pairs & 0xFFFFFFFF)) % n_parts

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, n, top = (np.asarray(right[c].combine_chunks().to_numpy()) for c in ("pair", "n", "top"))
        order = np.argsort(keys)
        keys, n, top = keys[order], n[order], top[order]
        out = []
        for part, block, body in zip(left["part"].to_pylist(), left["block"].to_pylist(), left["body"], strict=True):
            where = np.searchsorted(keys, np.cumsum(B.unpack_arrays(body.as_py(), np.int64)[0]))
            out.append((part, block, B.pack_arrays(n[where], top[where].astype(np.uint8))))
        return pa.Table.from_batches([B.messages(out)])

    asks = B.scatter(blocks.select("block", F.col("pairs").alias("body")), ask)
    replies = asks.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(answer, B.MESSAGE_SCHEMA)

    def finish(block: int, body: bytes, got: dict[int, bytes]) -> pa.Table:
        columns: list[list] = [[] for _ in range(4)]
        if body is None:
            encoded = Encoded.of([(None, *[np.zeros(0, np.int64)] * 4)])
            encoded.ids, encoded.missing, encoded.n_a, encoded.n_b, encoded.at = (x[:0] for x in (encoded.ids, encoded.missing, encoded.n_a, encoded.n_b, encoded.at))
        else:
            encoded = Encoded.unpack(body)
            n, top = np.zeros(len(encoded.pairs), np.int64), np.zeros(len(encoded.pairs), np.int64)
            for p, rows in B.by_part(part_of(encoded.pairs)):
                n[rows], top[rows] = B.unpack_arrays(got[p], np.int64, np.uint8)
            names, places, at = spelled(*encoded.parts), encoded.places.tolist(), encoded.at.tolist()
            for i, (pair, times) in enumerate(encoded.documents()):
                row = (int(times.sum()), int((times * top[pair]).sum()), int((times * n[pair]).sum()), ";".join([names[g] for g in places[at[i] : at[i + 1]]]))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
        n_groups = np.diff(encoded.at)
        numbers = {"n_a": encoded.n_a, "n_b": encoded.n_b, "n_groups": n_groups, "n_links": columns[0], "n_best": columns[1], "count_sum": columns[2]}
        return pa.table({"doc_id": pa.array(encoded.ids, pa.int64(), mask=encoded.missing)} | {k: pa.array(c, pa.int64()) for k, c in numbers.items()} | {"groups": pa.array(columns[3], pa.string())})

    return B.gather(blocks, replies, finish, SCHEMA)


def digests(rows: DataFrame) -> DataFrame:
    """The contract's columns of align; a document without tokens has an empty groups_sha256."""
    shown = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", shown.alias("groups_sha256"))
