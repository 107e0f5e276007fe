"""SentencePiece encoding and decoding (13): vectorised merge rounds.

A text is normalised as the model says (a space before it, spaces as U+2581) and cut wherever two neighbouring characters stand side
by side in no piece of the vocabulary: no merge can cross such a place, so the *words* between cuts are merged on their own, and each
different word once. The symbols of all new words of a batch are one flat array. In each round every word's least rank of a
neighbouring pair is found by a segmented minimum, all its occurrences in the word are merged, leftmost first and without overlap, the
array is compacted, and only pairs beside a merge are looked up again; words without a pair leave, until none is left.

The library merges one pair at a time, best rank first, leftmost on ties. Rounds are the same as long as no merge makes a pair of the
same or a better rank; where one does, the round ends for that word at the first such merge, and the rest waits for the next round.
A word of over LONG symbols has as many rounds as it has different merges, so its merges are taken from a queue in that same order.

Characters outside the vocabulary become byte pieces. Decoding looks up the bytes of all ids at once, drops the space that the
normalisation put first, and replaces each byte of a run of byte pieces that is part of no character, as the library does.

Defined cases: null and empty texts have no ids and decode to an empty text; rows that share an id, null ids and repeated rows are
separate documents; an empty table gives no rows. Models are BPE with byte fallback and without a character map, user symbols or
unused pieces; others raise ValueError. Every text is a row of its own: no exchange, and memory is that of a batch of whole texts.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .repeats import spans

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in the model file
LONG = 1024  # symbols of a word that is merged from a queue
CHUNK = 1 << 20  # characters normalised and cut at a time
KEPT = 1 << 18  # different words a worker remembers
NEVER = np.iinfo(np.int32).max
SCHEMA = "doc_id long, ids array<int>, decoded string"


def fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message: integers, 4-byte and 8-byte values and bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        head = varint()
        number, kind = head >> 3, head & 7
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, raw[at : at + size]
            at += size


class Names(dict):
    """word -> index; new words are listed."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        self.new.append(word)
        return value


class Pieces:
    """A model's vocabulary, with the tables encoding and decoding need."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        pieces, trainer, normal = [], {}, {}
        for number, value in model:
            if number == 1:
                one = dict(fields(value))
                pieces.append((one[1].decode(), struct.unpack("<f", one.get(2, b"\0" * 4))[0], one.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        kinds = {k for _, _, k in pieces}
        if trainer.get(3, 1) != 2 or not trainer.get(35) or trainer.get(24) or normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1) or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: only BPE models with byte fallback, a leading space and plain normalisation are supported")
        self.n = len(pieces)
        self.kind = np.array([k for _, _, k in pieces], np.int32)
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.byte = np.zeros(256, np.int32)
        out = []
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.byte[int(p[3:5], 16)] = i
            out.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else trainer.get(44, " ⁇ ".encode()) if k == UNKNOWN else p.replace(SPACE, " ").encode())
        self.bytes_of = np.frombuffer(b"".join(out), np.uint8)
        self.size = np.array([len(x) for x in out], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.leads = np.array([k == NORMAL and p.startswith(SPACE) for p, _, k in pieces])
        self._pairs({p: s for p, s, k in pieces if k == NORMAL})
        self.names, self.flat, self.at, self.held = Names(), np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def _pairs(self, score: dict[str, float]) -> None:
        """Ranks, merges of symbol pairs, and which characters may stand side by side in a word. Symbols are ids; characters without a piece of their own come after."""
        alphabet = sorted({c for p in score for c in p})
        symbol = self.ids | {c: self.n + i for i, c in enumerate(c for c in alphabet if c not in self.ids)}
        place = {s: i for i, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = np.full(self.n + 1, NEVER, np.int32)  # the last one: no merge
        for p, s in score.items():
            self.rank[self.ids[p]] = place[s]
        pairs = {}
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pair = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in sorted(pairs)], np.int32)
        self.width = len(alphabet) + 1  # the last class: characters outside the vocabulary
        self.class_of = np.full(0x110000, self.width - 1, np.int32)
        self.class_of[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        self.symbol_of = np.array([symbol[c] for c in alphabet] + [-1], np.int32)
        side = np.zeros(self.width * self.width, bool)
        side[[int(self.class_of[ord(a)]) * self.width + int(self.class_of[ord(b)]) for p in score for a, b in zip(p, p[1:], strict=False)]] = True
        self.side = np.packbits(side, bitorder="little")

    def merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id two neighbouring symbols merge to; -1 for none."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        where = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[where] == key, self.made[where], -1)

    def merge_rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All merges of words given as one array of symbols and the ascending number of each symbol's word; what is left, in order."""
        done_symbols, done_word = [], []
        made = np.full(len(symbols), -1, np.int32)  # what each symbol and its right neighbour merge to
        same = np.flatnonzero(word[1:] == word[:-1])
        made[same] = self.merge_of(symbols[same], symbols[same + 1])
        while len(symbols):
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            rank = self.rank[made]
            least = np.minimum.reduceat(rank, head)
            size = np.diff(np.append(head, len(symbols)))
            live = np.repeat(least < NEVER, size)
            if not live.all():  # words without a pair leave
                done_symbols.append(symbols[~live])
                done_word.append(word[~live])
                symbols, word, made, rank, least, size = symbols[live], word[live], made[live], rank[live], least[least < NEVER], size[least < NEVER]
                if not len(symbols):
                    break
            least = np.repeat(least, size)
            hit = np.flatnonzero(rank == least)
            # of hits side by side every second is taken; a word's last symbol is no hit, so such stretches end with the word
            begin = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            hit = hit[(np.arange(len(hit)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]) % 2 == 0]
            new = made[hit]
            # pairs that a merge makes when it happens: left of it all merges are done, right of it none
            beside = np.concatenate([[False], hit[1:] == hit[:-1] + 2]) & np.concatenate([[False], word[hit[1:]] == word[hit[:-1]]])
            left = np.where(beside, np.concatenate([[-1], new[:-1]]), symbols[hit - 1])
            has_left = (hit > 0) & (word[hit - 1] == word[hit])
            after = np.minimum(hit + 2, len(symbols) - 1)
            has_right = (hit + 2 < len(symbols)) & (word[after] == word[hit])
            best = np.minimum(np.where(has_left, self.rank[self.merge_of(left, new)], NEVER), np.where(has_right, self.rank[self.merge_of(new, symbols[after])], NEVER))
            sooner = best <= least[hit]
            if sooner.any():  # the round ends for a word with the first merge that makes such a pair
                before = np.cumsum(sooner) - sooner
                first = np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])
                taken = before == before[np.flatnonzero(first)[np.cumsum(first) - 1]]
                hit, new = hit[taken], new[taken]
            symbols[hit] = new
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            place = (np.cumsum(keep) - 1)[hit]
            symbols, word, made = symbols[keep], word[keep], made[keep]
            touched = np.concatenate([place, place[place > 0] - 1])
            inner = touched[touched + 1 < len(symbols)]
            inner = inner[word[inner] == word[inner + 1]]
            made[touched] = -1
            made[inner] = self.merge_of(symbols[inner], symbols[inner + 1])
        if not done_symbols:
            return symbols, word
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def merge_queue(self, symbols: list[int]) -> list[int]:
        """The merges of one long word, from a queue by (rank, place)."""
        n = len(symbols)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        made = self.merge_of(np.array(symbols[:-1]), np.array(symbols[1:])).tolist()
        queue = [(int(self.rank[m]), i, symbols[i], symbols[i + 1], m) for i, m in enumerate(made) if m >= 0]
        heapq.heapify(queue)
        pairs = dict(zip(self.pair.tolist(), self.made.tolist(), strict=True))
        while queue:
            _, i, a, b, m = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:  # one of the two was merged meanwhile
                continue
            symbols[i], symbols[j], after[i] = m, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (new := pairs.get(symbols[x] << 32 | symbols[y])) is not None:
                    heapq.heappush(queue, (int(self.rank[new]), x, symbols[x], symbols[y], new))
        return [s for s in symbols if s >= 0]

    def _learn(self, words: list[str]) -> None:
        """Merge new words and remember their ids."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        size = np.array([len(w) for w in words], np.int64)
        owner = np.repeat(np.arange(len(words)), size)
        symbols = self.symbol_of[self.class_of[points]]
        odd = symbols < 0  # a word of its own, as bytes
        long = size > LONG
        plain = ~odd & ~long[owner]
        parts = [self.merge_rounds(symbols[plain], owner[plain])]
        for i in np.flatnonzero(long).tolist():
            first = int(size[:i].sum())
            merged = np.array(self.merge_queue(symbols[first : first + int(size[i])].tolist()), np.int32)
            parts.append((merged, np.full(len(merged), i)))
        if odd.any():
            text = [chr(c).encode() for c in points[odd].tolist()]
            parts.append((self.byte[np.frombuffer(b"".join(text), np.uint8)], np.repeat(owner[odd], [len(t) for t in text])))
        ids, word = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(word, kind="stable")
        count = np.bincount(word, minlength=len(words))
        self.flat = np.concatenate([self.flat, ids[order].astype(np.int32)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(count)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and n + 1 offsets of the texts in them."""
        ids, counts, lo = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi]) < CHUNK):
                chars += len(texts[hi])
                hi += 1
            got, count = self._encode_chunk(texts[lo:hi])
            ids.append(got)
            counts.append(count)
            lo = hi
        return np.concatenate(ids), np.cumsum(np.concatenate(counts))

    def _encode_chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.names) > KEPT or self.held > 16 * CHUNK:
            self.names, self.flat, self.at, self.held = Names(), np.zeros(0, np.int32), np.zeros(1, np.int64), 0
        texts = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        size = np.array([len(t) for t in texts], np.int64)
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        kind = self.class_of[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
        key = kind[:-1] * np.int32(self.width) + kind[1:]
        cut = np.concatenate([[True], (self.side[key >> 3] >> (key & 7).astype(np.uint8) & 1) == 0])
        stop = np.cumsum(size)
        cut[stop[:-1][stop[:-1] < len(whole)]] = True
        start = np.flatnonzero(cut)
        edges = start.tolist()
        words = [whole[a:b] for a, b in zip(edges, [*edges[1:], len(whole)], strict=True)]
        index = np.fromiter(map(self.names.__getitem__, words), np.int64, len(words))
        if self.names.new:
            self.held += sum(map(len, self.names.new))
            self._learn(self.names.new)
            self.names.new = []
        count = self.at[index + 1] - self.at[index]
        total = np.concatenate([[0], np.cumsum(count)])
        last = np.searchsorted(start, stop)
        return self.flat[spans(self.at[index], count)], total[last] - total[np.concatenate([[0], last[:-1]])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of one sequence of ids."""
        size = self.size[ids]
        raw = self.bytes_of[spans(self.first[ids], size)].tobytes()
        shown = np.flatnonzero(self.kind[ids] != CONTROL)
        if len(shown) and self.leads[ids[shown[0]]]:
            raw = raw[1:]  # nothing came before, so the space is the first byte
            size = size.copy()
            size[shown[0]] -= 1
        if len(shown) == len(ids):  # else control ids may stand between the bytes of a character, which then is none
            try:
                return raw.decode()
            except UnicodeDecodeError:
                pass
        end, out, is_byte = np.cumsum(size), [], self.kind[ids] == BYTE
        edge = np.flatnonzero(np.concatenate([[True], is_byte[1:] != is_byte[:-1]])) if len(ids) else np.zeros(0, np.int64)
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)], strict=False):
            part = raw[int(end[a] - size[a]) : int(end[b - 1])]
            out.append(_replaced(part) if is_byte[a] else part.decode())
        return "".join(out)


def _replaced(raw: bytes) -> str:
    """Characters, and U+FFFD for each byte that is part of none."""
    out, at = [], 0
    while at < len(raw):
        size = next((n for n in range(1, 5) if at + n <= len(raw) and _is_char(raw[at : at + n])), 0)
        out.append(raw[at : at + size].decode() if size else "�")
        at += size or 1
    return "".join(out)


def _is_char(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(2)
def model(path: str) -> Pieces:
    return Pieces(path)


def list_array(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32), pa.int32()), pa.array(values, kind))


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """One row a document: the ids of its whole text, without begin or end ids, and (decoded) the text those ids decode to."""
    B.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            ids, at = pieces.encode([t or "" for t in batch["text"].to_pylist()])
            edges = at.tolist()
            texts = [pieces.decode(ids[a:b]) if decoded else None for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.record_batch([batch["doc_id"], list_array(ids, at, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(B.quoted(id_col).cast("long").alias("doc_id"), B.quoted(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def decode_pieces(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of any sequences of ids; null ids give a null text, ids outside the vocabulary or null ones inside raise ValueError."""
    B.small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            out = []
            for row in batch["ids"].to_pylist():
                if row is not None and any(i is None or not 0 <= i < pieces.n for i in row):
                    raise ValueError("an id is not in the vocabulary")
                out.append(None if row is None else pieces.decode(np.array(row, np.int64)))
            yield pa.record_batch([batch["doc_id"], pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.select(B.quoted(id_col).cast("long").alias("doc_id"), B.quoted(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(rows: DataFrame) -> DataFrame:
    """The contract's columns of encode_pieces."""
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
