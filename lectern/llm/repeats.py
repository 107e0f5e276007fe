"""Candidates for repeated windows of a fixed length, and the exchange that settles them; shared by (2) and (9).

A window of L tokens is *repeated* if its token sequence also starts earlier in the corpus: in a smaller
document id, or earlier in the same document (rows that share an id are ordered by where they were packed).

Every window is filed under the k-gram inside it with the smallest hash (leftmost on ties), which depends
only on the window's content. Consecutive windows filed under one k-gram occurrence form a *unit*; there is
about one unit for (L - k + 2) / 2 tokens. Any two equal windows have the same k-gram at the same place, so:

1. anchors: a unit whose k-gram no other unit has holds no repeated window. Of units with equal contexts (all tokens
   their windows touch) all but the first hold only repeated windows; if a k-gram has one context
   only, that first one holds none. This is the map-side combine of copies; all other units stay open.
2. open units go, as text, to the key range of their k-gram, where the operator's own method settles them by
   content: a greedy parse for (2), a radix order for (9).

Hot k-grams. A block sends at most SENT contexts of one k-gram and leaves the others open. A k-gram with over `hot`
contexts in all is not gathered in one place: its windows are compared one by one, by a digest, dealt by that.

What digests decide. Contexts, and windows of hot k-grams, are compared by 96 bits of a digest of their own content, apart from the
k-gram's 64 bits: n contexts of one k-gram are taken for one another with odds of n^2 / 2^97 (2^-47 for 2^25 of them). Everything else
is compared by content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

CLEAN, REPEATED, OPEN, HOT, HOT_COPY = 0, 1, 2, 3, 4  # HOT_COPY: repeats a whole context of a hot k-gram
SENT = 8
_LOW = np.uint64(0xFFFFFFFF)


@dataclass
class Units:
    first: np.ndarray  # first window start
    last: np.ndarray  # last window start
    gram: np.ndarray
    one: np.ndarray  # 64 and 32 bits of a digest of all tokens the windows touch
    two: np.ndarray


def find_units(tokens: np.ndarray, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start and k-gram of the units of a block whose document i holds tokens[at[i]:at[i + 1]]."""
    none = np.zeros(0, np.int64)
    n = len(tokens) - length + 1
    if n <= 0:
        return none, none, none.astype(np.uint64)
    grams = B.mix(B.window_hash(tokens, k))
    least = grams & ~_LOW
    least |= np.arange(len(grams), dtype=np.uint64)
    have, width = 1, length - k + 1
    free = np.empty_like(least)
    while have * 2 <= width:
        least, free = np.minimum(least[:-have], least[have:], out=free[: len(least) - have]), least
        have *= 2
    least = np.minimum(least[:n], least[width - have : width - have + n])
    step = np.zeros(n + 1, np.int8)
    long = at[1:] - at[:-1] >= length
    np.add.at(step, at[:-1][long], 1)
    np.add.at(step, at[1:][long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(step[:n], dtype=np.int8))
    if not len(start):
        return none, none, none.astype(np.uint64)
    anchor = (least[start] & _LOW).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return start[head], start[np.concatenate([head[1:], [len(start)]]) - 1], grams[anchor[head]]


def content_digests(parts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of a 128-bit digest of each part's bytes."""
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in parts]), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), (both[:, 1] >> np.uint64(32)).astype(np.uint32)


def window_keys(halves: np.ndarray, shift: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes, of 64 and 32 bits, of the windows at these starts, from the halves' hashes."""
    a, b = halves[starts], halves[starts + shift]
    return B.mix2(a, b), (B.mix(B.mix2(b, a)) >> np.uint64(32)).astype(np.uint32)


def _first_of(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first entry of each distinct pair, in order; and for every entry the index of its pair's first."""
    order = np.lexsort((two, one))  # stable, so equal pairs stay in order
    a, b = one[order], two[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
    first = np.empty(len(one), np.int64)
    first[order] = order[new][np.cumsum(new) - 1] if len(order) else order
    return np.flatnonzero(first == np.arange(len(one))), first


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), then first[1], ..."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


@dataclass
class Block:
    """What a pass knows of one block."""

    ids: np.ndarray
    missing: np.ndarray
    at: np.ndarray  # byte offsets of the documents
    raw: np.ndarray
    tokens: np.ndarray
    ends: np.ndarray  # token offsets of the documents
    units: Units | None
    words: list | None  # per document, where tokens are words

    def where(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document id, token position in it) of these token positions of the block."""
        doc = np.searchsorted(self.ends, starts, "right") - 1
        return self.ids[doc], (starts - self.ends[doc]).astype(np.uint32)


@dataclass
class Method:
    """How an operator reads tokens, and settles open units by content."""

    length: int
    k: int
    tokens: Callable  # (raw, byte offsets) -> tokens, offsets, words or None
    parts: Callable  # (Block, first, stop) -> the content of these stretches of tokens, each as bytes
    content: Callable  # (Block, first, last) -> arrays, the text of these units
    settle: Callable  # [(doc, pos, windows, *content), ...] by message -> [reply arrays, ...]
    content_kinds: tuple
    reply_kinds: tuple
    hot: int = 1 << 17


def _block(body: bytes, method: Method) -> Block:
    ids, missing, at, raw = B.decode_docs(body)
    tokens, ends, words = method.tokens(raw, at)
    first, last, gram = find_units(tokens, ends, method.length, method.k)
    block = Block(ids, missing, at, raw, tokens, ends, None, words)
    block.units = Units(first, last, gram, *content_digests(method.parts(block, first, last + method.length)))
    return block


def _payloads(block: int, part: np.ndarray, base: int, arrays: Callable[[np.ndarray], list[np.ndarray]]) -> list[tuple[int, int, bytes]]:
    """One message for each key range that has entries: the arrays of the entries in it."""
    return [(base + p, block, B.pack_arrays(*arrays(rows))) for p, rows in B.by_part(part)]


class _Sent:
    """Which units a block asks about, and what the answers say of all its units."""

    def __init__(self, units: Units, n_parts: int):
        self.pick, self.first = _first_of(units.one, units.two)
        gram = units.gram[self.pick]
        order = np.argsort(gram, kind="stable")
        new = np.concatenate([[True], gram[order][1:] != gram[order][:-1]])[: len(gram)]
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        self.contexts = np.empty(len(gram), np.int64)
        self.contexts[order] = np.diff(np.append(begin, len(gram)))[group] if len(gram) else 0
        rank = np.empty(len(gram), np.int64)
        rank[order] = np.arange(len(gram)) - (begin[group] if len(gram) else 0)
        self.asked = np.flatnonzero(rank < SENT)  # indices into pick
        self.part = gram[self.asked] % np.uint64(n_parts)
        self.gram = gram

    def states(self, units: Units, replies: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """State of every unit, and the source (doc, pos) of those that repeat a whole context."""
        state = np.full(len(self.pick), OPEN, np.uint8)
        doc, pos = np.zeros(len(units.first), np.int64), np.zeros(len(units.first), np.uint32)
        state[self.asked] = CLEAN
        for p, rows in B.by_part(self.part):
            if p in replies:
                got, d, q = B.unpack_arrays(replies[p], np.uint8, np.int64, np.uint32)
                who = self.asked[rows]
                state[who] = got
                again = self.pick[who[(got == REPEATED) | (got == HOT_COPY)]]
                doc[again], pos[again] = d, q
        hot = np.unique(self.gram[state >= HOT])
        state[state == HOT_COPY] = REPEATED
        if len(hot):
            state[(state == OPEN) & np.isin(self.gram, hot)] = HOT
        every = np.full(len(units.first), REPEATED, np.uint8)
        every[self.pick] = state
        return every, doc, pos


def _settle_anchors(hot: int) -> Callable:
    def settle(each: list[list[np.ndarray]]) -> list[list[np.ndarray] | None]:
        sizes = [len(x[0]) for x in each]
        gram, one, two, doc, pos, many = (np.concatenate([x[i] for x in each]) for i in range(6))
        source = np.repeat(np.arange(len(each)), sizes)
        state, first = np.zeros(len(gram), np.uint8), np.zeros(len(gram), np.int64)
        order = np.argsort(gram, kind="stable")
        same = gram[order][1:] == gram[order][:-1]
        rest = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]  # a k-gram some other entry has too
        if len(rest):
            rest = rest[np.lexsort((source[rest], pos[rest], doc[rest], two[rest], one[rest], gram[rest]))]
            g, c, d = gram[rest], one[rest], two[rest]
            new_gram = np.concatenate([[True], g[1:] != g[:-1]])
            new_class = new_gram | np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
            group = np.cumsum(new_gram) - 1
            classes = np.bincount(group, weights=new_class)
            total = np.bincount(group, weights=many[rest] / np.minimum(many[rest], SENT))
            is_hot = (total[group] > hot) & (classes[group] > 1)
            state[rest] = np.where(new_class, np.where(is_hot, HOT, np.where(classes[group] > 1, OPEN, CLEAN)), np.where(is_hot, HOT_COPY, REPEATED))
            first[rest] = rest[new_class][np.cumsum(new_class) - 1]
        out, lo = [], 0
        for size in sizes:
            s = state[lo : lo + size]
            origin = first[lo : lo + size][(s == REPEATED) | (s == HOT_COPY)]
            out.append([s, doc[origin], pos[origin]] if s.any() else None)
            lo += size
        return out

    return settle


def _settle_digests(each: list[list[np.ndarray]]) -> list[list[np.ndarray] | None]:
    """Windows of hot k-grams: flags of those that start earlier, and where."""
    sizes = [len(x[0]) for x in each]
    one, two, doc, pos = (np.concatenate([x[i] for x in each]) for i in range(4))
    source = np.repeat(np.arange(len(each)), sizes)
    order = np.lexsort((source, pos, doc, two, one))
    new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
    again, first = np.zeros(len(one), np.uint8), np.zeros(len(one), np.int64)
    again[order[~new]] = 1
    first[order] = order[new][np.cumsum(new) - 1]
    out, lo = [], 0
    for size in sizes:
        s = again[lo : lo + size]
        origin = first[lo : lo + size][s == 1]
        out.append([s, doc[origin], pos[origin]] if s.any() else None)
        lo += size
    return out


@dataclass
class Found:
    """What is known of a block's repeats in the end; starts are token positions of the block."""

    whole: np.ndarray  # units that repeat a whole context
    whole_doc: np.ndarray
    whole_pos: np.ndarray
    open: np.ndarray  # units settled by content, in the order in which they were sent
    replies: list[tuple[np.ndarray, list[np.ndarray]]]  # (units, reply arrays) by key range
    single: np.ndarray  # starts of repeated windows of hot k-grams
    single_doc: np.ndarray
    single_pos: np.ndarray


def repeated_rows(docs: DataFrame, method: Method, rows: Callable[[Block, Found], pa.Table], schema: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """rows(block, found) for each block, one row a document, in their order.

    Columns in `carry` travel with their document and come after the rows' own as x_0, x_1, ...
    """
    blocks = B.packed(docs, id_col, text_col, carry=carry)
    schema = ", ".join([schema, *[f"x_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)]])
    n_parts = B.ranges(blocks)
    anchor_kinds, digest_kinds = (np.uint64, np.uint64, np.uint32, np.int64, np.uint32, np.uint32), (np.uint64, np.uint32, np.int64, np.uint32)

    def emit_anchors(block: int, body: bytes) -> list[tuple[int, int, bytes]]:
        it = _block(body, method)
        sent = _Sent(it.units, n_parts)
        who = sent.pick[sent.asked]
        doc, pos = it.where(it.units.first[who])
        columns = (it.units.gram[who], it.units.one[who], it.units.two[who], doc, pos, sent.contexts[sent.asked].astype(np.uint32))
        return _payloads(block, sent.part, 0, lambda r: [c[r] for c in columns])

    def answer(kinds: tuple, settle: Callable) -> Callable:
        def decide(part: int, names: list[int], bodies: list[bytes]) -> list[tuple[int, int, bytes]]:
            replies = settle([B.unpack_arrays(b, *kinds) for b in bodies])
            return [(part, name, B.pack_arrays(*reply)) for name, reply in zip(names, replies, strict=True) if reply is not None]

        return decide

    by_anchor = answer(anchor_kinds, _settle_anchors(method.hot))
    by_content = answer((np.int64, np.uint32, np.uint32, *method.content_kinds), method.settle)
    by_digest = answer(digest_kinds, _settle_digests)

    anchors = B.cut(B.resolve(B.scatter(blocks, emit_anchors), by_anchor))

    def split(it: Block, replies: dict[int, bytes]) -> tuple:
        """Whole repeats with their sources; open units by key range; distinct hot windows by key range."""
        units, sent = it.units, _Sent(it.units, n_parts)
        state, doc, pos = sent.states(units, replies)
        local = np.flatnonzero((state == REPEATED) & (sent.first != np.arange(len(state))))
        doc[local], pos[local] = it.where(units.first[sent.first[local]])  # a copy inside the block
        opened = np.flatnonzero(state == OPEN)
        hot = np.flatnonzero(state == HOT)
        starts = spans(units.first[hot], units.last[hot] - units.first[hot] + 1)
        one, two = content_digests(method.parts(it, starts, starts + method.length))
        return state, doc, pos, opened, starts, one, two

    def emit_open(block: int, body: bytes, replies: dict[int, bytes]) -> pa.Table:
        if body is None:
            return pa.Table.from_batches([B.messages([])])
        it = _block(body, method)
        _, _, _, opened, starts, one, two = split(it, replies)
        units = it.units

        def text(rows: np.ndarray) -> list[np.ndarray]:
            who = opened[rows]
            return [*it.where(units.first[who]), (units.last[who] - units.first[who] + 1).astype(np.uint32), *method.content(it, units.first[who], units.last[who])]

        out = _payloads(block, units.gram[opened] % np.uint64(n_parts), 0, text)
        if len(starts):
            pick, _ = _first_of(one, two)
            columns = (one[pick], two[pick], *it.where(starts[pick]))
            out += _payloads(block, one[pick] % np.uint64(n_parts), n_parts, lambda r: [c[r] for c in columns])
        return pa.Table.from_batches([B.messages(out)])

    def settle_open(part: int, names: list[int], bodies: list[bytes]) -> list[tuple[int, int, bytes]]:
        return (by_content if part < n_parts else by_digest)(part, names, bodies)

    settled = B.resolve(B.gather(blocks, anchors, emit_open, B.MESSAGE_SCHEMA), settle_open)
    # replies of the last pass are told apart by parts beyond the first pass's
    replies = anchors.unionByName(settled.withColumn("part", (F.col("part") + n_parts).cast("int")))

    def finish(block: int, body: bytes, got: dict[int, bytes]) -> pa.Table:
        if body is None:
            none = np.zeros(0, np.int64)
            empty = Block(none, none.astype(bool), np.zeros(1, np.int64), np.zeros(0, np.uint8), none.astype(np.uint64), np.zeros(1, np.int64), None, [])
            return rows(empty, Found(none, none, none, none, [], none, none, none))
        it = _block(body, method)
        state, doc, pos, opened, starts, one, two = split(it, got)
        replies = [(opened[r], B.unpack_arrays(got[n_parts + p], *method.reply_kinds)) for p, r in B.by_part(it.units.gram[opened] % np.uint64(n_parts)) if n_parts + p in got]
        single = single_doc = single_pos = np.zeros(0, np.int64)
        if len(starts):
            pick, first = _first_of(one, two)
            again = first != np.arange(len(starts))
            src_doc, src_pos = it.where(starts[first])
            for p, r in B.by_part(one[pick] % np.uint64(n_parts)):
                if 2 * n_parts + p in got:
                    flag, d, q = B.unpack_arrays(got[2 * n_parts + p], np.uint8, np.int64, np.uint32)
                    who = pick[r][flag == 1]
                    again[who], src_doc[who], src_pos[who] = True, d, q
            single, single_doc, single_pos = starts[again], src_doc[again], src_pos[again]
        whole = np.flatnonzero(state == REPEATED)
        out = rows(it, Found(whole, doc[whole], pos[whole], opened, replies, single, single_doc, single_pos))
        if carry:
            extra = B.carried(body)
            for name in extra.column_names:
                out = out.append_column(name, extra[name])
        return out

    return B.gather(blocks, replies, finish, schema)


def covered(n: int, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of n tokens the half-open spans cover."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, stop, -1)
    return np.cumsum(step[:-1]) > 0
