"""Substring dedup (2): relative Lempel-Ziv parsing of documents against indexed reference blocks.

Anchors (see `repeats`) say which stretches of a document can repeat earlier text at all. These stretches go, as words,
to the key range of their anchor. What a range holds in order of (doc_id, position) is its reference block: every stretch
may copy from all that start before it. The block is indexed by windows (a hash order of all runs of `window`
words), and the stretches are parsed from left to right: at the first word where a run of `window` words occurs
earlier, the longest earlier match becomes a factor (reference document, position, length). Parsing resumes
`window` - 1 words before the factor's end, so that runs across a factor boundary are looked up too; a factor never
claims a word that no repeated run covers, and no repeated run is missed. Copies of a whole stretch are one factor without a parse.

The document's block then chains factors that go on in the same reference into longer ones (`parse`); the runs of words
that they cover are the duplicate spans (`factors`).

Defined cases: null and empty texts have no words; fewer words than a window are kept; rows that share a doc_id
are separate documents, ordered as packed; a null doc_id sorts first (a factor from it has a null ref_doc); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from . import repeats as R

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<word_start:long,word_end:long>>, parse array<struct<word_start:long,word_end:long,ref_doc:long,ref_word:long>>, kept binary"
_SPAN = pa.struct([("word_start", pa.int64()), ("word_end", pa.int64())])
_FACTOR = pa.struct([("word_start", pa.int64()), ("word_end", pa.int64()), ("ref_doc", pa.int64()), ("ref_word", pa.int64())])


def _tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    words = B.split_words(raw, at)
    ends = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return np.concatenate([B.hash_words(w) for w in words]) if words else np.zeros(0, np.uint64), ends, words


def _parts(it: R.Block, first: np.ndarray, stop: np.ndarray) -> list[bytes]:
    """Words of these stretches, joined by one space."""
    doc = np.searchsorted(it.ends, first, "right") - 1
    begin = it.ends[doc]
    return [b" ".join(it.words[d][a:b]) for d, a, b in zip(doc.tolist(), (first - begin).tolist(), (stop - begin).tolist(), strict=True)]


def _content(it: R.Block, first: np.ndarray, last: np.ndarray, window: int) -> list[np.ndarray]:
    """The units' words: one line a unit."""
    return [np.frombuffer(b"\n".join(_parts(it, first, last + window)), np.uint8)]


def longest_matches(tokens: np.ndarray, begin: np.ndarray, stop: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position of the reference block, how long the longest match is that starts earlier, and where it starts.

    Stretch i is tokens[begin[i]:stop[i]]; matches stay inside stretches, and shorter ones than `window` count as none (0).
    """
    length, source = np.zeros(len(tokens), np.int64), np.full(len(tokens), -1)
    count = np.maximum(0, stop - begin - window + 1)
    at = R.spans(begin, count)
    if not len(at):
        return length, source
    end = np.repeat(stop, count)
    halves, shift = B.half_hash(tokens, window)
    one, two = R.window_keys(halves, shift, at)
    order = np.lexsort((at, two, one))
    at, end, one, two = at[order], end[order], one[order], two[order]
    new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    size = window
    while True:
        # groups of positions that agree on `size` tokens, each in order of position
        first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        later = ~new
        length[at[later]], source[at[later]] = size, at[first[later]]
        group = np.cumsum(new)
        shared = np.bincount(group)[group] > 1
        goes_on = shared & (at + size < end)
        at, end, group = at[goes_on], end[goes_on], group[goes_on]
        if not len(at):
            return length, source
        token = tokens[at + size]
        order = np.lexsort((at, token, group))
        at, end, group, token = at[order], end[order], group[order], token[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (token[1:] != token[:-1])])
        size += 1


def parse(tokens: np.ndarray, begin: np.ndarray, stop: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors (stretch, start, length, source) of all stretches against what starts earlier; all stretches step by step at once."""
    length, source = longest_matches(tokens, begin, stop, window)
    n = len(tokens)
    following = np.minimum.accumulate(np.where(length > 0, np.arange(n), n)[::-1])[::-1]
    following = np.append(following, n)
    now, who, out = begin.copy(), np.arange(len(begin)), []
    while len(who):
        at = following[np.minimum(now, n)]
        live = at < stop[who]
        who, at = who[live], at[live]
        if len(who):
            out.append((who, at, length[at], source[at]))
        now = at + length[np.minimum(at, n - 1)] - window + 1  # runs across the factor's end are looked up as well
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _settle(window: int):
    def settle(each: list[list[np.ndarray]]) -> list[list[np.ndarray] | None]:
        """Factors of each message's stretches: (stretch, start in it, length, reference document, position)."""
        doc, pos = np.concatenate([x[0] for x in each]), np.concatenate([x[1] for x in each]).astype(np.int64)
        words = [line.split(b" ") for x in each for line in x[3].tobytes().split(b"\n")]
        order = np.lexsort((np.arange(len(doc)), pos, doc))  # messages come by block, which orders equal ids
        count = np.array([len(words[i]) for i in order], np.int64)
        stop = np.cumsum(count)
        begin = stop - count
        tokens = B.hash_words([w for i in order.tolist() for w in words[i]])
        who, at, length, source = parse(tokens, begin, stop, window)
        from_ = np.searchsorted(begin, source, "right") - 1
        ref_doc, ref_pos = doc[order][from_], pos[order][from_] + source - begin[from_]
        unit, start = order[who], at - begin[who]
        by = np.lexsort((start, unit))
        unit, start, length, ref_doc, ref_pos = (x[by] for x in (unit, start, length, ref_doc, ref_pos))
        out, lo = [], 0
        for x in each:
            hi = lo + len(x[0])
            a, b = np.searchsorted(unit, [lo, hi])
            out.append([(unit[a:b] - lo).astype(np.uint32), start[a:b].astype(np.uint16), length[a:b].astype(np.uint16), ref_doc[a:b], ref_pos[a:b].astype(np.uint32)] if b > a else None)
            lo = hi
        return out

    return settle


def _factors(it: R.Block, found: R.Found, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, reference document, reference position) of the block's chained factors, in order of start."""
    units = it.units
    start, stop = [units.first[found.whole], found.single], [units.last[found.whole] + window, found.single + window]
    ref_doc, ref_pos = [found.whole_doc, found.single_doc], [found.whole_pos.astype(np.int64), found.single_pos.astype(np.int64)]
    for who, (unit, offset, length, d, p) in found.replies:
        at = units.first[who[unit]] + offset
        start.append(at)
        stop.append(at + length)
        ref_doc.append(d)
        ref_pos.append(p.astype(np.int64))
    start, stop, ref_doc, ref_pos = (np.concatenate(x) for x in (start, stop, ref_doc, ref_pos))
    order = np.lexsort((stop, start))
    start, stop, ref_doc, ref_pos = start[order], stop[order], ref_doc[order], ref_pos[order]
    if not len(start):
        return start, stop, ref_doc, ref_pos
    doc = np.searchsorted(it.ends, start, "right")
    goes_on = (doc[1:] == doc[:-1]) & (ref_doc[1:] == ref_doc[:-1]) & (ref_pos[1:] - ref_pos[:-1] == start[1:] - start[:-1]) & (start[1:] <= stop[:-1])
    head = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    return start[head], np.maximum.reduceat(stop, head), ref_doc[head], ref_pos[head]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, with_text: bool = True, hot: int = 1 << 17) -> DataFrame:
    """One row a document: word counts, duplicate spans (factors), the parse behind them, digest of the kept words and (with_text) the words."""

    def rows(it: R.Block, found: R.Found) -> pa.Table:
        ids, ends = it.ids, it.ends
        if it.units is None:
            start = stop = ref_doc = ref_pos = np.zeros(0, np.int64)
        else:
            start, stop, ref_doc, ref_pos = _factors(it, found, window)
        gone = R.covered(len(it.tokens), start, stop)

        def by_document(kind: pa.StructType, a: np.ndarray, b: np.ndarray, *more: np.ndarray) -> pa.ListArray:
            begin = ends[np.searchsorted(ends, a, "right") - 1]
            fields = [pa.array(a - begin), pa.array(b - begin), *[pa.array(x, mask=x == B.NO_ID) for x in more]]
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(a, ends), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind)))

        edge = np.zeros(len(gone) + 1, bool)  # a run ends with its document
        edge[ends] = True
        before, after = np.concatenate([[False], gone]), np.concatenate([gone, [False]])
        run_starts, run_stops = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
        n_removed, digests, kept_texts = [], [], []
        for i, words in enumerate(it.words):
            flags = gone[ends[i] : ends[i + 1]]
            kept = [w for w, out in zip(words, flags.tolist(), strict=True) if not out] if flags.any() else words
            text = b" ".join(kept)
            n_removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(text).hexdigest())
            kept_texts.append(text if with_text else None)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=ids == B.NO_ID),
                "n_words": pa.array(np.diff(ends), pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
                "factors": by_document(_SPAN, run_starts, run_stops),
                "parse": by_document(_FACTOR, start, stop, ref_doc, ref_pos),
                "kept": pa.array(kept_texts, pa.binary()),
            }
        )

    method = R.Method(
        window, max(1, window // 2), _tokens, _parts, lambda it, first, last: _content(it, first, last, window), _settle(window), (np.uint8,), (np.uint32, np.uint16, np.uint16, np.int64, np.uint32), hot
    )
    return R.repeated_rows(docs, method, rows, SCHEMA, id_col, text_col)
