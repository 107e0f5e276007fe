"""Suffix-array dedup (9): a radix order of suffixes, limited to the depth of the threshold.

Suffixes that can be tied at all are found first (see `repeats`: their sampled 32-byte gram occurs elsewhere). They
go, as bytes, to the key range of their gram, and are ordered there by their first `threshold` bytes only: one pass
for each 8-byte digit, big-endian, the most significant first, and each pass sorts again only the groups still tied on
all digits so far. Groups still tied after the last digit are exactly the repeated windows; the earliest of each group stays.

Suffixes that share no gram with another one are settled by being alone, and copies of a whole unit are combined
before the order (by a digest, see `repeats`); ordering every suffix would write over ten times the input.

Defined cases: a null text counts as empty; an empty text keeps zero bytes and the digest of nothing; rows that
share a doc_id are separate documents, ordered as packed; a null doc_id sorts before all others; an
empty table gives no rows. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from . import repeats as R

GRAM_BYTES = 32
_table = np.random.default_rng(20_240_601).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def _tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, None]:
    return _table[raw], at, None


def radix_order(raw: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the suffixes at `starts` by their first `depth` bytes, and for each place of it whether it is tied with the one before.

    Most significant digits of eight bytes first; only suffixes tied so far are sorted again. Every suffix has `depth` bytes.
    """
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))  # the digit that begins at each byte
    order, tied = np.arange(len(starts)), np.ones(len(starts), bool)
    tied[:1] = False
    for at in range(0, depth, 8):
        in_tie = tied.copy()
        in_tie[:-1] |= tied[1:]
        place = np.flatnonzero(in_tie)  # places of groups that are still tied
        if not len(place):
            break
        who = order[place]
        digit = eight[starts[who] + at].astype(np.uint64)
        if depth - at < 8:
            digit >>= np.uint64(8 * (8 - depth + at))
        group = np.cumsum(~tied[place])
        by = np.lexsort((digit, group))
        order[place] = who[by]
        tied[place[1:]] = (group[by][1:] == group[by][:-1]) & (digit[by][1:] == digit[by][:-1])
        tied[place[:1]] = False
    return order, tied


def _settle(depth: int):
    def settle(each: list[list[np.ndarray]]) -> list[list[np.ndarray] | None]:
        """Bits of the windows that start earlier elsewhere, message by message."""
        doc, pos, windows, raw = (np.concatenate([x[i] for x in each]) for i in range(4))
        windows = windows.astype(np.int64)
        size = windows + depth - 1
        starts = R.spans(np.cumsum(size) - size, windows)
        unit = np.repeat(np.arange(len(windows)), windows)
        at = pos[unit].astype(np.int64) + R.spans(np.zeros(len(windows), np.int64), windows)
        order, tied = radix_order(raw, starts, depth)
        gone = np.zeros(len(starts), np.uint8)
        in_group = tied.copy()
        in_group[:-1] |= tied[1:]
        place = np.flatnonzero(in_group)
        if len(place):  # of each tied group, all but the earliest; units come by (block, place), the order of equal ids
            group, who = np.cumsum(~tied[place]), order[place]
            by = np.lexsort((who, at[who], doc[unit[who]], group))
            gone[who[by][1:][group[by][1:] == group[by][:-1]]] = 1
        out, lo = [], 0
        for x in each:
            n = int(x[2].sum())
            bits = gone[lo : lo + n]
            out.append([np.packbits(bits)] if bits.any() else None)
            lo += n
        return out

    return settle


def _parts(it: R.Block, first: np.ndarray, stop: np.ndarray) -> list[memoryview]:
    raw = memoryview(it.raw)
    return [raw[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)]


def _content(it: R.Block, first: np.ndarray, last: np.ndarray, depth: int) -> list[np.ndarray]:
    return [it.raw[R.spans(first, last - first + depth)]]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 100, with_text: bool = True, carry: tuple[str, ...] = (), hot: int = 1 << 17) -> DataFrame:
    """One row a document: sizes, spans removed, digest of what is kept and (with_text) the kept text.

    A character cut in the middle is left out of the text whole; the digest is over all kept bytes.

    Every byte inside a `threshold`-byte string that also starts earlier (smaller id, or the same document
    further left) is removed; strings are judged on the input, overlaps count, and no string crosses documents.
    """

    def rows(it: R.Block, found: R.Found) -> pa.Table:
        ids, missing, at, raw, units = it.ids, it.missing, it.at, it.raw, it.units
        starts = [units.first[found.whole]] if units else []
        stops = [units.last[found.whole] + threshold] if units else []
        for who, (bits,) in found.replies:
            windows = R.spans(units.first[who], units.last[who] - units.first[who] + 1)
            windows = windows[np.unpackbits(bits, count=len(windows)) > 0]
            starts.append(windows)
            stops.append(windows + threshold)
        starts.append(found.single)
        stops.append(found.single + threshold)
        covered = R.covered(len(raw), np.concatenate(starts), np.concatenate(stops))
        edge = np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))
        begins = np.flatnonzero(edge == 1)
        # a run that crosses into the next document is two runs
        doc_starts = at[1:-1]
        inner = doc_starts[(doc_starts > 0) & (doc_starts < len(covered))]
        inner = np.unique(inner[covered[inner] & covered[inner - 1]]) if len(inner) else inner
        begins = np.concatenate([begins, inner])
        spans = np.bincount(np.searchsorted(at, begins, "right") - 1, minlength=len(ids)) if len(ids) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(covered)])
        removed = total[at[1:]] - total[at[:-1]]
        kept_raw = raw[~covered].tobytes() if len(raw) else b""
        kept_at = at - total[at]
        kept = [kept_raw[a:b] for a, b in zip(kept_at[:-1].tolist(), kept_at[1:].tolist(), strict=True)]
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=ids == B.NO_ID),
                "n_bytes": pa.array((at[1:] - at[:-1]).astype(np.int64)),
                "n_removed": pa.array(removed.astype(np.int64)),
                "n_spans": pa.array(spans.astype(np.int64)),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                "text": pa.array([x.decode("utf-8", "ignore") if with_text and not gone else None for x, gone in zip(kept, missing, strict=True)], pa.string()),
            }
        )

    method = R.Method(
        threshold, min(GRAM_BYTES, threshold), _tokens, _parts, lambda it, first, last: _content(it, first, last, threshold), _settle(threshold), (np.uint8,), (np.uint8,), hot
    )
    return R.repeated_rows(docs, method, rows, SCHEMA, id_col, text_col, carry)
