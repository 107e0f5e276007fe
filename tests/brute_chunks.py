"""Recursive splitting by spans, in plain Python: what the built-in splitter must equal."""

from lectern.operators.chunking import SEPARATORS

Span = tuple[int, int]


def _parts(text: str, lo: int, hi: int, sep: str) -> list[Span]:
    """Spans between separators; a sentence keeps its period."""
    keep, out = (1 if sep == ". " else 0), []
    while (at := text.find(sep, lo, hi)) >= 0:
        out.append((lo, at + keep))
        lo = at + len(sep)
    return [*out, (lo, hi)]


def spans(text: str, limit: int, lo: int = 0, hi: int | None = None, level: int = 0) -> list[Span]:
    """Greedy packing of parts into spans of at most `limit` characters; oversized parts use the next separator."""
    hi = len(text) if hi is None else hi
    if hi - lo <= limit:
        return [(lo, hi)]
    if level == len(SEPARATORS):
        return [(a, min(hi, a + limit)) for a in range(lo, hi, limit)]
    parts = _parts(text, lo, hi, SEPARATORS[level])
    if len(parts) == 1:
        return spans(text, limit, lo, hi, level + 1)
    done: list[Span] = []
    held: Span | None = None
    for a, b in parts:
        if held and b - held[0] <= limit:
            held = (held[0], b)
            continue
        if held:
            done.append(held)
        *finer, held = spans(text, limit, a, b, level + 1) if b - a > limit else [(a, b)]
        done += finer
    return [*done, held] if held else done


def split_chunks(text: str | None, limit: int = 3500) -> list[str]:
    text = text or ""
    pieces = (text[a:b].strip() for a, b in spans(text, limit))
    return [p for p in pieces if p]
