"""Chunking: recursive character splitting by spans, and overlap as a window.

Chunks are verbatim pieces of the cleaned text. The splitter is recursive, but as deep as there are separators: one built-in
aggregation over a text's parts inside another, so no Python worker takes part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Separators from the coarsest to the finest, the default sizes, and what counts as white space around a chunk.
SEPARATORS = ["\n\n\n", "\n\n", "\n", ". ", " "]
CHUNK, OVERLAP = 3500, 200
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# End of fixed values.

def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _pieces(text: Column, limit: int, level: int = 0) -> Column:
    """Greedy packing of parts into pieces of at most `limit` characters; an oversized part is split by the next separator, at last anywhere."""
    if level == len(SEPARATORS):
        last = (F.ceil(F.length(text) / limit) - 1).cast("int")
        whole = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * limit + 1, F.lit(limit)))
        return F.when(F.length(text) <= limit, F.array(text)).otherwise(whole)
    separator = SEPARATORS[level]
    sentence = separator == ". "  # a sentence keeps its period
    gap = " " if sentence else separator
    parts = F.split(text, r"(?<=\.) " if sentence else separator, -1)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"), F.lit(0).alias("n"))

    def step(state: Column, part: Column) -> Column:
        n = F.length(part)
        longer = state["n"] + len(gap) + n
        joined = F.struct(state["done"].alias("done"), F.concat(state["held"], F.lit(gap), part).alias("held"), longer.alias("n"))
        before = F.when(state["held"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(state["held"])))
        alone = F.struct(before.alias("done"), part.alias("held"), n.alias("n"))

        def split(finer: Column) -> Column:
            end = F.element_at(finer, -1)
            return F.struct(F.concat(before, F.slice(finer, 1, F.size(finer) - 1)).alias("done"), end.alias("held"), F.length(end).alias("n"))

        finer = _let(_pieces(part, limit, level + 1), split)
        return F.when(state["held"].isNotNull() & (longer <= limit), joined).when(n <= limit, alone).otherwise(finer)

    whole = F.aggregate(parts, start, step, lambda state: F.concat(state["done"], F.array(state["held"])))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(whole)


def split_chunks(text: Column, limit: int = CHUNK) -> Column:
    """The chunks of a text as an array: verbatim pieces without white space around them, empty ones left out; a null text has none."""
    return _let(F.coalesce(text, F.lit("")), lambda t: F.filter(F.transform(_pieces(t, limit), lambda p: F.btrim(p, F.lit(WHITE))), lambda p: p != ""))


def chunk(docs: DataFrame, id_col: str, text_col: str, limit: int = CHUNK) -> DataFrame:
    """(id, chunk_id, chunk) of the cleaned text, without overlap."""
    return docs.select(id_col, F.posexplode(split_chunks(X.strip_boilerplate(F.col(text_col)), limit)).alias("chunk_id", "chunk"))


def overlap(chunks: DataFrame, id_col: str, size: int = OVERLAP, order: str = "chunk_id", column: str = "chunk") -> DataFrame:
    """Prefix every chunk but the first with the last `size` characters of the un-overlapped one before."""
    before = F.lag(column).over(Window.partitionBy(id_col).orderBy(order))
    tail = F.when(before.isNull(), "").otherwise(F.right(before, F.lit(size)))
    return chunks.withColumn("text", F.concat(tail, F.col(column)))
