"""Folds and bounded training samples, shared by the operators that fit a model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def thinned(df: DataFrame, by: str, most: int, salt: int, values: int = 256, text_col: str = "text") -> DataFrame:
    """About `most` rows (all, if fewer) of each value of `by`, chosen by a hash; with that hash as `pick`. Over `values` values raise ValueError.

    One pass counts, one filter thins, however many values there are. `at_most` makes the bound hard, best on what is extracted from the rows.
    """
    counts = df.groupBy(by).agg(F.count("*").alias("n")).where(F.col(by).isNotNull()).limit(values + 1).collect()
    if len(counts) > values:
        raise ValueError(f"{by} has over {values} values")
    shares = [(r[by], int((1 << 40) * min(1.0, most / r["n"]))) for r in counts]
    if not shares:
        return df.limit(0).withColumn("pick", F.lit(0).cast("long"))
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares for x in pair]), F.col(by))
    parts = [F.col(c) for c in ("doc_id", text_col) if c in df.columns]  # rows may share an id, or have none
    return df.withColumn("pick", F.pmod(F.xxhash64(F.lit(salt), *parts), F.lit(1 << 40))).where(F.col("pick") < share)


def _first(rows: pa.Table, by: str, most: int) -> pa.Table:
    """The `most` rows of least `pick` of each value of `by`, of one task's rows."""
    _, key = np.unique(np.asarray(rows[by].to_pylist()).astype(str), return_inverse=True)
    pick = np.asarray(rows["pick"].to_numpy())
    order = np.lexsort((pick, key))
    head = np.concatenate([[True], key[order][1:] != key[order][:-1]])[: len(order)]
    rank = np.arange(len(order)) - np.flatnonzero(head)[np.cumsum(head) - 1] if len(order) else order
    return rows.take(pa.array(np.sort(order[rank < most]))).combine_chunks()


def at_most(df: DataFrame, by: str, most: int) -> DataFrame:
    """The `most` rows of least `pick` of each value of `by`; every task drops all others before anything is exchanged.

    Rows with equal `pick` (copies that share an id) stand for one another: any of them count.
    """

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bound = [], 0, most
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > 2 * bound:
                some = _first(pa.Table.from_batches(held), by, most)
                held, size = some.to_batches(), some.num_rows
                bound = max(most, size)
        if held:
            yield from _first(pa.Table.from_batches(held), by, most).to_batches()

    df = df.mapInArrow(least, df.schema)
    order = F.row_number().over(Window.partitionBy(by).orderBy("pick"))
    return df.withColumn("rank_of_pick", order).where(F.col("rank_of_pick") <= most).drop("rank_of_pick", "pick")
