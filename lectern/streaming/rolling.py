"""The rolling state as a stream: per-paper state that survives restarts.

Defined cases are those of `operators.state`; a batch without rows changes nothing; a source without rows gives no state.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.state import COLUMNS, STATE, fold_chunks, state_rows
from ..session import scratch

ITEMS = "paper string, chunk_id long, category string, key string, confidence string, sentence string, ord long, aliases array<string>, context string"


def rolling_state(items: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Streaming items (ITEMS) to the rows of each paper's state after every batch (update mode).

    Chunks of a paper must arrive in order; rows inside a batch are ordered by chunk and position.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["chunk_id", "ord"], kind="stable").to_dict("records")
        for _, chunk in groupby(rows, lambda r: r["chunk_id"]):
            held = fold_chunks(held, chunk, caps)
        state.update((json.dumps(held),))
        yield pd.DataFrame(list(state_rows(key[0], held)), columns=COLUMNS)

    return items.groupBy("paper").applyInPandasWithState(update, STATE, "held string", "update", "NoTimeout")


def run_available(items: DataFrame, caps: dict[str, int], columns: tuple[str, ...] = ("paper", "category", "key", "mentions", "confidence", "ord")) -> DataFrame:
    """Stage items as files, stream what is there to the end, and return the final state of every paper. Aliases and contexts travel where items have them."""
    from pyspark.sql import Window

    spark = items.sparkSession
    base = f"{scratch(spark)}/rolling-{uuid.uuid4().hex}"
    given = [(c.split()[0], c.split()[1]) for c in ITEMS.split(", ")]
    items.select(*[(F.col(c) if c in items.columns else F.lit(None)).cast(kind).alias(c) for c, kind in given]).repartition("paper").write.parquet(f"{base}/in")
    source = spark.readStream.schema(ITEMS).parquet(f"{base}/in")
    out = f"{base}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")  # a retried batch rewrites its own folder

    stream = rolling_state(source, caps).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    stream.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out)
    last = F.max("batch").over(Window.partitionBy("paper"))
    return rows.withColumn("last", last).where("batch = last").select(*columns)
