"""Ingest that neither loses nor doubles a row, wherever it is stopped.

Each batch of a stream is written to a folder of its own number, and a marker with that number is made after it. Readers see only
batches that have a marker. A batch that was stopped before its marker is written again over itself; one that has its marker is not
written again. Rows whose key an earlier batch holds are left out, so a source that delivers a key again adds nothing.

Defined cases: rows of one batch that share a key stay together, all of them; a null key equals a null key; an empty batch leaves a
marker and no rows; a table that nothing was ingested into has no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _store(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that count."""
    where, store = _store(spark, f"{path}/markers")
    return sorted(int(s.getPath().getName()) for s in store.listStatus(where) if s.getPath().getName().isdigit()) if store.exists(where) else []


def ingested(spark: SparkSession, path: str, schema: StructType, since: int = 0) -> DataFrame:
    """Rows of all batches from number `since` on that have a marker, with their batch."""
    own = [n for n in batches(spark, path) if n >= since]
    if not own:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    parts = [f"{path}/data/batch={n}" for n in own]
    return spark.read.schema(StructType([*schema.fields]).add("batch", "long")).option("basePath", f"{path}/data").parquet(*parts)


def append_batch(rows: DataFrame, path: str, number: int, key: list[str], before_marker: Callable[[int], None] | None = None) -> bool:
    """Write one batch of new keys, then its marker; tells whether it wrote. A batch with a marker is done."""
    spark = rows.sparkSession
    done = batches(spark, path)
    if number in done:
        return False
    known = ingested(spark, path, rows.schema).select(*[F.col(c).alias(f"_known_{i}") for i, c in enumerate(key)]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_known_{i}")) for i, c in enumerate(key)])
    rows.join(known, same, "left_anti").write.mode("overwrite").parquet(f"{path}/data/batch={number}")
    if before_marker:
        before_marker(number)
    where, store = _store(spark, f"{path}/markers/{number}")
    store.mkdirs(where.getParent())
    store.create(where, True).close()
    return True


def ingest(stream: DataFrame, path: str, log: str, key: list[str], before_marker: Callable[[int], None] | None = None):
    """ST-3: run what a stream has now into the table at `path`; `log` is the stream's checkpoint. before_marker is called between a batch's data and its marker."""
    writer = stream.writeStream.foreachBatch(lambda rows, number: append_batch(rows, path, number, key, before_marker) and None)
    return writer.option("checkpointLocation", log).trigger(availableNow=True).start()
