"""The vector index: versions that are added to, a manifest that is committed last.

    PATH/data/version=N/...        vectors of the papers that version N wrote
    PATH/manifests/version=N/...   for every paper of version N: the version its vectors are in, model, dimension, digest of its texts
    PATH/claims/N                  which writer took version N

An update writes only papers whose texts, model or dimension differ from the manifest; files of other papers are never touched. The manifest counts
once its success marker is there, which is written after everything else, so a reader sees one whole version, before, during and after a
write. Two writers that start at once claim different versions; the one that commits later keeps what the other has written.

Defined cases: null texts count as empty, null vectors are kept as null; chunks without a paper take no part; an empty update keeps
the version; reading an index that has no version gives an empty table; a version that was never committed is not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import keep

DATA = "paper_id string, chunk_id long, text string, vec array<float>, model_name string, text_hash string, version long"
MANIFEST = "paper_id string, version long, model_name string, dim int, n_chunks long, digest string"
_DONE = "_SUCCESS"


def _store(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str, folder: str) -> list[int]:
    where, store = _store(spark, f"{path}/{folder}")
    if not store.exists(where):
        return []
    names = [s.getPath().getName().rpartition("=")[2] for s in store.listStatus(where)]
    return sorted(int(n) for n in names if n.isdigit())


def committed(spark: SparkSession, path: str) -> list[int]:
    """Versions a reader may see, in order."""
    out = []
    for n in _versions(spark, path, "manifests"):
        where, store = _store(spark, f"{path}/manifests/version={n}/{_DONE}")
        if store.exists(where):
            out.append(n)
    return out


def _claim(spark: SparkSession, path: str) -> int:
    """The next version nobody has taken."""
    n = max([0, *_versions(spark, path, "claims"), *_versions(spark, path, "manifests")])
    while True:
        n += 1
        where, store = _store(spark, f"{path}/claims/{n}")
        store.mkdirs(where.getParent())
        try:
            store.create(where, False).close()  # fails where the file is there
            return n
        except Exception as problem:
            if "exist" not in str(problem).lower():
                raise


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """MANIFEST of a version, the latest by default."""
    known = committed(spark, path)
    if version is None:
        version = known[-1] if known else None
    elif version not in known:
        raise ValueError(f"{path} has no version {version}")
    if version is None:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifests/version={version}")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """DATA of a version, the latest by default: the vectors its manifest names."""
    listed = manifest(spark, path, version)
    used = [r.version for r in listed.select("version").distinct().collect()]  # a number a write
    if not used:
        return spark.createDataFrame([], DATA)
    rows = spark.read.schema(DATA).option("basePath", f"{path}/data").parquet(*[f"{path}/data/version={n}" for n in sorted(used)])
    return rows.join(listed.select("paper_id", "version"), ["paper_id", "version"], "left_semi").select(*[c.split()[0] for c in DATA.split(", ")])


def described(chunks: DataFrame, model: str) -> DataFrame:
    """What a manifest says of chunks(paper_id, chunk_id, text, vec). Chunks of a paper are bounded by its length; only their digests are gathered."""
    each = F.concat_ws(":", "chunk_id", F.sha1(F.coalesce("text", F.lit(""))))
    return chunks.groupBy("paper_id").agg(
        F.lit(model).alias("model_name"), F.max(F.size("vec")).cast("int").alias("dim"), F.count("*").alias("n_chunks"), F.sha2(F.array_join(F.array_sort(F.collect_list(each)), ","), 256).alias("digest")
    )


def changed(chunks: DataFrame, path: str, model: str) -> DataFrame:
    """Descriptions of the papers the index lacks, or has from other texts, another model or another dimension."""
    now = described(chunks.where("paper_id is not null").withColumn("paper_id", F.col("paper_id").cast("string")), model)
    return now.join(manifest(chunks.sparkSession, path), ["paper_id", "model_name", "dim", "digest"], "left_anti")


def update(chunks: DataFrame, path: str, model: str) -> int:
    """Write the papers that changed as one new version; its number, or that of the latest version if nothing changed."""
    spark = chunks.sparkSession
    new = keep(changed(chunks, path, model))
    known = committed(spark, path)
    if new.isEmpty():
        return known[-1] if known else 0
    n = _claim(spark, path)
    rows = chunks.select(F.col("paper_id").cast("string").alias("paper_id"), F.col("chunk_id").cast("long").alias("chunk_id"), "text", F.col("vec").cast("array<float>").alias("vec"), F.lit(model).alias("model_name"), F.sha1("text").alias("text_hash"))
    rows.join(new.select("paper_id"), "paper_id", "left_semi").write.mode("overwrite").parquet(f"{path}/data/version={n}")
    # the latest manifest is read again here: what another writer has committed meanwhile stays
    before = manifest(spark, path).join(new.select("paper_id"), "paper_id", "left_anti")
    after = before.unionByName(new.select("paper_id", F.lit(n).cast("long").alias("version"), "model_name", "dim", "n_chunks", "digest"))
    after.write.mode("overwrite").parquet(f"{path}/manifests/version={n}")
    return n


def vacuum(spark: SparkSession, path: str, versions: int = 2) -> list[int]:
    """Delete manifests before the last `versions`, and data none of the others names; tells which data went."""
    known = committed(spark, path)
    kept = known[-versions:]
    used = {r.version for v in kept for r in manifest(spark, path, v).select("version").distinct().collect()}
    gone = [n for n in _versions(spark, path, "data") if n not in used and n <= (known[-1] if known else 0)]
    for folder in [f"manifests/version={n}" for n in known[:-versions]] + [f"data/version={n}" for n in gone]:
        where, store = _store(spark, f"{path}/{folder}")
        store.delete(where, True)
    return gone
