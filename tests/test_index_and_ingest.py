"""The vector index by versions, and ingest that is stopped between data and marker."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern.sources import files, index, sinks
from lectern.streaming import ingest

CHUNKS = "paper_id string, chunk_id int, text string, vec array<float>"


def chunks(spark, *rows):
    return spark.createDataFrame([(p, c, t, [float(len(t or "")), 1.0]) for p, c, t in rows], CHUNKS)


def digests(path):
    return {str(f.relative_to(path)): hashlib.sha256(f.read_bytes()).hexdigest() for f in Path(path).rglob("*.parquet") if "/data/" in str(f)}


def texts(spark, path, version=None):
    return sorted((r.paper_id, r.chunk_id, r.text) for r in index.read(spark, path, version).collect())


def test_update_touches_only_what_changed(spark, tmp_path):
    path = str(tmp_path / "i")
    first = chunks(spark, ("p", 0, "a"), ("p", 1, "b"), ("q", 0, "c"), (None, 0, "gone"), ("r", 0, None))
    assert index.read(spark, path).count() == 0
    assert sinks.save_index(first, path, "m") == 1 == sinks.save_index(first, path, "m")
    before = digests(path)
    second = chunks(spark, ("p", 0, "a"), ("p", 1, "b"), ("q", 0, "changed"))
    assert [r.paper_id for r in sinks.reusable_papers(second, path, "m").collect()] == ["p"]
    assert sinks.save_index(second, path, "m") == 2
    after = digests(path)
    assert {k: after[k] for k in before} == before and len(after) > len(before)  # byte by byte
    assert texts(spark, path) == [("p", 0, "a"), ("p", 1, "b"), ("q", 0, "changed"), ("r", 0, None)]
    assert texts(spark, path, 1) == [("p", 0, "a"), ("p", 1, "b"), ("q", 0, "c"), ("r", 0, None)]
    assert sinks.save_index(second, path, "other") == 3 and files.load_index(spark, path, "q", "m").first().stale
    assert index.vacuum(spark, path, 1) == [2] and ("q", 0, "changed") in texts(spark, path)
    with pytest.raises(ValueError):
        index.read(spark, path, 1)


def test_a_reader_during_a_write_sees_one_version(spark, tmp_path, monkeypatch):
    """A writer that dies before its manifest is done, and what is read meanwhile."""
    path = str(tmp_path / "i")
    sinks.save_index(chunks(spark, ("p", 0, "a"), ("q", 0, "b")), path, "m")
    held = index.read(spark, path)
    seen = []
    real = index.manifest

    def watched(*args, **kw):
        if (Path(path) / "data/version=2").exists() and not seen:
            monkeypatch.setattr(index, "manifest", real)
            seen.append(texts(spark, path))  # data of version 2 is there, its manifest is not
            raise RuntimeError("killed")
        return real(*args, **kw)

    monkeypatch.setattr(index, "manifest", watched)
    with pytest.raises(RuntimeError):
        sinks.save_index(chunks(spark, ("p", 0, "new")), path, "m")
    assert seen == [[("p", 0, "a"), ("q", 0, "b")]] == [texts(spark, path)]
    assert sinks.save_index(chunks(spark, ("p", 0, "new")), path, "m") == 3  # the dead writer's number stays taken
    assert texts(spark, path) == [("p", 0, "new"), ("q", 0, "b")]
    assert sorted((r.paper_id, r.text) for r in held.collect()) == [("p", "a"), ("q", "b")]  # as it was when it was read


def stream(spark, folder):
    return spark.readStream.schema("k long, v string").option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("stop_at", [0, 1, 2])
def test_ingest_goes_on_between_data_and_marker(spark, tmp_path, stop_at):
    into, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    for n in range(3):  # keys overlap from file to file; a key's rows stay together
        spark.range(5 * n, 5 * n + 8).selectExpr("id as k", f"'file{n}' as v").union(spark.sql(f"select cast(null as long), 'null{n}'")).union(spark.sql(f"select {100 + n}L, 'twin'")).union(spark.sql(f"select {100 + n}L, 'twin'")).coalesce(1).write.mode("append").parquet(into)

    def stop(number):
        if number == stop_at:
            raise RuntimeError("stopped between data and marker")

    with pytest.raises(Exception, match="stopped between"):
        ingest.ingest(stream(spark, into), out, log, ["k"], stop).awaitTermination()
    assert (tmp_path / "out/data" / f"batch={stop_at}").exists() and ingest.batches(spark, out) == list(range(stop_at))
    schema = spark.createDataFrame([], "k long, v string").schema
    assert ingest.ingested(spark, out, schema).where(F.col("batch") >= stop_at).count() == 0
    ingest.ingest(stream(spark, into), out, log, ["k"]).awaitTermination()
    ingest.ingest(stream(spark, into), out, log, ["k"]).awaitTermination()
    got = [(r.k, r.v) for r in ingest.ingested(spark, out, schema).collect()]
    assert sorted(k for k, v in got if k is not None and k < 100) == list(range(18))
    assert sorted(v for k, v in got if k is None)[0].startswith("null") and sum(k is None for k, _ in got) == 1
    assert sorted(k for k, v in got if v == "twin") == [100, 100, 101, 101, 102, 102]


def test_batches_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    assert ingest.append_batch(rows, str(tmp_path), 4, ["k"]) and not ingest.append_batch(rows, str(tmp_path), 4, ["k"])
    assert ingest.append_batch(rows, str(tmp_path), 5, ["k"])
    assert ingest.ingested(spark, str(tmp_path), rows.schema).count() == 1 and ingest.batches(spark, str(tmp_path)) == [4, 5]
