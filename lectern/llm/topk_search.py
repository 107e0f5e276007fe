"""Exact top-k search (1): a pivot-distance index with triangle-inequality stopping.

Vectors become integers floor(scale * x). Pivots come from a bounded sample; every vector is keyed by its nearest
pivot and the distance to it, and the table is range-partitioned by (pivot, distance, id) into blocks: the sorted
annuli around each pivot. A query meets the annuli in order of an upper bound on the inner product with
anything inside, from |q - v| >= max(|q - p| - r, r - |q - p|) and 2 q.v = |q|^2 + |v|^2 - |q - v|^2, and stops
when the bound falls below its k-th score. That score starts from the sample (the k-th best of any subset bounds
the k-th best of all from below), so far annuli are never multiplied.

Pruning comes before the exchange. Neighbouring annuli of a pivot form a group, and a directory with one row a group (pivot,
distances, norm; at most MOST_GROUPS) goes to the queries, which are packed by (pivot, distance) as well. A pack is sent to a
group with only those queries whose bound there reaches their floor, and a group's annuli only to packs that ask for
it; one task takes one such pair. Results of a query from different groups are merged by rank.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do null ids;
vectors meet only vectors of their own length; the query's own id is no candidate; rows that share an id ask, and are
found, each for itself; ties go to the smaller id; fewer than k candidates give fewer rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

SAMPLE = 2048
PIVOTS = 24
ANNULUS = 1024
MOST_GROUPS = 1 << 16
BLOCKS = "g long, block long, rows long, low double, high double, pivot int, dim int, norm double, ids binary, data binary"


def integer_vectors(df: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, dim, v array<long> of the vectors that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & finite)
    return rows.select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dim)


def choose_pivots(sample: np.ndarray, n: int = PIVOTS, rounds: int = 4) -> np.ndarray:
    """A few Lloyd rounds from farthest-first seeds."""
    x = sample.astype(np.float64)
    picks = [int(np.argmax((x * x).sum(1)))]
    near = ((x - x[picks[0]]) ** 2).sum(1)
    while len(picks) < min(n, len(x)) and near.max() > 0:
        picks.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[picks[-1]]) ** 2).sum(1))
    c = x[picks]
    for _ in range(rounds):
        owner = _distances(x, c).argmin(1)
        c = np.stack([x[owner == i].mean(0) if (owner == i).any() else c[i] for i in range(len(c))])
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x @ c.T)
    return np.sqrt(np.maximum(d, 0))


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products; through doubles where those are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def _small(a: np.ndarray) -> bytes:
    kind = next(k for k in (np.int16, np.int32, np.int64) if not a.size or (a.min() >= np.iinfo(k).min and a.max() <= np.iinfo(k).max))
    return np.dtype(kind).char.encode() + a.astype(kind).tobytes()


def _wide(b: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(b, np.dtype(b[:1].decode()), offset=1).astype(np.int64).reshape(-1, dim)


def _slots(ids: np.ndarray, rows: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score, smaller id) of each query: (query row, id, score)."""
    order = np.lexsort((ids, -score, rows))
    rows, ids, score = rows[order], ids[order], score[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    keep = rank < k
    return rows[keep], ids[keep], score[keep]


def _floors(qid: np.ndarray, q: np.ndarray, sample: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """A lower bound on each query's k-th best score of all candidates: its k-th best in the sample."""
    if len(sample[0]) <= k:
        return np.full(len(q), -np.inf)
    s = exact_scores(q, sample[1]).astype(np.float64)
    s[qid[:, None] == sample[0][None]] = -np.inf
    return np.partition(s, -k, axis=1)[:, -k]


def _bounds(norm: np.ndarray, dist: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Upper bounds (queries x annuli) on the inner product with anything in an annulus, by the triangle inequality."""
    d = dist[:, pivot]
    apart = np.maximum(0, np.maximum(d - high, low - d) - 1e-6)
    whole = norm[:, None] + most
    return (whole - apart**2) / 2 + 1e-6 * (1 + whole)


def live_groups(queries: tuple[np.ndarray, np.ndarray], directory: tuple[np.ndarray, ...], pivots: np.ndarray, sample: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """(query, group) pairs, by group, of the groups (pivot, low, high, norm) that may hold one of a query's k best."""
    qid, q = queries
    out = [np.zeros((2, 0), np.int64)]
    for lo in range(0, len(q), 256):
        part = q[lo : lo + 256].astype(np.float64)
        bound = _bounds((part**2).sum(1), _distances(part, pivots), *directory)
        row, group = np.nonzero(bound >= _floors(qid[lo : lo + 256], q[lo : lo + 256], sample, k)[:, None])
        out.append(np.stack([row + lo, group]))
    pairs = np.concatenate(out, axis=1)
    return pairs[:, np.argsort(pairs[1], kind="stable")]


def search_group(queries: tuple[np.ndarray, np.ndarray], annuli: list[dict], pivots: np.ndarray, sample: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Top k of each query within these annuli (query row, id, score), and how many products were computed."""
    qid, q = queries
    n = len(q)
    floor = _floors(qid, q, sample, k)
    wide = q.astype(np.float64)
    shape = (np.array([a[c] for a in annuli]) for c in ("pivot", "low", "high", "norm"))
    bound = _bounds((wide**2).sum(1), _distances(wide, pivots), *shape) if annuli else np.zeros((n, 0))
    best_rows, best_ids, best_score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    done = 0
    for j in np.argsort(-bound.max(0), kind="stable") if n else []:
        live = np.flatnonzero(bound[:, j] >= floor)
        if not len(live):
            continue
        ids, data = np.frombuffer(annuli[j]["ids"], np.int64), _wide(annuli[j]["data"], q.shape[1])
        score = exact_scores(q[live], data)
        done += score.size
        open_ = (score >= floor[live][:, None]) & (qid[live][:, None] != ids[None])
        r, c = np.nonzero(open_)
        best_rows, best_ids, best_score = _slots(np.concatenate([best_ids, ids[c]]), np.concatenate([best_rows, live[r]]), np.concatenate([best_score, score[r, c]]), k)
        count = np.bincount(best_rows, minlength=n)
        full = np.flatnonzero(count >= k)
        last = np.searchsorted(best_rows, full, "right") - 1
        floor[full] = np.maximum(floor[full], best_score[last])
    return best_rows, best_ids, best_score, done


def topk_search(df: DataFrame, k: int = 5, scale: int = 256, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", query_group: int = 4096, annulus_group: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row whose id `every` divides, against all rows."""
    spark = df.sparkSession
    B.small_batches(spark, 4096)
    vectors = integer_vectors(df, scale, id_col, vec_col)
    counts = {r.dim: (r.n, r.q) for r in vectors.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()}
    out = None
    for dim, (n, n_queries) in sorted(counts.items()):
        if n_queries:
            part = _search_dim(vectors.where(F.col("dim") == dim), dim, n, n_queries, k, every, query_group, annulus_group)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _search_dim(vectors: DataFrame, dim: int, n: int, n_queries: int, k: int, every: int, query_group: int, annulus_group: int) -> DataFrame:
    spark = vectors.sparkSession
    thin = vectors if n <= SAMPLE else vectors.where(F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(1 << 40)) < int((1 << 40) * SAMPLE / n))
    got = sorted(thin.select("vec_id", "v").limit(2 * SAMPLE).collect()) or vectors.select("vec_id", "v").limit(SAMPLE).collect()
    sample = np.array([r.vec_id for r in got]), np.array([r.v for r in got], np.int64)
    # rows that share an id count once in the sample, so its k-th best stays a bound for any reading of repeats
    _, first = np.unique(sample[0], return_index=True)
    sample = sample[0][first], sample[1][first]
    shipped = spark.sparkContext.broadcast((choose_pivots(sample[1]), sample))  # bounded by SAMPLE

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shipped.value[0]
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch["v"], dim).astype(np.float64), pivots)
                near = d.argmin(1)
                yield pa.record_batch([batch["vec_id"], pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), batch["v"]], ["vec_id", "pivot", "distance", "v"])

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    annulus_group = max(annulus_group, -(-n // (ANNULUS * MOST_GROUPS // 4)))
    keyed = vectors.select("vec_id", "v").mapInArrow(key, "vec_id long, pivot int, distance double, v array<long>")
    ordered = keyed.repartitionByRange(max(partitions, n // (2 * annulus_group * ANNULUS) + 1), "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")

    def annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, group, last = B._task(), 0, -1, (-1, 0)
        for batch in batches:
            pivot = np.asarray(batch["pivot"])
            edges = np.concatenate([[0], np.flatnonzero(np.diff(pivot)) + 1, [len(pivot)]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for at in range(lo, hi, ANNULUS):
                    piece = batch.slice(at, min(ANNULUS, hi - at))
                    data, distance = _matrix(piece["v"], dim), np.asarray(piece["distance"])
                    if last[0] != pivot[at] or last[1] >= annulus_group:  # neighbours around one pivot share a group
                        group, last = group + 1, (int(pivot[at]), 0)
                    last = last[0], last[1] + 1
                    row = [(task << 32) + group, (task << 32) + serial, piece.num_rows, distance[0], distance[-1], int(pivot[at]), dim, float((data.astype(np.float64) ** 2).sum(1).max()), np.asarray(piece["vec_id"]).tobytes(), _small(data)]
                    serial += 1
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary())
                    yield pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["g", "block", "rows", "low", "high", "pivot", "dim", "norm", "ids", "data"])

    index = B.cut(ordered.mapInArrow(annuli, BLOCKS))
    groups = index.groupBy("g").agg(F.first("pivot").alias("pivot"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm")).limit(MOST_GROUPS + 1).collect()
    if len(groups) > MOST_GROUPS:
        raise ValueError("more groups of annuli than the directory may hold")
    names = np.array([r.g for r in groups], np.int64)
    directory = spark.sparkContext.broadcast((names, tuple(np.array([r[c] for r in groups]) for c in ("pivot", "low", "high", "norm"))))  # at most MOST_GROUPS rows

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (pivots, some), (names, shape) = shipped.value, directory.value
        held, serial = [], 0
        ids, v = np.zeros(0, np.int64), np.zeros((0, dim), np.int64)
        for batch in batches:
            held.append(batch)
        if held:
            ids = np.concatenate([np.asarray(b["vec_id"]) for b in held])
            v = np.concatenate([_matrix(b["v"], dim) for b in held])
        for lo in range(0, len(ids), query_group):
            asks = (B._task() << 20) + serial
            serial += 1
            q = ids[lo : lo + query_group], v[lo : lo + query_group]
            row, group = live_groups(q, shape, pivots, some, k)
            begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])[: len(group)])
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(group)], strict=False):
                who = row[a:b]
                yield pa.record_batch([pa.array([names[group[a]]]), pa.array([asks], pa.int64()), pa.array([who.astype(np.int32).tobytes()], pa.binary()), pa.array([q[0][who].tobytes()], pa.binary()), pa.array([_small(q[1][who])], pa.binary())], ["g", "asks", "rows", "ids", "data"])

    n_packs = -(-n_queries // query_group)
    asked = keyed.where(F.col("vec_id") % every == 0).repartitionByRange(n_packs, "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    sent = B.cut(asked.mapInArrow(send, "g long, asks long, rows binary, ids binary, data binary"))
    wanted = index.withColumnRenamed("g", "held").join(sent.select(F.col("g").alias("held"), F.col("asks").alias("wanted_by")), "held")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pivots, some = shipped.value
        names, kinds = ["query_row", "query_id", "vec_id", "score"], [pa.int64()] * 4
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        asks, rows, ids, data = (left[c][0].as_py() for c in ("asks", "rows", "ids", "data"))
        qid, number = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int32).astype(np.int64)  # a query's place in its pack, as rows may share an id
        row, found, score, _ = search_group((qid, _wide(data, dim)), right.sort_by("block").to_pylist(), pivots, some, k)
        return pa.table([pa.array((asks << 20) + number[row]), pa.array(qid[row]), pa.array(found), pa.array(score)], names)

    found = sent.groupBy("g", "asks").cogroup(wanted.groupBy("held", "wanted_by")).applyInArrow(run, "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
