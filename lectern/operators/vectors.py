"""Vector joins inside a paper: exact top-k retrieval and pairwise cosine, in blocks.

Vectors of a paper are packed into blocks of bounded size; two blocks of a paper meet as one row, so the product
is one matrix multiplication and a large paper is many tasks, not one. Only what is asked for leaves a block pair:
running sums, pairs above a threshold, or the best k of each query. For pairs inside a paper near vectors share a block (`clustered`),
and blocks meet only where centers and radii allow a cosine that counts; so near pairs are exact without all block pairs. There blocks travel in
groups (`meetings`), each vector once for every group of its paper, so what is shuffled follows the input and not the pairs of blocks.

Defined cases: null vectors and ids take no part; NaN and infinite components count as zero; all vectors of a paper have one length; a paper with
one vector has no pairs and no row; repeated ids are separate vectors; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import DUPLICATE
from ..session import keep
from .ranges import running_sums

BLOCK = 512
GROUPS, GROUP_VALUES = 8, 1 << 21  # groups of a paper that does not fit one block; components a group holds at most, by more groups


def pack(vectors: DataFrame, paper: str, item: str, vec: str, block: int = BLOCK) -> DataFrame:
    """(paper, block, items, matrix): at most about `block` vectors a row; null vectors take no part."""
    rows = vectors.select(F.col(paper).alias("paper"), F.col(item).cast("long").alias("item"), F.col(vec).cast("array<double>").alias("v")).where("v is not null and item is not null")
    sizes = rows.groupBy("paper").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = rows.join(sizes, "paper").withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")))
    one = F.struct("item", "v")
    return dealt.groupBy("paper", "block").agg(F.array_sort(F.collect_list(one)).alias("rows")).select("paper", "block", F.col("rows.item").alias("items"), F.flatten("rows.v").alias("data"))


def clustered(vectors: DataFrame, paper: str, item: str, vec: str, block: int = BLOCK, pivots: int = 64) -> DataFrame:
    """As `pack`, with near vectors in one block, so that bounds of blocks tell something. A paper of one block stays as it is.

    Each vector of a larger paper goes to the nearest of at most `pivots` vectors of its paper (a choice by hash, one bounded row a paper);
    the vectors of a pivot are packed by hash.
    """
    loose = pack(vectors, paper, item, vec, block)
    kind = loose.schema["paper"].dataType.simpleString()
    rows = vectors.select(F.col(paper).alias("paper"), F.col(item).cast("long").alias("item"), F.col(vec).cast("array<double>").alias("v")).where("v is not null and item is not null")
    rank = F.row_number().over(Window.partitionBy("paper").orderBy(F.xxhash64("item"), "item"))
    chosen = rows.withColumn("rank", rank).where(F.col("rank") <= pivots).groupBy("paper").agg(F.flatten(F.collect_list("v")).alias("pivots"), F.count("*").alias("k"))
    large = loose.groupBy("paper").agg(F.count("*").alias("blocks")).where("blocks > 1").select("paper")
    asked = loose.join(chosen.join(large, "paper"), "paper", "left")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, data = _matrix(batch["items"][i].values, batch["data"][i].values)
                near = np.zeros(len(ids), np.int64)
                if batch["k"][i].is_valid:
                    p = np.nan_to_num(np.asarray(batch["pivots"][i].values, np.float64), nan=0.0, posinf=0.0, neginf=0.0).reshape(batch["k"][i].as_py(), -1)
                    near = ((p * p).sum(1)[None] - 2 * data @ p.T).argmin(1)
                flat = pa.array(data.ravel())
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * data.shape[1], pa.int32()), flat)
                yield pa.record_batch([_repeat(batch["paper"].slice(i, 1), len(ids)), pa.array(near, pa.int64()), pa.array(ids, pa.int64()), v], ["paper", "pivot", "item", "v"])

    dealt = asked.mapInArrow(assign, f"paper {kind}, pivot long, item long, v array<double>")
    packed = pack(dealt.select(F.struct("paper", "pivot").alias("both"), "item", "v"), "both", "item", "v", block)
    return packed.select("paper.paper", (F.col("paper.pivot") * (1 << 32) + F.col("block")).alias("block"), "items", "data")


def summaries(packed: DataFrame, paper_type: str, threshold: float = DUPLICATE) -> DataFrame:
    """A row a block: n, centroid, radius, sum of its vectors and of their squares, and of the pairs inside it the largest cosine (null without pairs) and how many are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, v = _matrix(batch["items"][i].values, batch["data"][i].values)
                center, radius = _ball(v)
                s = (v @ v.T)[_upper(ids, ids, True)]
                row = (len(ids), center.tolist(), radius, v.sum(0).tolist(), float((v * v).sum()), float(s.max()) if len(s) else None, int((s >= threshold).sum()))
                kinds = (pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int64())
                yield pa.record_batch([batch["paper"].slice(i, 1), batch["block"].slice(i, 1).cast(pa.int64()), *[pa.array([x], k) for x, k in zip(row, kinds, strict=True)]], ["paper", "block", "n", "center", "radius", "total", "squares", "best", "near"])

    return packed.mapInArrow(run, f"paper {paper_type}, block long, n long, center array<double>, radius double, total array<double>, squares double, best double, near long")


def live_pairs(blocks: DataFrame, paper_type: str, group: int = BLOCK) -> DataFrame:
    """(paper, x, y), x < y: pairs of a paper's blocks that can hold a cosine of `limit` or more. blocks: paper, block, center, radius, limit.

    The pairs that `meetings` multiplies, as a table of their own. Summaries meet in groups, so a paper of very many blocks is many tasks.
    """
    sizes = blocks.groupBy("paper").agg(F.ceil(F.count("*") / group).alias("groups"))
    dealt = blocks.join(sizes, "paper").withColumn("g", F.pmod(F.xxhash64("block"), F.col("groups")))
    one = F.array_sort(F.collect_list(F.struct("block", "center", "radius")))
    packs = dealt.groupBy("paper", "g").agg(one.alias("r"), F.min("limit").alias("limit")).select("paper", F.col("g").alias("block"), F.col("r.block").alias("items"), F.flatten("r.center").alias("data"), F.col("r.radius").alias("radius"), "limit")
    a = packs.select("paper", F.col("block").alias("gx"), F.col("items").alias("a_items"), F.col("data").alias("a_data"), F.col("radius").alias("a_radius"), "limit")
    b = packs.select("paper", F.col("block").alias("gy"), F.col("items").alias("b_items"), F.col("data").alias("b_data"), F.col("radius").alias("b_radius"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ids_a, c), (ids_b, d) = (_matrix(batch[f"{x}_items"][i].values, batch[f"{x}_data"][i].values) for x in "ab")
                r, s = (np.asarray(batch[f"{x}_radius"][i].values) for x in "ab")
                x, y = np.nonzero((_reach(c, r, d, s) + 1e-9 >= batch["limit"][i].as_py()) & (ids_a[:, None] < ids_b[None] if batch["gx"][i].as_py() == batch["gy"][i].as_py() else True))
                lo, hi = np.minimum(ids_a[x], ids_b[y]), np.maximum(ids_a[x], ids_b[y])
                yield pa.record_batch([_repeat(batch["paper"].slice(i, 1), len(x)), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["paper", "x", "y"])

    return a.join(b, "paper").where("gx <= gy").mapInArrow(run, f"paper {paper_type}, x long, y long")


def _ball(v: np.ndarray) -> tuple[np.ndarray, float]:
    """Center and radius of a block."""
    center = v.mean(0)
    return center, float(np.sqrt(((v - center) ** 2).sum(1).max()))


def _reach(c: np.ndarray, r: np.ndarray, d: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Vectors of two balls have a product of at most c.d + |c| s + |d| r + r s, where c and d are the centers, r and s the radii."""
    return c @ d.T + np.linalg.norm(c, axis=1)[:, None] * s[None] + r[:, None] * np.linalg.norm(d, axis=1)[None] + r[:, None] * s[None]


def meetings(packed: DataFrame) -> DataFrame:
    """(paper, gx, gy, second, block, items, data, limit): a paper's blocks are dealt to groups, and each block is there once for every group it meets.

    A paper of one block is one group; a larger one has a fixed number of groups, so its vectors are sent that often whatever its size, and more only where a
    group would hold more than `GROUP_VALUES` components. Rows of one (paper, gx, gy) are two groups, or one with itself.
    """
    sizes = packed.groupBy("paper").agg(F.sum(F.size("items")).alias("n"), F.sum(F.size("data")).alias("values"))
    groups = F.when(F.col("n") <= BLOCK, 1).otherwise(F.greatest(F.lit(GROUPS), F.ceil(F.col("values") / GROUP_VALUES))).cast("int")
    dealt = packed.join(sizes.select("paper", groups.alias("groups")), "paper").withColumn("own", F.pmod(F.xxhash64("block"), F.col("groups")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    rows = each.select("paper", F.least("own", "other").alias("gx"), F.greatest("own", "other").alias("gy"), (F.col("own") > F.col("other")).alias("second"), "block", "items", "data", "limit")
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number is not merged by size: products cost time, not bytes
    return rows.repartition(n, "paper", "gx", "gy")


def _met(batches: Iterator[pa.RecordBatch], inside: bool) -> Iterator[tuple]:
    """(paper, a, b, same) of one (gx, gy): each block with all that it can reach, put together; with itself too, if asked."""
    sides, paper, limit, one = ([], []), None, None, False
    for batch in batches:
        for i in range(batch.num_rows):
            ids, v = _matrix(batch["items"][i].values, batch["data"][i].values)
            sides[batch["second"][i].as_py()].append((ids, v, *_ball(v)))
            paper, limit, one = batch["paper"].slice(i, 1), batch["limit"][i].as_py(), batch["gx"][i].as_py() == batch["gy"][i].as_py()
    first, others = sides[0], sides[0] if one else sides[1]
    if not first or not others:
        return
    b_ids, b, d, s = (np.concatenate([x[0] for x in others]), np.concatenate([x[1] for x in others]), np.stack([x[2] for x in others]), np.array([x[3] for x in others]))
    sizes = [len(x[0]) for x in others]
    for i, (ids, v, c, r) in enumerate(first):
        if one and inside:
            yield paper, (ids, v), (ids, v), True
        live = _reach(c[None], np.array([r]), d, s)[0] + 1e-9 >= limit
        if one:
            live[: i + 1] = False
        if live.any():
            rows = slice(None) if live.all() else np.repeat(live, sizes)
            yield paper, (ids, v), (b_ids[rows], b[rows]), False


def _matrix(items: pa.Array, data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(items)
    return ids, np.nan_to_num(np.asarray(data, np.float64), nan=0.0, posinf=0.0, neginf=0.0).reshape(len(ids), -1)


def block_pairs(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """Rows (paper, a_items, a_data, b_items, b_data, same) of block pairs; within one table each pair once."""
    other = left if right is None else right
    a = left.select("paper", F.col("block").alias("x"), F.col("items").alias("a_items"), F.col("data").alias("a_data"))
    b = other.select("paper", F.col("block").alias("y"), F.col("items").alias("b_items"), F.col("data").alias("b_data"))
    joined = a.join(b, "paper")
    if right is None:
        joined = joined.where("x <= y")
    return joined.withColumn("same", F.col("x") == F.col("y") if right is None else F.lit(False))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            a = _matrix(batch["a_items"][i].values, batch["a_data"][i].values)
            b = _matrix(batch["b_items"][i].values, batch["b_data"][i].values)
            yield batch["paper"].slice(i, 1), a, b, batch["same"][i].as_py()


def _upper(a: np.ndarray, b: np.ndarray, same: bool) -> np.ndarray:
    """Which pairs of two blocks count: each unordered pair of different items once."""
    return np.triu(np.ones((len(a), len(b)), bool), 1) if same else np.ones((len(a), len(b)), bool)


def pair_sums(packed: DataFrame, paper_type: str, threshold: float = DUPLICATE) -> DataFrame:
    """(paper, pairs, cosine_sum, cosine_max, near) over all unordered pairs of a paper with at least two vectors.

    The sum follows from the vectors' sum: twice the products of all pairs is the square of the sum less the sum of squares. Blocks meet only where
    their bound reaches the threshold or the largest cosine inside the paper's blocks; all other pairs can neither be near nor the largest.
    """
    packed = keep(packed)
    found = keep(summaries(packed, paper_type, threshold))
    sums = found.groupBy("paper").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"), F.max("best").alias("best"), F.sum("near").alias("near_inside"))
    square = found.select("paper", F.posexplode("total").alias("place", "value")).groupBy("paper", "place").agg(F.sum("value").alias("value")).groupBy("paper").agg(F.sum(F.col("value") * F.col("value")).alias("square"))
    limits = sums.select("paper", F.least(F.lit(threshold), F.coalesce("best", F.lit(float("-inf")))).alias("limit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paper, (_, a), (_, b), _ in _met(batches, False):
            s = a @ b.T
            yield pa.record_batch([paper, pa.array([s.max()]), pa.array([int((s >= threshold).sum())], pa.int64())], ["paper", "largest", "near"])

    met = meetings(packed.join(limits, "paper")).groupBy("paper", "gx", "gy")
    across = met.applyInArrow(run, f"paper {paper_type}, largest double, near long").groupBy("paper").agg(F.max("largest").alias("largest"), F.sum("near").alias("near_across"))
    out = sums.where("n > 1").join(square, "paper").join(across, "paper", "left")
    return out.select(
        "paper", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), ((F.col("square") - F.col("squares")) / 2).alias("cosine_sum"),
        (F.col("near_inside") + F.coalesce("near_across", F.lit(0))).alias("near"), F.greatest("best", "largest").alias("cosine_max"),
    )


def near_pairs(packed: DataFrame, paper_type: str, threshold: float = DUPLICATE) -> DataFrame:
    """(paper, a, b, cosine), a < b, for pairs at or above the threshold; blocks whose bound is below it never meet."""
    packed = keep(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paper, (ids_a, a), (ids_b, b), same in _met(batches, True):
            s = a @ b.T
            i, j = np.nonzero(np.triu(s >= threshold, 1) if same else s >= threshold)
            lo, hi = np.minimum(ids_a[i], ids_b[j]), np.maximum(ids_a[i], ids_b[j])
            yield pa.record_batch([_repeat(paper, len(i)), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(s[i, j])], ["paper", "a", "b", "cosine"])

    met = meetings(packed.withColumn("limit", F.lit(threshold))).groupBy("paper", "gx", "gy")
    return met.applyInArrow(run, f"paper {paper_type}, a long, b long, cosine double")


def _repeat(one: pa.Array, n: int) -> pa.Array:
    return one.take(pa.array(np.zeros(n, np.int64)))


def scored(queries: DataFrame, passages: DataFrame, paper_type: str, k: int | None, skip_self: bool = False) -> DataFrame:
    """(paper, query, passage, score): of every block pair the k best passages of each query, ties to smaller ids; None: all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paper, (ids_a, a), (ids_b, b), _ in _each(batches):
            s = a @ b.T
            if skip_self:
                s[ids_a[:, None] == ids_b[None]] = -np.inf
            order = np.broadcast_to(np.arange(len(ids_b)), s.shape) if k is None else np.lexsort((np.broadcast_to(ids_b, s.shape), -np.round(s, 12)), axis=1)[:, :k]
            rows, found = np.repeat(np.arange(len(ids_a)), order.shape[1]), order.ravel()
            real = np.isfinite(s[rows, found])
            rows, found = rows[real], found[real]
            yield pa.record_batch([_repeat(paper, len(rows)), pa.array(ids_a[rows], pa.int64()), pa.array(ids_b[found], pa.int64()), pa.array(s[rows, found])], ["paper", "query", "passage", "score"])

    return block_pairs(queries, passages).mapInArrow(run, f"paper {paper_type}, query long, passage long, score double")


def top_k(queries: DataFrame, passages: DataFrame, paper_type: str, k: int, skip_self: bool = False) -> DataFrame:
    """(paper, query, passage, score, rank): the k best passages of each query in its paper; ties to smaller ids.

    Every block pair keeps k per query, and the ranks are merged by a window, so no task sees a whole paper.
    """
    rank = F.row_number().over(Window.partitionBy("paper", "query").orderBy(F.desc(F.round("score", 12)), "passage"))
    return scored(queries, passages, paper_type, k, skip_self).withColumn("rank", rank).where(F.col("rank") <= k)


def full_rankings(queries: DataFrame, passages: DataFrame, paper_type: str, skip_self: bool = False) -> DataFrame:
    """As `top_k` with every passage of the paper. Ranks are counted over ranges, so a paper of any size is many tasks; each query makes a row a passage, so ask few."""
    rows = scored(queries, passages, paper_type, None, skip_self).withColumn("_lower", -F.round("score", 12))
    return running_sums(rows, ["paper", "query"], ["_lower", "passage"], {"rank": F.lit(1).cast("long")}).drop("_lower")


def union_evidence(ranked: DataFrame, quota_each: int | None = None, quota_all: int | None = None) -> DataFrame:
    """Passages in question-major order, first occurrence only: (paper, passage, query, rank, ord).

    quota_each bounds the ranks a question contributes; quota_all stops after that many picked passages.
    """
    rows = ranked if quota_each is None else ranked.where(F.col("rank") <= quota_each)
    first = rows.groupBy("paper", "passage").agg(F.min(F.struct("query", "rank")).alias("at"))
    order = F.row_number().over(Window.partitionBy("paper").orderBy("at.query", "at.rank"))
    out = first.select("paper", "passage", "at.query", "at.rank", order.alias("ord"))
    return out if quota_all is None else out.where(F.col("ord") <= quota_all)


def walk_evidence(ranked: DataFrame, per_question: int = 6, firsts: DataFrame | None = None) -> DataFrame:
    """TOP-7 as a walk: question after question its full ranking, until per_question x questions passages are picked: (paper, passage, query, rank, ord).

    As the first question ranks every passage of its paper, the walk never gets to a second one. ranked: full rankings (paper, query, passage, rank), of
    all questions, or of the first ones alone if firsts(paper, query, questions) tells each paper's first question and how many it has.
    """
    counted = ranked.groupBy("paper").agg(F.min("query").alias("query"), F.count_distinct("query").alias("questions")) if firsts is None else firsts
    first = counted.select("paper", "query", (F.col("questions") * per_question).alias("most"))
    return ranked.join(first, ["paper", "query"]).where(F.col("rank") <= F.col("most")).select("paper", "passage", "query", "rank", F.col("rank").alias("ord"))


def _headers(n: Column) -> Column:
    """Characters of the first n headers, each with its number: 17 besides the digits."""
    digits = F.length(n.cast("string"))
    return 17 * n + digits * (n + 1) - ((F.pow(F.lit(10), digits) - 1) / 9).cast("long")


def char_budget(blocks: DataFrame, paper: str, order: str, length: str, budget: int, joint: int = 2, headers: bool = False) -> DataFrame:
    """The leading blocks of each paper whose running length (with joints, and headers that number them) stays within the budget; the first always.

    Rows are dealt by ranges of (paper, order). A range first drops what is beyond the budget in it alone, but for the row that oversteps, which keeps later
    ranges out as well; so what is numbered afterwards is bounded by the budget and not by the paper.
    """
    each = (F.coalesce(F.col(length), F.lit(0)) + joint).cast("long")
    ranged = blocks.withColumn("_each", each).repartitionByRange(paper, order).withColumn("_range", F.spark_partition_id())
    inside = Window.partitionBy("_range", paper).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    leading = ranged.withColumn("_inside", F.sum("_each").over(inside)).where(F.col("_inside") - F.col("_each") <= budget)
    whole = Window.partitionBy(paper).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = leading.withColumn("ord", F.row_number().over(Window.partitionBy(paper).orderBy(order)).cast("long")).withColumn("running", F.sum("_each").over(whole))
    if headers:
        rows = rows.withColumn("running", F.col("running") + _headers(F.col("ord")))
    return rows.where((F.col("running") <= budget) | (F.col("ord") == 1)).select(*blocks.columns, "running", "ord")
