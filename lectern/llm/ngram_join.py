"""N-gram Jaccard join (4): exact set-similarity components with set-relation skipping.

Candidates. Shingles are ordered by document frequency, counted over all documents (per 32-bit slot of a key
range; a shared slot only changes the order, never a result). By the prefix rule two linked sets share a
shingle among the first n - ceil(0.8 n) + 1 of each, and that shingle then has a frequency of at least two, so
only such prefix shingles are indexed and only sets that have one go further. Identical sets are one class.
Classes that meet in a prefix list within the size bound form families; no family loses a possible link.

A family beyond `task_shingles` is cut into chunks, near sets mostly into the same one, and a set goes only to the
chunks in which a set shares an indexed shingle with it within the size bound, so a family that hangs together by
single shingles costs what meets in it, not the square of its chunks.

Verification, in one task a family (or a chunk, or what meets of two chunks), uses the two skips of the method:
index lists are ordered by set size, so a probe reads only the block of positions whose sizes can qualify; and
the overlaps of a set close to an already answered pivot are derived from the pivot's overlaps through the
shingles in which the two differ. Sets already connected are not compared, and the triangle inequality on
Jaccard distance to the pivot rules out others.

Defined cases: null, empty and wordless texts have no set, link with nothing and are their own component; fewer
than five words count as one shingle; equal rows are separate documents of one class; a component whose ids are
all null has a null component_id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .components import connected_components

ROW_SCHEMA = "row_id long, doc_id long, n_shingles long, hi long, lo long, prefix array<long>, shingles binary"
TASK_SHINGLES = 1 << 21


def shingle_sets(body: bytes, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """ids and the sorted distinct shingle hashes of each document of a block."""
    ids, _, at, raw = B.decode_docs(body)
    sets = []
    for words in B.split_words(raw, at, lower=True):
        hashed = B.hash_words(words)
        if len(words) >= size:
            sets.append(np.unique(B.mix(B.window_hash(hashed, size))))
        elif words:
            sets.append(np.array([xxhash.xxh3_64_intdigest(hashed.tobytes(), seed=len(words))], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return ids, sets


def row_ids(block: int, n: int) -> np.ndarray:
    """Numbers of a block's documents: 23 bits of packing task, 20 of the task's block, 20 of the document."""
    task, serial = block >> 32, block & 0xFFFFFFFF
    if task >> 23 or serial >> 20 or n > 1 << 20:
        raise OverflowError(f"block {serial} of task {task} with {n} documents cannot be numbered")
    return ((task << 40) | (serial << 20)) + np.arange(n, dtype=np.int64)


def _slots(sets: list[np.ndarray], n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (part, slot) keys of a block, where each shingle's is, and how many of its sets have each."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    keys = ((flat % np.uint64(n_parts)) << np.uint64(32)) | (flat >> np.uint64(32))
    return np.unique(keys, return_inverse=True, return_counts=True)


def _link(a: int, b: np.ndarray, both: np.ndarray, share: int) -> np.ndarray:
    return 100 * both >= share * (a + b - both)


def family_links(sizes: np.ndarray, sets: list[np.ndarray], share: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each set of a family the index of a root that links reach it from, exactly as all pairs would give.

    With sides, only pairs of different sides count.
    """
    m = len(sets)
    order = np.argsort(sizes, kind="stable")
    size = sizes[order]
    side = None if side is None else side[order]
    flat = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(m), [len(sets[i]) for i in order])
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[token] > 1
    token, owner = token[shared], owner[shared]
    at = np.searchsorted(owner, np.arange(m + 1))
    key = np.sort(token.astype(np.int64) * m + owner)  # index lists by shingle, each by position (= size)

    def overlap(tokens: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """How many of the tokens each set at positions lo..hi-1 has; other positions of the lists are skipped."""
        a, b = np.searchsorted(key, tokens * m + lo), np.searchsorted(key, tokens * m + hi)
        n = b - a
        total = int(n.sum())
        if not total:
            return np.zeros(m, np.int64)
        where = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        return np.bincount(key[where] % m, minlength=m)

    root = np.arange(m)
    pivot, pivot_tokens, pivot_overlap, pivot_hi, far = -1, None, None, 0, None
    for i in range(m):
        hi = int(np.searchsorted(size * share, size[i] * 100, "right"))  # larger sets that can still qualify
        later = np.arange(i + 1, hi)
        later = later[root[later] != root[i]]
        if side is not None:
            later = later[side[later] != side[i]]
        if far is not None and root[pivot] == root[i] and hi <= pivot_hi:
            later = later[np.abs(far[later] - far[i]) <= 1 - share / 100 + 1e-9]
        if not len(later):
            continue
        own = token[at[i] : at[i + 1]].astype(np.int64)
        derived = False
        if pivot >= 0 and hi <= pivot_hi:
            only_pivot, only_own = np.setdiff1d(pivot_tokens, own, assume_unique=True), np.setdiff1d(own, pivot_tokens, assume_unique=True)
            if len(only_pivot) + len(only_own) < len(own):  # answers derived from the pivot's
                both = pivot_overlap - overlap(only_pivot, i + 1, hi) + overlap(only_own, i + 1, hi)
                derived = True
        if not derived:
            both = overlap(own, i + 1, m)
            pivot, pivot_tokens, pivot_overlap, pivot_hi = i, own, both, m
            far = 1 - both / np.maximum(1, size[i] + size - both)
            far[i] = 0.0
        hit = later[_link(size[i], size[later], both[later], share)]
        for other in np.unique(root[hit]):
            a, b = sorted((root[i], other))
            root[root == b] = a
    out = np.empty(m, np.int64)
    out[order] = order[root]
    return out


def postings(reps: DataFrame, share: int) -> DataFrame:
    """(rep, token, level) of each indexed shingle; sets within the size bound of each other share a level."""
    level = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(100 / share) * (1 - 1e-9)))
    rows = reps.select("rep", F.array(level, level + 1).alias("levels"), F.explode("prefix").alias("token"))
    return rows.select("rep", "token", F.explode("levels").alias("level"))


def deal(members: DataFrame, post: DataFrame, sizes: DataFrame, task_shingles: int) -> DataFrame:
    """(rep, n_shingles, family, own, x, y): each set in its own chunk (own, own), and in (x, y) where a set of the other chunk shares a posting.

    members has rep, n_shingles, family and near, a hash that near sets mostly share; sizes has each family's number of chunks.
    """
    heavy = members.groupBy("family", "near").agg(F.ceil(F.sum("n_shingles") / task_shingles).alias("parts"))
    own = F.pmod(F.pmod("near", "chunks") + F.pmod(F.xxhash64("rep"), "parts"), F.col("chunks"))
    placed = B.cut(members.join(sizes, "family").join(heavy, ["family", "near"]).select("rep", "n_shingles", "family", "chunks", own.alias("own")))
    spots = post.join(placed.where("chunks > 1").select("rep", "own"), "rep")
    chunks = spots.groupBy("token", "level").agg(F.collect_set("own").alias("others")).where("size(others) > 1")  # at most one entry a chunk
    meets = spots.join(chunks, ["token", "level"]).select("rep", "own", F.explode("others").alias("other")).where("own <> other").select("rep", "other").distinct()
    pairs = placed.select("rep", F.col("own").alias("other")).unionByName(meets).join(placed, "rep")
    return pairs.select("rep", "n_shingles", "family", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: int = 80, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """One row a document: row_id (unique), doc_id, n_shingles, component_id (smallest id that links of `share` per cent reach), kept.

    One row of each component is kept, the first by (doc_id, row_id), and one of its rows without an id.
    """
    return _joined(B.packed(docs, id_col, text_col), size, share, task_shingles)


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: int = 80, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """The rows of docs that ngram_join keeps, with all their columns."""
    carry = tuple(c for c in docs.columns if c not in (id_col, text_col))
    blocks = B.packed(docs, id_col, text_col, carry=carry)
    gone = _joined(blocks, size, share, task_shingles).where("not kept").select((F.shiftleft(F.shiftright("row_id", 40), 32) + F.shiftright("row_id", 20).bitwiseAND(F.lit((1 << 20) - 1))).alias("block"), "row_id")

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        table = pa.ipc.open_stream(left["body"][0].as_py()).read_all()
        stays = np.ones(table.num_rows, bool)
        stays[np.asarray(right["row_id"]) & ((1 << 20) - 1)] = False
        return table.set_column(1, "body", table["body"].cast(pa.binary())).filter(pa.array(stays))

    schema = ", ".join(["doc_id long, body binary", *[f"x_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)]])
    rows = blocks.select("block", "body").groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(keep, schema)
    source = {id_col: "doc_id", text_col: "body"} | {c: f"x_{i}" for i, c in enumerate(carry)}
    return rows.select(*[F.col(source[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def _joined(blocks: DataFrame, size: int, share: int, task_shingles: int) -> DataFrame:
    n_parts = B.ranges(blocks)

    def emit(block: int, body: bytes) -> list[tuple[int, int, bytes]]:
        _, sets = shingle_sets(body, size)
        keys, _, count = _slots(sets, n_parts)
        slot = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return [(p, block, B.pack_arrays(np.diff(slot[rows], prepend=np.uint32(0)), count[rows].astype(np.uint32))) for p, rows in B.by_part(keys >> np.uint64(32))]

    def decide(part: int, names: list[int], bodies: list[bytes]) -> list[tuple[int, int, bytes]]:
        each = [B.unpack_arrays(b, np.uint32, np.uint32) for b in bodies]
        _, where = np.unique(np.concatenate([np.cumsum(gap, dtype=np.uint32) for gap, _ in each]), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate([n for _, n in each])).astype(np.uint32)[where]
        total[total < 2] = 0
        out, lo = [], 0
        for name, (gap, _) in zip(names, each, strict=True):
            out.append((part, name, B.pack_arrays(total[lo : lo + len(gap)])))
            lo += len(gap)
        return out

    def choose(block: int, body: bytes, replies: dict[int, bytes]) -> pa.Table:
        ids, sets = shingle_sets(body, size) if body is not None else (np.zeros(0, np.int64), [])
        keys, where, _ = _slots(sets, n_parts)
        known = np.zeros(len(keys), np.uint32)
        for p, rows in B.by_part(keys >> np.uint64(32)):
            known[rows] = B.unpack_arrays(replies[p], np.uint32)[0]
        frequency, lo, prefix, hi_, lo_, kept = known[where], 0, [], [], [], []
        for one in sets:
            n = len(one)
            f = frequency[lo : lo + n]
            lo += n
            first = np.lexsort((one, np.maximum(f, 1)))[: n - (share * n + 99) // 100 + 1] if n else []
            marks = one[first][f[first] > 1] if n else one
            prefix.append(marks.view(np.int64))
            digest = np.frombuffer(xxhash.xxh3_128_digest(one.tobytes()), np.int64) if len(marks) else (None, None)
            hi_.append(digest[0])
            lo_.append(digest[1])
            kept.append(one.tobytes() if len(marks) else None)
        return pa.table(
            {
                "row_id": pa.array(row_ids(block, len(ids)), pa.int64()),
                "doc_id": pa.array(ids, pa.int64(), mask=ids == B.NO_ID),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "hi": pa.array(hi_, pa.int64()),
                "lo": pa.array(lo_, pa.int64()),
                "prefix": pa.array(prefix, pa.list_(pa.int64())),
                "shingles": pa.array(kept, pa.binary()),
            }
        )

    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    rows = B.cut(B.gather(blocks, B.resolve(B.scatter(blocks, emit), decide), choose, ROW_SCHEMA))
    some = rows.where("hi is not null")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    classes = B.cut(B.few_files(some.groupBy("hi", "lo").agg(F.min("row_id").alias("rep"), F.min(first).alias("first"), F.min(F.when(F.col("doc_id").isNull(), F.col("row_id"))).alias("first_null")), n_bytes))
    reps = B.cut(B.few_files(some.join(classes.select(F.col("rep").alias("row_id")), "row_id", "left_semi").select(F.col("row_id").alias("rep"), "n_shingles", "prefix", "shingles"), n_bytes))

    # classes that share an indexed shingle and are near in size belong to one family
    post = postings(reps, share)
    hubs = post.groupBy("token", "level").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    meets = post.join(hubs, ["token", "level"]).where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    families = connected_components(meets)

    near = F.array_min(F.transform("prefix", lambda token: F.xxhash64(token)))
    members = B.cut(B.few_files(reps.select("rep", "n_shingles", "shingles", near.alias("near")).join(families.select(F.col("node").alias("rep"), F.col("root").alias("family")), "rep"), n_bytes))
    sizes = members.groupBy("family").agg(F.ceil(F.sum("n_shingles") / task_shingles).alias("chunks"))
    most = sizes.agg(F.max("chunks")).first()[0] or 0
    dealt = members.select("rep", "n_shingles", "shingles", "family", *[F.lit(0).cast("long").alias(c) for c in ("own", "x", "y")])
    if most > 1:
        dealt = members.select("rep", "shingles").join(B.cut(deal(members.drop("shingles"), post, sizes, task_shingles)), "rep")
    total = dealt.agg(F.sum("n_shingles")).first()[0] or 0
    n_tasks = max(2 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // task_shingles))
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("family", "x", "y"), F.lit(n_tasks)))

    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, n, own = np.asarray(table["rep"]), np.asarray(table["n_shingles"]), np.asarray(table["own"])
        group = [np.asarray(table[c]) for c in ("family", "x", "y")]
        order = np.lexsort((rep, *group[::-1]))
        new = np.flatnonzero(np.concatenate([[True], np.any([g[order][1:] != g[order][:-1] for g in group], axis=0)]))
        bodies, a, b = table["shingles"], [], []
        for lo, hi in zip(new, [*new[1:], len(order)], strict=True):
            if hi - lo > 1:
                who = order[lo:hi]
                across = own[who] if group[1][who[0]] != group[2][who[0]] else None  # each chunk is compared with itself elsewhere
                root = family_links(n[who], [np.frombuffer(bodies[int(i)].as_py(), np.uint64) for i in who], share, across)
                moved = root != np.arange(len(who))
                a.append(rep[who][moved])
                b.append(rep[who][root[moved]])
        return pa.table({"a": pa.array(np.concatenate(a) if a else [], pa.int64()), "b": pa.array(np.concatenate(b) if b else [], pa.int64())})

    links = B.cut(B.few_files(dealt.groupBy("task").applyInArrow(verify, "a long, b long"), n_bytes))
    if most > 1:  # the links of one component may come from several chunk pairs
        found = connected_components(links)
    else:
        found = links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    rooted = classes.join(found.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    component = rooted.groupBy("root").agg(F.min("first").alias("first"), F.min("first_null").alias("first_null"))
    named = rooted.select("hi", "lo", "root").join(component, "root").select("hi", "lo", F.col("first.doc_id").alias("component_id"), F.col("first.row_id").alias("first"), "first_null")
    kept = (F.col("row_id") == F.col("first")) | F.coalesce(F.col("row_id") == F.col("first_null"), F.lit(False))
    linked = some.select("row_id", "doc_id", "n_shingles", "hi", "lo").join(named, ["hi", "lo"]).select("row_id", "doc_id", "n_shingles", "component_id", kept.alias("kept"))
    return rows.where("hi is null").select("row_id", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")).unionByName(linked)
