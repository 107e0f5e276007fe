"""Language identification (6): blended-spectrum string kernels, Nystroem landmarks, kernel ridge regression.

A text is the set of hashed byte n-grams (n = 1, 2, 3) of its lower-cased letters; the kernel of two texts is the
cosine of their presence vectors. One-versus-rest ridge regression is solved in the span of the landmarks. As the
kernel is linear in presence, the landmarks' coefficients fold into one (buckets x languages) matrix, and a batch
of texts is scored by one matrix product.

The model is fitted on about `per_language` documents, 2 x that at most, of each language (a bounded sample of labelled rows of the
training folds, drawn in one pass); tasks add up the normal equations of their rows, and the driver gets these sums, the landmarks
(at least one a language) and nothing else. Every labelled language can be predicted; with over LANGUAGES of them training
raises ValueError, as such a column names no languages. Every whole text is scored.

Defined cases: null texts and texts without a letter are `und` with score 0; so is everything if no row
is labelled; equal texts get equal answers; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import cut, small_batches
from .sampling import at_most, held_out, thinned

BUCKETS = 1 << 15
LANGUAGES = 4096  # more label values than this are an error, never left out
SUM_TASKS = 16
PIECE = 4096  # doubles; the sums of all tasks meet piece by piece, so the driver gets one set of sums however many tasks there are
UND = "und"
_letter = re.compile(r"[^\W\d_]")
_plain = np.full(256, 32, np.uint8)  # everything that is no letter is a space; bytes of other scripts stay
_plain[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_plain[128:] = np.arange(128, 256)
CHUNK = 1 << 20


def presence(text: str) -> np.ndarray:
    """Which buckets the n-grams of the whole text fall into."""
    raw = _plain[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])].astype(np.uint32)
    out = np.zeros(BUCKETS, bool)
    for lo in range(0, len(raw), CHUNK):  # with the two bytes after a chunk, so long texts take little memory
        code = raw[lo : lo + CHUNK + 2]
        out[code] = True
        two = code[:-1] * np.uint32(257) + code[1:]
        out[(two * np.uint32(2654435761)) >> np.uint32(17)] = True
        three = two[:-1] * np.uint32(263) + code[2:]
        out[(three * np.uint32(2246822519)) >> np.uint32(17)] = True
    return out


def _rows(packed_bits: list[bytes]) -> np.ndarray:
    """Unit presence vectors of packed bit rows."""
    phi = np.unpackbits(np.frombuffer(b"".join(packed_bits), np.uint8)).reshape(len(packed_bits), BUCKETS).astype(np.float32)
    phi /= np.maximum(1, np.sqrt(phi.sum(1, keepdims=True)))
    return phi


Fitted = tuple[list[str], np.ndarray, np.ndarray]


def landmark_root(marks: np.ndarray) -> np.ndarray:
    """Maps kernel values against the landmarks to coordinates in their span, where the kernel is the inner product."""
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    return vector[:, good] / np.sqrt(value[good])


def sums(bits: list[bytes], langs: list[str], names: list[str], marks: np.ndarray, root: np.ndarray, weight: dict[str, float]) -> list[np.ndarray]:
    """What the ridge regression needs of these rows, weighted so that each language counts alike: Z'Z, Z'Y, and the sums of Z, Y and the weights."""
    d, place = root.shape[1], {name: i for i, name in enumerate(names)}
    zz, zy, z_sum, y_sum, total = np.zeros((d, d)), np.zeros((d, len(names))), np.zeros(d), np.zeros(len(names)), np.zeros(1)
    for lo in range(0, len(bits), 64):  # a few rows at a time are unpacked
        z = (_rows(bits[lo : lo + 64]) @ marks.T).astype(np.float64) @ root
        w = np.array([weight[lang] for lang in langs[lo : lo + 64]])
        y = np.full((len(z), len(names)), -1.0)
        y[np.arange(len(z)), [place[lang] for lang in langs[lo : lo + 64]]] = 1.0
        zw = z * w[:, None]
        zz += zw.T @ z
        zy += zw.T @ y
        z_sum += zw.sum(0)
        y_sum += w @ y
        total += w.sum()
    return [zz, zy, z_sum, y_sum, total]


def solve(parts: list[np.ndarray], names: list[str], marks: np.ndarray, root: np.ndarray, ridge: float = 1e-2) -> Fitted:
    """Languages, the folded (buckets x languages) matrix, and the intercepts, from summed normal equations."""
    zz, zy, z_sum, y_sum, (total,) = parts
    center, offset = z_sum / total, y_sum / total
    w = np.linalg.solve(zz - total * np.outer(center, center) + ridge * total * np.eye(len(zz)), zy - total * np.outer(center, offset))
    return names, marks.T @ (root @ w).astype(np.float32), (offset - center @ w).astype(np.float32)


def train(docs: DataFrame, per_language: int = 400, text_col: str = "text", lang_col: str = "lang", landmarks: int = 256) -> Fitted | None:
    """The fitted model; None if no row is labelled."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang, pick in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), batch["pick"].to_pylist(), strict=True):
                if _letter.search(text):
                    yield pa.record_batch([pa.array([lang]), pa.array([np.packbits(presence(text)).tobytes()], pa.binary()), pa.array([pick], pa.int64())], ["lang", "bits", "pick"])

    some = thinned(rows, "lang", per_language, 6, LANGUAGES).select("text", "lang", "pick").mapInArrow(features, "lang string, bits binary, pick long")
    some = cut(at_most(some, "lang", 2 * per_language))
    counts = {r.lang: r.n for r in some.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    names = sorted(counts)
    share = max(1, landmarks // len(names))
    chosen = some.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("bits"), "bits"))).where(F.col("turn") <= share)
    marks = _rows([bytes(r.bits) for r in chosen.orderBy("lang", "turn").collect()])
    root, rows_in_all = landmark_root(marks), sum(counts.values())
    weight = {name: rows_in_all / (len(names) * n) for name, n in counts.items()}
    shipped = docs.sparkSession.sparkContext.broadcast((np.packbits(marks > 0, axis=1), root))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, root = shipped.value
        marks, total = _rows([row.tobytes() for row in packed]), None
        for batch in batches:  # in the order of the sort below, so that sums do not depend on how rows arrive
            part = sums([b.as_py() for b in batch["bits"]], batch["lang"].to_pylist(), names, marks, root, weight)
            total = part if total is None else [x + y for x, y in zip(total, part, strict=True)]
        if total is not None:
            flat = np.concatenate([x.ravel() for x in total])
            for piece, lo in enumerate(range(0, len(flat), PIECE)):
                yield pa.record_batch([pa.array([piece], pa.int64()), pa.array([flat[lo : lo + PIECE].tobytes()], pa.binary())], ["piece", "sums"])

    def meet(rows: pa.Table) -> pa.Table:
        total = None
        for one in sorted(rows["sums"].to_pylist()):  # in an order of their own
            total = np.frombuffer(one) if total is None else total + np.frombuffer(one)
        return pa.table({"piece": rows["piece"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    dealt = some.repartition(SUM_TASKS, "bits").sortWithinPartitions("lang", "bits").select("lang", "bits")
    parts = dealt.mapInArrow(add_up, "piece long, sums binary").groupBy("piece").applyInArrow(meet, "piece long, sums binary")
    flat = np.concatenate([np.frombuffer(bytes(r.sums)) for r in sorted(parts.collect(), key=lambda r: r.piece)])
    shipped.unpersist()
    d, c = root.shape[1], len(names)
    zz, zy, z_sum, y_sum, total = np.split(flat, np.cumsum([d * d, d * c, d, c]))
    return solve([zz.reshape(d, d), zy.reshape(d, c), z_sum, y_sum, total], names, marks, root)


def prediction(spark: SparkSession, model: Fitted | None) -> Callable:
    """A column function: text -> struct(lang_pred, score)."""
    small_batches(spark)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shipped = spark.sparkContext.broadcast(model)  # at most buckets x LANGUAGES

    @F.pandas_udf(kind)
    def score(texts: pd.Series) -> pd.DataFrame:
        model, n = shipped.value, len(texts)
        lang, value = np.full(n, UND, object), np.zeros(n)
        usable = [i for i, t in enumerate(texts) if isinstance(t, str) and _letter.search(t)] if model else []
        for lo in range(0, len(usable), 128):
            rows = usable[lo : lo + 128]
            names, matrix, offset = model
            bits = np.stack([presence(texts.iloc[i]) for i in rows]).astype(np.float32)
            f = bits @ matrix / np.sqrt(bits.sum(1, keepdims=True)) + offset
            best = f.argmax(1)
            lang[rows] = np.array(names, object)[best]
            value[rows] = np.clip((f[np.arange(len(rows)), best] + 1) / 2, 0, 1)
        return pd.DataFrame({"lang_pred": lang, "score": value})

    return score


def language_id(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    model = train(docs, per_language)
    rows = docs.select("doc_id", held_out().alias("held_out"), prediction(docs.sparkSession, model)(F.col("text")).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")
