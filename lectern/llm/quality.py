"""Quality classifier (5): positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled rows of quality 1 in the training folds; the unlabelled sample is web text whatever
its label. A small network over form features of the whole text minimises

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

with the sigmoid loss. The class prior pi is the least ratio of unlabelled to positive mass over upper
score sets of a first positive-versus-unlabelled fit: the unlabelled mass of any set is at least pi times the positive.

The fit uses at most `most` positives and `most` unlabelled rows (a bounded sample); every whole text is scored, and
only its text enters the score.

Defined cases: null and empty texts get the same score, that of the empty text's features; without positives all
scores are 0.5; equal texts get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import small_batches
from .sampling import at_most, held_out, thinned

_class_of = np.zeros(256, np.uint8)  # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 white, 5 sentence marks, 6 multi-byte
_class_of[ord("a") : ord("z") + 1] = 1
_class_of[ord("A") : ord("Z") + 1] = 2
_class_of[ord("0") : ord("9") + 1] = 3
_class_of[[9, 10, 11, 12, 13, 32]] = 4
_class_of[[ord(c) for c in ".,;:?'\"()-"]] = 5
_class_of[128:] = 6
_ends = re.compile(r"[.!?](?:\s|$)")
FEATURES = 24


def features(text: str | None) -> np.ndarray:
    """Form of the whole text: character classes, repetition of words and lines, word and sentence lengths."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(raw))
    share = np.bincount(_class_of[raw], minlength=7) / n
    words = text.split()
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    counts, n_words, n_lines = Counter(words), max(1, len(words)), max(1, len(lines))
    top = counts.most_common(1)[0][1] if counts else 0
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    pairs = Counter(zip(words, words[3:], strict=False))
    marks = np.bincount(raw, minlength=128)[[ord(c) for c in "|!#$%&*<>{}=_/@\\"]] / n
    sentences = max(1, len(_ends.findall(text)))
    upper = sum(w.isupper() and len(w) > 1 for w in words) / n_words
    odd = sum(not w[-1:].isalnum() and w[-1:] not in ".,;:?'\")-" for w in words) / n_words
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n_words
    barred = sum("|" in x for x in lines) / n_lines
    return np.array(
        [
            *share, again, barred, np.log1p(len(words)), len(counts) / n_words, top / n_words, len(set(lines)) / n_lines, np.log1p(n_words / n_lines),
            lengths.mean() / 10, lengths.max() / 100 if lengths.max() < 100 else 1.0, len(pairs) / max(1, len(words) - 3), np.log1p(n_words / sentences), upper, odd,
            marks.sum(), marks[0], marks[1], np.log1p(len(words)) / np.log1p(n_words + len(counts)),
        ],
        np.float64,
    )


class Net:
    """One hidden layer of tanh units, trained with Adam on (non-negative) positive-unlabelled risk."""

    def __init__(self, x: np.ndarray, hidden: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.p = [rng.normal(0, 0.3, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]

    def hidden(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z, np.tanh(z @ self.p[0] + self.p[1])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x)[1] @ self.p[2] + self.p[3][0]

    def fit(self, pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int = 1500, batch: int = 512, rate: float = 5e-3, decay: float = 1e-4, seed: int = 55) -> Net:
        """prior None: plain positive-versus-unlabelled logistic fit, for estimating the prior."""
        rng = np.random.default_rng(seed)
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for t in range(1, steps + 1):
            a, b = pos[rng.integers(0, len(pos), batch)], unl[rng.integers(0, len(unl), batch)]
            x = np.concatenate([a, b])
            z, h = self.hidden(x)
            g = h @ self.p[2] + self.p[3][0]
            s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            slope = s * (1 - s)
            d = np.zeros(2 * batch)
            if prior is None:
                d[:batch], d[batch:] = (s[:batch] - 1) / batch, s[batch:] / batch
            else:
                rest = s[batch:].mean() - prior * s[:batch].mean()  # loss of a negative is s, of a positive 1 - s
                if rest >= 0:
                    d[:batch], d[batch:] = -2 * prior * slope[:batch] / batch, slope[batch:] / batch
                else:  # step back out of the negative part
                    d[:batch], d[batch:] = prior * slope[:batch] / batch, -slope[batch:] / batch
            back = d[:, None] * self.p[2] * (1 - h * h)
            grads = [z.T @ back + decay * self.p[0], back.sum(0), h.T @ d + decay * self.p[2], d.sum(keepdims=True)]
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Least unlabelled-to-positive mass ratio of the sets {score >= t}, over t that keep a tenth of the positives."""
    half = len(pos) // 2
    net = Net(np.concatenate([pos, unl])).fit(pos[:half] if half > 50 else pos, unl, None, steps=600)
    p, u = np.sort(net.margin(pos[half:] if half > 50 else pos)), np.sort(net.margin(unl))
    t = np.quantile(p, np.linspace(0, 0.9, 91))
    mass_p = 1 - np.searchsorted(p, t) / len(p)
    mass_u = 1 - np.searchsorted(u, t) / len(u)
    slack = 1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u))
    return float(np.clip(np.min((mass_u + slack * 0.5) / mass_p), 0.05, 0.95))


def train(docs: DataFrame, labels: DataFrame, most: int = 6000) -> tuple[Net, float] | None:
    """The fitted network and the estimated prior."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id"), F.col("text")).where(~held_out()).withColumn("one", F.lit(1))
    trusted = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(~held_out() & (F.col("quality") == 1)).select("doc_id").distinct()
    trusted = at_most(thinned(trusted.withColumn("one", F.lit(1)), "one", most, 5), "one", 2 * most).select("doc_id", F.xxhash64("doc_id").alias("pick"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t).tobytes() for t in batch["text"].to_pylist()]
            yield pa.record_batch([pa.array(rows, pa.binary()), pa.array([1] * len(rows), pa.int32()), batch["pick"]], ["x", "one", "pick"])

    def collect(df: DataFrame) -> np.ndarray:
        """Features of at most 2 * `most` rows; texts are left where they are."""
        some = df.select("text", "pick").mapInArrow(extract, "x binary, one int, pick long")
        got = sorted(bytes(r.x) for r in at_most(some, "one", 2 * most).collect())
        rng = np.random.default_rng(1)
        return np.array([np.frombuffer(x) for x in got]).reshape(-1, FEATURES)[rng.permutation(len(got))]

    # the sampled ids have a proven bound of 2 * most rows
    pos = collect(texts.join(F.broadcast(trusted), "doc_id"))
    unl = collect(thinned(texts, "one", most, 50))
    if len(pos) < 2 or len(unl) < 2:
        return None
    prior = estimate_prior(pos, unl)
    return Net(np.concatenate([pos, unl])).fit(pos, unl, prior), prior


def quality(docs: DataFrame, labels: DataFrame, most: int = 6000, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = train(docs, labels, most)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: one small network

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if shipped.value is None:
            return pd.Series(np.full(len(texts), 0.5))
        x = np.stack([features(t if isinstance(t, str) else "") for t in texts]) if len(texts) else np.zeros((0, FEATURES))
        return pd.Series(1 / (1 + np.exp(-np.clip(shipped.value[0].margin(x), -30, 30))))

    rows = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= cut).cast("int"))
