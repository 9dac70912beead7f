"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of the lower-cased text, present or not.  Each is scaled by its
log-count ratio between toxic and other labelled texts; a logistic regression is fitted on the
scaled features.  N-grams that few labelled texts hold, or that tell little, have no weight, so
a long text gathers no noise from them.

The classifier is fitted on a bounded sample of labelled rows (``SAMPLE`` of each label, chosen by hash of the id); scores are
computed for every whole text.  Labels are learnt only from rows whose crc32(id as text) mod 3 is not 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlens.llm.common import SLICE_BYTES, slices, texts_of

#: n-gram lengths, hash buckets (as bits), and labelled rows of each label that the classifier is fitted on at most.
SIZES, BITS, SAMPLE = (3, 4, 5), 18, 1500
#: An n-gram counts if at least this share of the sample (and ``FEWEST`` texts) hold it, and its log-count ratio is at least so large.
SHARE, FEWEST, TELLING = 0.005, 6, 1.5
#: Weight decay, steps of the fit, weight of toxic texts in it (the others have the rest), and the score from which a text is toxic.
DECAY, STEPS, LEAN, THRESHOLD = 1e-3, 400, 0.9, 0.7
MIX = np.uint64(0x9E3779B97F4A7C15)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased (A-Z), each with a blank before and after; and where each begins (one more than texts)."""
    joined = "".join(f" {t} " for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    points[(points >= 65) & (points <= 90)] += np.uint64(32)
    return points, np.cumsum([0, *(len(t) + 2 for t in texts)])


def _hashed(points: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each place."""
    n = len(points) - size + 1
    key = np.full(max(n, 0), size, dtype=np.uint64)
    for k in range(size):
        key *= MIX
        key ^= points[k : n + k]
    key *= MIX
    return (key >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: list[str], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) of all n-grams inside one text, ``keep`` marking the buckets that count."""
    points, begin = _points(texts)
    text_of = np.repeat(np.arange(len(texts)), np.diff(begin))
    found = []
    for size in SIZES:
        bucket = _hashed(points, size)
        at = np.flatnonzero(keep[bucket]) if keep is not None else np.arange(len(bucket))
        at = at[text_of[at] == text_of[at + size - 1]]
        found.append((text_of[at] << BITS) | bucket[at])
    pair = np.unique(np.concatenate(found))
    return pair >> BITS, pair & ((1 << BITS) - 1)


def fit(labels: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Weights of buckets (ratio times coefficient) and bias, from texts' sorted distinct buckets."""
    size, n = 1 << BITS, len(labels)
    if not n:
        return np.zeros(size), 0.0
    rate = (labels.sum() + 1) / (n + 2)
    bias = float(np.log(rate / (1 - rate)))
    if labels.min() == labels.max():
        return np.zeros(size), bias
    toxic, other = np.zeros(size), np.zeros(size)
    for label, bucket in zip(labels.tolist(), held, strict=True):
        (toxic if label else other)[bucket] += 1
    ratio = np.log((toxic + 1) / (labels.sum() + 2)) - np.log((other + 1) / (n - labels.sum() + 2))
    ratio[(toxic + other < max(FEWEST, SHARE * n)) | (np.abs(ratio) < TELLING)] = 0
    used = np.flatnonzero(ratio)
    number = np.full(size, -1)
    number[used] = np.arange(len(used))
    kept = [x[x >= 0] for x in (number[bucket] for bucket in held)]
    row, column = np.repeat(np.arange(n), [len(x) for x in kept]), np.concatenate(kept)
    value = ratio[used[column]]
    coefficient, share = np.zeros(len(used)), np.where(labels == 1, LEAN / labels.sum(), (1 - LEAN) / (n - labels.sum()))
    moment, square = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    bias = 0.0
    for step in range(1, STEPS + 1):  # gradient steps with running moments
        score = np.bincount(row, weights=coefficient[column] * value, minlength=n) + bias
        wrong = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - labels) * share
        slope = np.append(np.bincount(column, weights=wrong[row] * value, minlength=len(used)) + DECAY * coefficient, wrong.sum())
        moment, square = 0.9 * moment + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        move = 0.02 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-10)
        coefficient, bias = coefficient - move[:-1], bias - float(move[-1])
    weights = np.zeros(size)
    weights[used] = coefficient * ratio[used]
    return weights, bias


def held_out(row_id: Column) -> Column:
    """Whether labels of an id are never learnt from; a null id has none."""
    return F.coalesce(F.crc32(row_id.cast("string")) % 3 == 1, F.lit(False))


def sample_of(docs: DataFrame, labels: DataFrame, id_column: str, text: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows of each label outside of the held-out part (text, toxic), those with the smallest hash of their id; one row of each id.

    A label counts if it is 0 or 1; an id labelled twice takes its larger label.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col(id_column).isNotNull() & ~held_out(F.col(id_column))).groupBy(id_column).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.select(F.col(id_column).alias("known_id"), "toxic")
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ranked = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("known_id"), "known_id").limit(limit) for k in (0, 1)]
    chosen = F.broadcast(ranked[0].union(ranked[1]))  # two times the limit at most
    met = rows.join(chosen, rows["id"] == chosen["known_id"])
    # rows that repeat an id are one row of the sample, whatever their texts
    return met.groupBy("id").agg(F.min_by("t", F.xxhash64("t")).alias("t"), F.first("toxic").alias("toxic")).select("t", "toxic")


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", limit: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit the classifier: features in tasks, the fit on the driver over the bounded sample's bucket numbers."""

    def work(batches: Iterator[pa.RecordBatch]):
        for part in slices(batches, 0, SLICE_BYTES // 8):  # all n-grams of a text, not only those with a weight
            row, bucket = features(texts_of(part.column(0)))
            cut = np.searchsorted(row, np.arange(part.num_rows + 1)).tolist()
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([bucket[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["toxic", "buckets"])

    rows = sample_of(docs, labels, id_column, text, limit).mapInArrow(work, "toxic int, buckets binary").collect()
    # one order whatever the tasks': the fit depends on it in its last digits
    rows.sort(key=lambda r: (r["toxic"], r["buckets"]))
    return fit(np.array([r["toxic"] for r in rows], dtype=np.int64), [np.frombuffer(r["buckets"], dtype="<i4") for r in rows])


def score_rows(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """Score of every whole text: row (a struct of all columns of ``docs`` as they are) and score (0 to 1).

    A null or empty text has the score of one without n-grams; repeated rows and null ids come back as they are; an empty table gives
    no rows.
    """
    weights, bias = model
    used = np.flatnonzero(weights)
    packed = (used.astype("<i4").tobytes(), weights[used].astype("<f8").tobytes())

    def work(batches: Iterator[pa.RecordBatch]):
        table = np.zeros(1 << BITS)
        table[np.frombuffer(packed[0], dtype="<i4")] = np.frombuffer(packed[1], dtype="<f8")
        keep = table != 0
        for part in slices(batches, 0, SLICE_BYTES // 4):  # a letter is several n-grams
            row, bucket = features(texts_of(part.column(0)), keep)
            total = np.bincount(row, weights=table[bucket], minlength=part.num_rows) + bias
            value = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(value)], names=["row", "score"])

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(text).alias("t"), F.struct("*").alias("row")).mapInArrow(work, schema)


def predicted(threshold: float = THRESHOLD) -> Column:
    return (F.col("score") >= threshold).cast("int")
