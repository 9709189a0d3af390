"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader.

Each text becomes a sparse vector in three blocks: words, word pairs, and triples of word shapes (case, length, what it ends in,
repeats its predecessor). A block's values are shares of its n-grams, so that long and short texts compare.
Fitting takes at most SAMPLE labelled rows (those with the least hash of their id); the weights, DIMENSIONS
floats, are broadcast, and every text is scored by a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lattica.llm.common import held_out, text_bytes
from lattica.llm.words import bounded_batches, text_buffers

BITS = 20
DIMENSIONS = 1 << BITS
#: Labelled rows that the fit takes at most, each with all its n-grams.
SAMPLE = 5_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-3
THRESHOLD = 0.3
#: Weight of a block's shares, so that one n-gram of a few moves the score.
SCALE = 4.0

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordCodes(dict):
    """word -> 56 bits of its lower-case hash, then 8 bits of its shape. At most max_words are kept."""

    max_words = 120_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.max_words:
            self.clear()
        letters = word.rstrip(b".,;:!?$%&*#|)\"'")
        tail = word[len(letters) :]
        case = 0 if letters == letters.lower() else 1 if letters[1:] == letters[1:].lower() else 2 if letters == letters.upper() else 3
        kind = 3 if not letters else 1 if letters.isdigit() else 2 if any(c in b"0123456789@/\\<>={}[]_|" for c in letters) else 0
        end = 0 if not tail else 1 if tail in (b".", b",") else 2 if len(tail) == 1 else 3
        shape = 1 + case + 4 * kind + 16 * end + 64 * (len(word) > 5) + 128 * (len(word) > 14)
        self[word] = code = (xxh64_intdigest(letters.lower() or tail) >> 8 << 8) | min(shape, 254)
        return code


def grams(codes: WordCodes, text: bytes) -> list[np.ndarray]:
    """Feature numbers of a text, block by block."""
    words = text.split()
    if not words:
        return [np.empty(0, np.int64)] * 3
    c = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    h, shape = c >> np.uint64(8), (c & np.uint64(255))
    same = np.empty(len(c), bool)
    same[0], same[1:] = False, h[1:] == h[:-1]
    shape = np.where(same, np.uint64(255), shape)
    shift = np.uint64(64 - BITS)
    one = (h * _M1) >> shift
    two = ((h[:-1] * _M2 + h[1:]) * _M1) >> shift
    three = (((shape[:-2] * np.uint64(257) + shape[1:-1]) * np.uint64(257) + shape[2:] + np.uint64(1 << 40)) * _M1) >> shift
    return [x.astype(np.int64) for x in (one, two, three)]


def dot(weights: np.ndarray, blocks: list[np.ndarray]) -> float:
    return float(weights[0] + sum(SCALE * weights[b].mean() for b in blocks if len(b)))


def vector(blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values) of a text, whole; feature 0 also is the intercept."""
    i = np.concatenate([*blocks, [0]])
    v = np.concatenate([*(np.full(len(b), SCALE / max(1, len(b))) for b in blocks), [1.0]])
    at, back = np.unique(i, return_inverse=True)
    return at.astype(np.int32), np.bincount(back, v, len(at)).astype(np.float32)


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """The texts one by one, in UTF-8; null counts as empty."""
    data, ends = text_buffers(column)
    return (data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True))


def fit(samples: Sequence[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights by FTRL-proximal of (feature numbers, values, label). No samples: all weights are 0."""
    z, n = np.zeros(DIMENSIONS, np.float32), np.zeros(DIMENSIONS, np.float32)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(samples)):
            at, x, y = samples[k]
            zi, ni = z[at].astype(np.float64), n[at].astype(np.float64)
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w.astype(np.float32)


class _Samples:
    """Rows of an Arrow table (y, feature numbers, values) as samples."""

    def __init__(self, rows: pa.Table):
        self.y, self.at, self.x = rows.column("y").to_pylist(), rows.column("at").combine_chunks(), rows.column("x").combine_chunks()

    def __len__(self) -> int:
        return len(self.y)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        return np.frombuffer(self.at[int(k)].as_buffer(), np.int32), np.frombuffer(self.x[int(k)].as_buffer(), np.float32), self.y[int(k)]


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", remainder: int = 0, sample: int = SAMPLE) -> np.ndarray:
    """Fits on labelled rows that aren't held out (crc32(id as text) mod 5 = remainder); null labels are left out.

    Of repeated labels for one id the smallest counts.
    """
    bounded_batches(spark)
    rows = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull() & ~held_out(id, remainder)).groupBy(F.col(id).alias("_id")).agg(F.min(label).alias("_y"))
    chosen = rows.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    at = docs.select(F.col(id).alias("_id"), text_bytes(text).alias("_t")).join(F.broadcast(chosen), "_id").select("_id", "_y", "_t")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for b in batches:
            rows = [vector(grams(codes, t)) for t in texts_of(b.column(2))]
            yield pa.record_batch([b.column(0), b.column(1).cast(pa.int32()), *(pa.array([x[k].tobytes() for x in rows], pa.binary()) for k in range(2))], ["i", "y", "at", "x"])

    kind = docs.schema[id].dataType.simpleString()
    got = at.mapInArrow(features, f"i {kind}, y int, at binary, x binary").toArrow().sort_by("i")
    return fit(_Samples(got))


def scored(spark: SparkSession, docs: DataFrame, weights: np.ndarray, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a column score: the probability of label 1, for every whole text; null counts as empty. Repeated rows: each. docs must not have
    a column of that name."""
    sent = spark.sparkContext.broadcast(weights.tobytes())
    keep, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, w = WordCodes(), np.frombuffer(sent.value, np.float32)
        for b in batches:
            s = np.array([dot(w, grams(codes, t)) for t in texts_of(b.column(at))])
            yield pa.record_batch([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(s, -35, 35))), pa.float64())], [*keep, score])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{score}` double"])
    return docs.mapInArrow(run, schema)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", remainder: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: id, held_out, score, predicted (1 if score >= threshold).

    A null or empty text has the intercept's score. No labels: every score is 0.5. Repeated rows: a row each. Labels of
    unknown ids are ignored. An empty table: no rows.
    """
    weights = train(spark, docs, labels, id, text, label, remainder)
    rows = scored(spark, docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), weights, "_text")
    return rows.select(F.col("_id").alias(id), held_out("_id", remainder).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
