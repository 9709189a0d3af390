"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are taken over all training texts. A count c is quantised to a level, and the filter holds the items
(n-gram, 1) ... (n-gram, level): probing level after level until one is missing gives the count back to a factor of
sqrt(2). The filter has slices, one for each range of n-gram hashes; each is built where the range's counts are. N-grams of every
count are held, at BITS_PER_ITEM bits an item or more. Where all items surely fit in FILTER_BITS, the slices go to the driver and
out as a broadcast. Beyond that no one holds the whole filter: texts are read in chunks, each chunk sends its distinct n-grams
to their ranges, where a slice as large as the range's items need is built and probed, and gets their levels back.

P(w | v) = L c(v w) / c(v) + (1 - L) (c(w) + 0.5) / (N + 0.5 (V + 1)), counts as the filter gives them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import dropped, held_out, text_bytes, written
from lattica.llm.words import bounded_batches, mixed, split_words
from lattica.llm.wordstats import summed_by_document, word_counts

#: 32 MB: what is broadcast has this bound.
FILTER_BITS = 1 << 28
BITS_PER_ITEM = 8
PROBES = 3
#: Pairs of every count are held.
LEAST_PAIR = 1
LAMBDA = 0.2
#: Counts up to 2^48.
LEVELS = 97
#: Word pairs that a map task gathers before it hands their counts on.
FLUSH = 1_000_000
#: Tokens of a range of n-gram hashes, about.
RANGE_TOKENS = 1_000_000
#: Ranges as a power of two at most: with more tokens than RANGE_TOKENS << 20 ranges grow.
MOST_RANGE_BITS = 20
#: Tokens of a chunk of texts, about.
CHUNK = 500_000
#: The most levels for each occurrence: level(2, 1) = 3, less beyond.
MOST_LEVELS = 1.5

_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Bytes of a word's hash: words that share one are told apart by neither filter nor scores; of 10^9 words about 4 in a million do.
WORD_BYTES = 6
_START, _END = np.uint64(0x243F6A8885A3), np.uint64(0x13198A2E0370)


def word_hashes(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - 8 * WORD_BYTES)


def word_grams(h: np.ndarray) -> np.ndarray:
    return mixed(h * _A[1] + np.uint64(1))


def pair_grams(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _A[2] + b * _A[3] + np.uint64(2))


def tokens(texts: pa.Array, most: int = 300_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes: start, the words and end of text after text; end of each text among them), for some texts at a time: at most `most` words or one text."""
    words = split_words(texts)
    n, at = len(words.ends) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(words.ends, words.ends[at] + most, "right")) - 1)
        a, b = words.ends[at], words.ends[to]
        ends = words.ends[at + 1 : to + 1] - a + 2 * np.arange(1, to - at + 1)
        out = np.empty(int(b - a) + 2 * (to - at), np.uint64)
        inner = np.ones(len(out), bool)
        inner[ends - 1] = inner[np.concatenate([[0], ends[:-1]])] = False
        out[inner] = word_hashes(words.hashes[a:b])
        out[np.concatenate([[0], ends[:-1]])], out[ends - 1] = _START, _END
        yield out, ends
        at = to


def _pairs(t: np.ndarray) -> np.ndarray:
    """Pairs of joined texts: none reaches from one text into the next."""
    a, b = t[:-1], t[1:]
    inside = ~((a == _END) & (b == _START))
    return pair_grams(a[inside], b[inside])


GRAMS = "part int, kind int, grams binary, counts binary"


def _dealt(kind: int, grams: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """A row for each range of hashes; grams are sorted."""
    part = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
    ends = np.searchsorted(part, np.arange((1 << bits) + 1))
    rows = [(p, grams[a:b].tobytes(), counts[a:b].astype("<u8").tobytes()) for p, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "kind", "grams", "counts"])


def level(counts: np.ndarray, least: int) -> np.ndarray:
    """1 at the least count, one more for each factor of sqrt(2); 0 below it."""
    c = np.maximum(counts.astype(np.float64), 1e-9)
    return np.where(counts >= least, np.minimum(LEVELS, 1 + np.floor(2 * np.log2(c / least) + 1e-9)), 0).astype(np.int64)


def count_of(levels: np.ndarray, least: int) -> np.ndarray:
    """The count that a level stands for (0: none): the middle of the whole numbers that have it."""
    low = np.ceil(least * 2 ** ((levels - 1) / 2) - 1e-6)
    high = np.maximum(low, np.ceil(least * 2 ** (levels / 2) - 1e-6) - 1)
    return np.where(levels > 0, np.sqrt(low * high), 0.0)


def gram_counts(spark: SparkSession, docs: DataFrame, vocabulary: DataFrame, text: str, bits: int) -> DataFrame:
    """(part, kind, grams, counts, levels): exact counts by range of hashes, sorted, and the items they make; kind 1: words, 2: pairs."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for t, _ in tokens(b.column(0)):
                held.append(t)
                n += len(t)
                if n > FLUSH:
                    yield _dealt(2, *np.unique(_pairs(np.concatenate(held)), return_counts=True), bits)
                    held, n = [], 0
        if held:
            yield _dealt(2, *np.unique(_pairs(np.concatenate(held)), return_counts=True), bits)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = [], []
        for b in batches:
            grams.append(word_grams(word_hashes(split_words(b.column(0)).hashes)))  # a word for each row
            counts.append(b.column(1).to_numpy())
        if grams:
            g, c = np.concatenate(grams), np.concatenate(counts)
            order = np.argsort(g)
            yield _dealt(1, g[order], c[order], bits)

    def merge(key, rows):
        kind = key[1].as_py()
        g = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("grams").to_pylist()])
        c = np.concatenate([np.frombuffer(x, "<u8") for x in rows.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(g, kind="stable")
        g, c = g[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        g, c = g[first], np.add.reduceat(c, first)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "kind": pa.array([kind], pa.int32()), "grams": pa.array([g.tobytes()], pa.binary()), "counts": pa.array([c.astype("<u8").tobytes()], pa.binary()), "levels": pa.array([int(level(c, 1).sum())], pa.int64())})

    both = docs.select(text_bytes(text).alias("t")).mapInArrow(pairs, GRAMS).unionByName(vocabulary.select("word", "n").mapInArrow(words, GRAMS))
    return written(spark, both.groupBy("part", "kind").applyInArrow(merge, f"{GRAMS}, levels long"), "gram-counts")


def _bases(grams: np.ndarray, at: np.ndarray | int) -> np.ndarray:
    """Hash of (n-gram, level), from which its probes come."""
    x = grams + np.asarray(at, np.uint64) * _A[1]
    return (x ^ (x >> np.uint64(32))) * _A[0]


def _place(bases: np.ndarray, slice_bits: int, probe: int) -> np.ndarray:
    """Bit of the n-gram's slice for a probe."""
    return (bases * _A[probe + 1]) >> np.uint64(64 - slice_bits)


def bits_for(items: float) -> int:
    """Bits of a slice, as a power of two: BITS_PER_ITEM an item or more."""
    return max(6, math.ceil(math.log2(max(1, items * BITS_PER_ITEM))))


def slice_of(g: np.ndarray, lev: np.ndarray, slice_bits: int) -> bytes:
    """The slice that holds (n-gram, 1) ... (n-gram, level)."""
    on = np.zeros(1 << slice_bits, bool)
    while len(g := g[lev > 0]):
        lev = lev[lev > 0]
        bases = _bases(g, lev)
        for k in range(PROBES):
            on[_place(bases, slice_bits, k).astype(np.int64)] = True
        lev = lev - 1
    return np.packbits(on, bitorder="little").tobytes()


class Filter:
    """The whole filter, for probing."""

    def __init__(self, data: bytes, bits: int, slice_bits: int):
        self.data, self.bits, self.slice_bits = np.frombuffer(data, np.uint8), bits, slice_bits

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Highest level held of each n-gram: probes level after level."""
        out, at, g = np.zeros(len(grams), np.int64), np.arange(len(grams)), grams
        start = (grams >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(grams), np.uint64)) << np.uint64(self.slice_bits)
        for lev in range(1, LEVELS + 1):
            bases = _bases(g, lev)
            for k in range(PROBES):
                p = start + _place(bases, self.slice_bits, k)
                keep = ((self.data[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                at, g, start, bases = at[keep], g[keep], start[keep], bases[keep]
                if not len(at):
                    return out
            out[at] = lev
        return out


def build_filter(spark: SparkSession, counts: DataFrame, bits: int, most: int = FILTER_BITS) -> tuple[bytes, int, int]:
    """(the filter, bits of a slice as a power of two, least count of a pair)."""
    items = counts.agg(F.coalesce(F.sum("levels"), F.lit(0)).alias("items")).first()["items"]
    if items * BITS_PER_ITEM > most:
        raise ValueError(f"{items} items need more than {most} bits: score by ranges")
    slice_bits, least = bits_for(items / (1 << bits)), LEAST_PAIR

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, kind, grams, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                on = slice_of(np.frombuffer(grams, np.uint64), level(np.frombuffer(c, "<u8"), least), slice_bits)
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([on], pa.binary())], ["part", "bits"])

    slices = counts.select("part", "kind", "grams", "counts").mapInArrow(build, "part int, bits binary").toArrow()
    step = (1 << slice_bits) // 8
    data = np.zeros((1 << bits) * step, np.uint8)
    for part, s in zip(slices.column(0).to_pylist(), slices.column(1), strict=True):
        data[part * step : (part + 1) * step] |= np.frombuffer(s.as_buffer(), np.uint8)
    return data.tobytes(), slice_bits, least


def log_shares(single: np.ndarray, pair: np.ndarray, z: float, weight: float) -> np.ndarray:
    """log10 P of each token, from its count and its count after the token before."""
    before = np.concatenate([[1.0], single[:-1]])
    share = np.where(before > 0, np.minimum(pair / np.maximum(before, 1e-9), 1.0), 0.0)
    lam = np.where(before > 0, weight, 0.0)
    return np.log10(lam * share + (1 - lam) * (single + 0.5) / z)


@dataclass
class Scorer:
    """Scores by a filter that a worker holds whole. n, v: tokens and distinct ones; starts: training texts."""

    filt: Filter
    n: int
    v: int
    starts: int
    least: int
    weight: float

    def scores(self, t: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 probability of each text, end included. Each distinct word and pair is probed once."""
        words, at = np.unique(t, return_inverse=True)
        counts = count_of(self.filt.levels(word_grams(words)), 1)
        counts[(words == _START) | (words == _END)] = self.starts
        single, pair = counts[at], np.zeros(len(t))
        inside = np.flatnonzero(t[1:] != _START)
        pairs, back = np.unique(pair_grams(t[inside], t[inside + 1]), return_inverse=True)
        pair[inside + 1] = count_of(self.filt.levels(pairs), self.least)[back]
        logs = log_shares(single, pair, self.n + 0.5 * (self.v + 1), self.weight)
        logs[t == _START] = 0
        return np.add.reduceat(logs, np.concatenate([[0], ends[:-1]]))


CHUNKS = {"sizes": "binary", "learn": "binary", "hashes": "binary", "singles": "binary"}
#: Bytes of an n-gram within its range.
SHORT = 5


def _packed(x: np.ndarray, width: int) -> bytes:
    """Whole numbers of so many low bytes, byte by byte in planes, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(b: bytes, width: int) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(b[8:], n * width, codec="zstd"), np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1)


def chunker():
    """For a batch (.., training text or not, text) the columns of CHUNKS, in the first row of each chunk of texts: tokens of each
    text, training or not, distinct words' hashes (frequent ones first), and each token's number among these."""

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        values: list[list] = []
        learn = b.column(b.num_columns - 2).to_numpy(zero_copy_only=False)
        for t, ends in tokens(b.column(b.num_columns - 1), CHUNK):
            words, at, n = np.unique(t, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            mine = learn[len(values) : len(values) + len(ends)].astype(bool)
            values.append([_packed(np.diff(ends, prepend=0), 4), _packed(mine, 1), _packed(words[order], WORD_BYTES), _packed(rank[at], 4)])
            values.extend([[None] * len(CHUNKS)] * (len(ends) - 1))
        return [pa.array([v[k] for v in values], pa.binary()) for k in range(len(CHUNKS))]

    return run


def chunk_grams(hashes: np.ndarray, singles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct n-grams, number of each word's among them, places of tokens with a token before, number of their pair's)."""
    t = hashes[singles]
    inside = np.flatnonzero(t[1:] != _START)
    pairs, at = np.unique(singles[inside] * len(hashes) + singles[inside + 1], return_inverse=True)
    grams = np.concatenate([word_grams(hashes), pair_grams(hashes[pairs // len(hashes)], hashes[pairs % len(hashes)])])
    order = np.argsort(grams)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return grams[order], rank[: len(hashes)], inside + 1, rank[len(hashes) :][at]


def scores_by_range(chunks: DataFrame, starts: int, z: float, weight: float, bits: int) -> DataFrame:
    """(_row, score) of each text: slices are built and probed range by range. chunks: (_row, columns of CHUNKS)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, sizes, learn, hashes, singles in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h, s = _unpacked(hashes, WORD_BYTES), _unpacked(singles, 4).astype(np.int64)
                grams, words, places, pairs = chunk_grams(h, s)
                seen = np.repeat(_unpacked(learn, 1).astype(bool), _unpacked(sizes, 4).astype(np.int64))
                word = seen & ((h != _START) & (h != _END))[s]  # start and end are counted apart
                n = np.bincount(words[s[word]], minlength=len(grams)) + np.bincount(pairs[seen[places]], minlength=len(grams))
                ends = np.searchsorted(grams >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
                short = (grams << np.uint64(bits)) >> np.uint64(64 - 8 * SHORT)
                rows = [(p, _packed(np.diff(short[a:e], prepend=np.uint64(0)), SHORT), _packed(n[a:e], 4)) for p, (a, e) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if e > a]
                yield pa.record_batch([pa.array([row] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary())))], ["_row", "part", "grams", "counts"])

    def probe(key, rows):
        grams = [np.cumsum(_unpacked(x, SHORT), dtype=np.uint64) for x in rows.column("grams").to_pylist()]  # sorted: sent as steps
        g, back = np.unique(np.concatenate(grams), return_inverse=True)
        c = np.bincount(back, np.concatenate([_unpacked(x, 4) for x in rows.column("counts").to_pylist()]), len(g))
        g, lev = g << np.uint64(64 - 8 * SHORT), level(c, 1)
        slice_bits = bits_for(int(lev.sum()))
        found = Filter(slice_of(g, lev, slice_bits), 0, slice_bits).levels(g)[back]
        ends = np.cumsum([len(x) for x in grams])
        return pa.table({"_row": rows.column("_row"), "part": rows.column("part"), "levels": pa.array([_packed(x, 1) for x in np.split(found, ends[:-1])], pa.binary())})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, sizes, hashes, singles, levels in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = _unpacked(singles, 4).astype(np.int64)
                _, words, places, pairs = chunk_grams(_unpacked(hashes, WORD_BYTES), s)
                counts = count_of(np.concatenate([_unpacked(x["levels"], 1) for x in levels]).astype(np.int64), 1)
                ends = np.cumsum(_unpacked(sizes, 4).astype(np.int64))
                first = np.concatenate([[0], ends[:-1]])
                single, pair = counts[words[s]], np.zeros(len(s))
                pair[places] = counts[pairs]
                single[first] = single[ends - 1] = starts
                logs = log_shares(single, pair, z, weight)
                logs[first] = 0
                yield pa.record_batch([pa.array(row + np.arange(len(ends)), pa.int64()), pa.array(np.add.reduceat(logs, first), pa.float64())], ["_row", "score"])

    chunks = chunks.filter("sizes IS NOT NULL")
    asked = chunks.select("_row", *CHUNKS).mapInArrow(ask, "_row long, part int, grams binary, counts binary")
    levels = asked.groupBy("part").applyInArrow(probe, "_row long, part int, levels binary")
    by_chunk = levels.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("part", "levels"))).alias("levels"))
    return chunks.select("_row", "sizes", "hashes", "singles").join(by_chunk, "_row").mapInArrow(score, "_row long, score double")


def score_texts(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", remainder: int = 1, weight: float = LAMBDA, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A text's tokens are its words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased) and an end. Training texts are those whose
    crc32(id as text) mod 5 isn't the remainder (a null id counts as the text ""). Null and empty texts: the end alone.
    Without training texts every base score is 0 and the model's is 0. Repeated rows: a row each, each counted. An empty table: no rows.
    """
    bounded_batches(spark)
    rows = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    learn = rows.filter(~held_out("_id", remainder))
    counted = written(spark, word_counts(learn, "_text", lower=True), "words")
    totals = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(1 + F.floor(2 * F.log2("n") + 1e-9)), F.lit(0)).alias("levels")).first()
    starts = learn.count()
    n, v = totals["n"] + starts, totals["v"] + bool(starts)
    z = n + 0.5 * (v + 1)

    bits = max(4, min(MOST_RANGE_BITS, math.ceil(math.log2(max(1, n / RANGE_TOKENS)))))
    vocabulary = counted.select("word", "n", F.lit(1).cast("long").alias("n_known"), F.log10((F.col("n") + 0.5) / z).alias("logs"))
    summed = {"n_known": "long", "logs": "double"}
    if (totals["levels"] + MOST_LEVELS * n) * BITS_PER_ITEM <= filter_bits:
        counts = gram_counts(spark, learn, counted, "_text", bits)
        data, slice_bits, least = build_filter(spark, counts, bits, filter_bits)
        dropped(spark, counts)
        sent = spark.sparkContext.broadcast(data)

        def scorer():
            model = Scorer(Filter(sent.value, bits, slice_bits), n, v, starts, least, weight)

            def score(b: pa.RecordBatch) -> list[pa.Array]:
                return [pa.array(np.concatenate([*(model.scores(t, ends) for t, ends in tokens(b.column(b.num_columns - 1))), np.empty(0)]))]

            return score

        sums = summed_by_document(spark, rows, ["_id"], vocabulary, summed, "_text", lower=True, extra={"score": "double"}, extra_of=scorer)
    else:
        marked = rows.withColumn("_learn", ~held_out("_id", remainder))
        sums = summed_by_document(spark, marked, ["_id", "_learn"], vocabulary, summed, "_text", lower=True, extra=CHUNKS, extra_of=chunker, then=lambda chunks: scores_by_range(chunks, starts, z, weight, bits))
    unseen = math.log10(0.5 / z)
    end = math.log10((starts + 0.5) / z)
    return sums.select(
        F.col("_id").alias(id), held_out("_id", remainder).alias("held_out"), (F.col("n_words") + 1).alias("n_tokens"), (F.col("n_known") + int(starts > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + (F.col("n_words") - F.col("n_known")) * F.lit(unseen) + F.lit(end)).alias("base_score"), "score",
    )
