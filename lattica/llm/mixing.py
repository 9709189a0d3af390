"""Mixing to target weights by soft membership.

A classifier (softmax regression over hashed words), fitted on a labelled table, gives every document a posterior over the
domains. Rates r, one for each document, minimise the squared distance of expected domain token totals, the sum of
r * tokens * posterior, from their targets, by projected gradient: in the metric in which a token counts the same in every document a step is
r <- clip(r - posterior . v), v = (sum of tokens * posterior * posterior^T)^-1 (totals - targets). A step is one aggregation of
D sums over all documents; only v, D numbers, passes between steps, and a document's rate is replayed from them.
Where bounds hold such a step back, longer ones, and those by the matrix over the documents that may still move only, are tried in one
more aggregation, and the best is taken.
Distances are in the metric of the matrix over all documents; what is left of them at the end is logged.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import text_bytes, written
from lattica.llm.words import bounded_batches, split_words

log = logging.getLogger(__name__)

BITS = 16
#: Labelled rows that the fit takes at most, each with all its words.
SAMPLE = 4_000
EPOCHS, RATE, SCALE = 3, 0.5, 20.0
#: Steps at most; a distance that is left is logged as a warning.
STEPS = 30
#: Relative distance from the targets at which steps end.
NEAR = 1e-5
#: A step that leaves more than this part of the squared distance is held back by bounds.
SLOW = 0.1
#: Where totals may grow, the factor beyond the least that no domain must shrink for: soft members of other domains add a little.
GROWN = 1.03
#: Copies of a row that are made at once, and copies that a task makes about, where some row has more than the former.
COPIES, TASK_COPIES = 1_000, 1_000_000


def slots_of(texts: pa.Array) -> list[np.ndarray]:
    """Feature number of each word of each text; punctuation counts as part of the word."""
    words = split_words(texts)
    slots = (words.hashes >> np.uint64(64 - BITS)).astype(np.int32)
    return [slots[a:b] for a, b in zip(words.ends[:-1], words.ends[1:], strict=True)]


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], domains: int) -> np.ndarray:
    """(features + intercept, domains) weights, by gradient steps with a rate of its own for each weight. samples: distinct features, their counts, domain."""
    w = np.zeros(((1 << BITS) + 1, domains), np.float64)
    g2 = np.full_like(w, 1e-3)
    rows = [(np.append(at, 1 << BITS), np.append(n * SCALE / max(1, n.sum()), 1.0), y) for at, n, y in samples]
    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            s = x @ w[at]
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None]
            g2[at] += g * g
            w[at] -= RATE * g / np.sqrt(g2[at])
    return w.astype(np.float32)


def train(spark: SparkSession, docs: DataFrame, labelled: DataFrame, domains: list[str], id: str = "doc_id", text: str = "text", domain: str = "domain", sample: int = SAMPLE) -> np.ndarray:
    """Fits on at most `sample` rows of labelled (id, domain), those with the least hash of the id. Other domains are left out."""
    rows = labelled.filter(F.col(domain).isin(domains) & F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).agg(F.min(domain).alias("_y"))
    chosen = rows.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    at = docs.select(F.col(id).alias("_id"), text_bytes(text).alias("_t")).join(F.broadcast(chosen), "_id").select("_id", "_y", "_t")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.unique(s, return_counts=True) for s in slots_of(b.column(2))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([s.astype("<u2").tobytes() for s, _ in out], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in out], pa.binary())], ["i", "y", "s", "n"])

    got = at.mapInArrow(features, f"i {docs.schema[id].dataType.simpleString()}, y string, s binary, n binary").toArrow().sort_by("i")
    return fit([(np.frombuffer(s, "<u2").astype(np.int64), np.frombuffer(n, "<u4"), domains.index(y)) for y, s, n in zip(*(got.column(k).to_pylist() for k in (1, 2, 3)), strict=True)], len(domains))


def memberships(spark: SparkSession, docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """docs with __tokens (words) and __p (posterior of each domain); docs must not have columns of these names."""
    sent, keep, n, at = spark.sparkContext.broadcast(weights.tobytes()), docs.columns, weights.shape[1], docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(sent.value, np.float32).reshape(-1, n)
        for b in batches:
            tokens, scores = [], np.empty((b.num_rows, n))
            for k, s in enumerate(slots_of(b.column(at))):
                tokens.append(len(s))
                scores[k] = w[-1] + (SCALE * w[s].mean(0) if len(s) else 0)
            p = np.exp(scores - scores.max(1, keepdims=True, initial=-1e9))
            p /= p.sum(1, keepdims=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * n, pa.int32()), pa.array(p.reshape(-1), pa.float64()))
            yield pa.record_batch([*b.columns, pa.array(tokens, pa.int64()), lists], [*keep, "__tokens", "__p"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "__tokens long", "__p array<double>"])
    return docs.mapInArrow(run, schema)


def _rate(steps: list[list[float]], low: float, high: float):
    """A document's rate after the steps: one fold over them, however many there are."""
    if not steps:
        return F.lit(1.0)
    dot = lambda v: sum((F.get("__p", F.lit(d)) * F.get(v, F.lit(d)) for d in range(len(steps[0]))), F.lit(0.0))
    return F.aggregate(F.lit(steps), F.lit(1.0), lambda r, v: F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), r - dot(v))))


def fit_rates(soft: DataFrame, targets: list[float], low: float = 0.0, high: float = 10.0, grow: bool = False) -> list[list[float]]:
    """The steps' vectors v. targets: shares of the domains; grow: the total rises until no domain must shrink.

    Domains that no document belongs to can't be met and get what the least squares give.
    """
    n = len(targets)
    p = [F.get("__p", F.lit(d)) for d in range(n)]
    cells = [F.sum(F.col("__tokens") * p[a] * p[b]).alias(f"m{a}_{b}") for a in range(n) for b in range(a, n)]

    def inverse_of(row) -> np.ndarray:
        m = np.array([[row[f"m{min(a, b)}_{max(a, b)}"] or 0.0 for b in range(n)] for a in range(n)])
        return np.linalg.pinv(m + np.eye(n) * 1e-9 * np.trace(m))

    first = soft.agg(*(F.sum(F.col("__tokens") * p[d]).alias(f"t{d}") for d in range(n)), *cells).first()
    now = np.array([first[f"t{d}"] or 0.0 for d in range(n)])
    if now.sum() == 0:
        return []
    share = np.array(targets) / sum(targets)
    total = GROWN * max(now[d] / share[d] for d in range(n) if share[d] > 0 and now[d] > 1e-6 * now.sum()) if grow else now.sum()
    goal = share * total
    inverse = inverse_of(first)
    far = lambda t: float((t - goal) @ inverse @ (t - goal))
    steps: list[list[float]] = []

    def best(tries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(totals, v) of the nearest of the steps tried, all in one aggregation."""
        weighed = soft.withColumn("__r", _rate(steps, low, high))
        moved = [F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.col("__r") - sum((p[d] * F.lit(float(v[d])) for d in range(n)), F.lit(0.0)))) for v in tries]
        got = weighed.select("__tokens", "__p", *(m.alias(f"__r{k}") for k, m in enumerate(moved))).agg(*(F.sum(F.col(f"__r{k}") * F.col("__tokens") * p[d]).alias(f"t{k}_{d}") for k in range(len(tries)) for d in range(n))).first()
        return min(((np.array([got[f"t{k}_{d}"] for d in range(n)]), v) for k, v in enumerate(tries)), key=lambda x: far(x[0]))

    while len(steps) < STEPS and np.abs(now - goal).max() > NEAR * goal.sum():
        v = inverse @ (now - goal)
        after, taken = best([v])
        if far(after) > SLOW * far(now):
            rate, down = _rate(steps, low, high), sum((p[d] * F.lit(float(v[d])) for d in range(n)), F.lit(0.0))
            free = soft.filter(((rate > low) | (down < 0)) & ((rate < high) | (down > 0))).agg(*cells).first()
            other = inverse_of(free) @ (now - goal)
            after, taken = min((after, taken), best([*(v * 2.0**k for k in range(1, 9)), *(other * 2.0**k for k in range(-4, 4))]), key=lambda x: far(x[0]))
        if far(after) >= far(now) * (1 - 1e-6):  # the bounds hold it here
            break
        now = after
        steps.append(taken.tolist())
    left = float(np.abs(now - goal).sum() / goal.sum())
    log.log(logging.WARNING if np.abs(now - goal).max() > NEAR * goal.sum() else logging.INFO, "mixing: %d steps, distance from the targets %.3g of the total, shares %s", len(steps), left, np.round(now / now.sum(), 5).tolist())
    return steps


def mix(spark: SparkSession, docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id: str = "doc_id", text: str = "text", domain: str = "domain", low: float = 0.0, high: float = 10.0, grow: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_tokens, p_<domain> for each domain of targets, rate. Other columns are ignored.

    A null or empty text has 0 tokens and the posterior of the intercept. Repeated rows count each. No labelled rows: equal
    posteriors. No tokens at all: every rate is 1. An empty table: no rows.
    """
    domains = sorted(targets)
    bounded_batches(spark)
    weights = train(spark, docs, labelled, domains, id, text, domain)
    # only what the steps need is written; texts stay where they are
    carried = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    soft = written(spark, memberships(spark, carried, weights, "_text").select("_id", "__tokens", "__p"), "memberships")
    steps = fit_rates(soft, [targets[d] for d in domains], low, high, grow)
    return soft.select(F.col("_id").alias(id), F.col("__tokens").alias("n_tokens"), *(F.get("__p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(domains)), _rate(steps, low, high).alias("rate"))


def repeated(soft: DataFrame, times: Column, columns: list[str], at_once: int = COPIES) -> DataFrame:
    """columns of soft, each row as often as times (long, 1 or more) says, however often that is.

    Rows with more than at_once copies go to tasks as parts of so many, so neither a list of all copies of a row nor a task that makes them all is needed.
    """
    counted = soft.withColumn("__times", times)
    each = lambda df, n: df.withColumn("__copy", F.explode(F.sequence(F.lit(1), n.cast("int")))).select(*columns)
    many = counted.filter(F.col("__times") > at_once)
    copies = many.agg(F.sum("__times")).first()[0]
    if not copies:
        return each(counted, F.col("__times"))
    spark = soft.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(copies / TASK_COPIES))
    last = F.floor((F.col("__times") - 1) / at_once)
    parts = many.select(*columns, "__times", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("__part")).repartition(tasks)
    rest = F.least(F.lit(at_once).cast("long"), F.col("__times") - F.col("__part") * at_once)
    return each(counted.filter(F.col("__times") <= at_once), F.col("__times")).unionByName(each(parts, rest))


def resampled(spark: SparkSession, docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id: str = "doc_id", text: str = "text", domain: str = "domain", high: float = math.inf) -> DataFrame:
    """The rows of docs, each once or more: floor(rate + u) times, u in [0, 1) hashed from id and text; rates are 1 or more, as high as targets ask.

    A text without words has no tokens to bring a domain nearer to its target and stays once; so does a null one, which counts as empty. A row with a null id
    stays once or more. Repeated rows are repeated alike. An empty table: no rows. docs must not have columns named __tokens, __p, __times, __part, __copy.
    """
    domains = sorted(targets)
    bounded_batches(spark)
    weights = train(spark, docs, labelled, domains, id, text, domain)
    columns = docs.columns
    soft = written(spark, memberships(spark, docs, weights, text), "memberships")
    steps = fit_rates(soft.select("__tokens", "__p"), [targets[d] for d in domains], 1.0, high, grow=True)
    u = F.pmod(F.xxhash64(id, text), F.lit(1 << 20)) / float(1 << 20)
    times = F.when(F.col("__tokens") > 0, F.floor(_rate(steps, 1.0, high) + u)).otherwise(F.lit(1).cast("long"))
    return repeated(soft, times, columns)
