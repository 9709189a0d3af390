"""Best-fit packing by a grouping genetic algorithm.

Pieces are dealt to blocks of about BLOCK pieces; every block is a packing problem of its own. Each block is evolved on
ISLANDS islands (tasks with other seeds) for GENERATIONS generations: crossover injects whole well-filled bins of one parent into another,
bins that hold a duplicate are dissolved, and the displaced pieces are put back best fit first. Each island sends its elite
to the block's last round, where elites are crossed again. Pieces in poorly filled bins then leave
their blocks and are packed together, a group of blocks at a time, so the loss is not paid once for each block.

Best fit by falling size (the first of each pool) often needs as few bins as can be in its block; what evolves then is the mean squared fill: it
gathers the free room in few bins, whose pieces are all that leaves the block.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import text_bytes, written
from lattica.llm.words import bounded_batches

SEQUENCE = 4096
BLOCK = 2048
ISLANDS = 2
POPULATION = 4
#: Crossovers of an island, and of each round after it.
GENERATIONS = 10
#: Blocks whose poorly filled bins are packed together.
MERGED = 32
#: A bin is well filled from this share of the sequence on.
WELL = 0.995

Bins = list[list[int]]


def best_fit(sizes, items: list[int], capacity: int, bins: Bins | None = None) -> Bins:
    """Puts items, in the order given, into the fullest bin that holds them; bins: those already open."""
    bins = bins if bins is not None else []
    room = sorted((left, k) for k, b in enumerate(bins) if (left := capacity - sum([sizes[i] for i in b])))
    for i in items:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
        if left - sizes[i]:
            insort(room, (left - sizes[i], k))
    return bins


def fitness(sizes, bins: Bins, capacity: int) -> float:
    """Mean squared fill: few bins, and those full."""
    return sum([sum([sizes[i] for i in b]) ** 2 for b in bins]) / (capacity * capacity * max(1, len(bins)))


def crossover(sizes, a: Bins, b: Bins, capacity: int, rng: random.Random) -> Bins:
    """Injects well-filled bins of b into a; bins of a that hold one of their pieces dissolve and their rest is put back."""
    full = sorted(b, key=lambda x: -sum([sizes[i] for i in x]))
    injected = rng.sample(full[: max(1, len(full) * 3 // 4)], rng.randint(1, max(1, len(full) // 8)))
    there = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in a:
        if there.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in there]
    kept.sort(key=lambda x: sum([sizes[i] for i in x]))
    for x in kept[: max(1, len(kept) // 16)]:  # the emptiest bins are put back as well
        displaced += x
    kept = kept[max(1, len(kept) // 16) :]
    displaced.sort(key=lambda i: (-sizes[i], i))
    return best_fit(sizes, displaced, capacity, kept + [list(x) for x in injected])


def start(sizes, capacity: int, rng: random.Random, jitter: float) -> Bins:
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i] * (1 + jitter * rng.random()), i))
    return best_fit(sizes, order, capacity)


def evolve(sizes, capacity: int, seed: int, first: list[Bins] | None = None, generations: int = GENERATIONS) -> tuple[Bins, int]:
    """(the best packing found, bins of the greedy one that the pool starts with): the fewest bins, then the greatest mean squared fill."""
    rng = random.Random(seed)
    greedy = start(sizes, capacity, rng, 0.0)
    pool = [*(first or []), greedy]
    pool += [start(sizes, capacity, rng, 0.1) for _ in range(POPULATION - len(pool))]
    rank = lambda x: (len(x), -fitness(sizes, x, capacity))
    ranked = sorted(((rank(x), k, x) for k, x in enumerate(pool)), key=lambda y: y[:2])[:POPULATION]
    for g in range(generations if len(sizes) > 1 else 0):
        a, b = rng.sample(range(len(ranked)), 2)
        child = crossover(sizes, ranked[a][2], ranked[b][2], capacity, rng)
        ranked = sorted([*ranked, (rank(child), len(pool) + g, child)], key=lambda y: y[:2])[:POPULATION]
    return ranked[0][2], len(greedy)


def numbers_of(bins: Bins, n: int) -> np.ndarray:
    """The bin of each piece."""
    out = np.zeros(n, np.int64)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def bins_of(numbers: np.ndarray) -> Bins:
    order = np.argsort(numbers, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1)] if len(numbers) else []


def pieces(docs: DataFrame, id: str, text: str, capacity: int = SEQUENCE, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """(id, piece, start, length, ids_crc32): documents as ids with end_id after them, cut where longer than capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        from lattica.llm.wordbpe import word_ids

        words, end, step = word_ids(tokenizer), np.array([end_id], "<u4"), capacity * 4
        for b in batches:
            rows = []
            for id, own in zip(b.column(0).to_pylist(), words.encode(b.column(1)), strict=True):
                ids = np.concatenate([own, end]).astype("<u4").tobytes()
                if len(ids) <= step:
                    rows.append((id, 0, 0, len(ids) // 4, crc32(ids)))
                else:
                    rows += [(id, k, at // 4, len(ids[at : at + step]) // 4, crc32(ids[at : at + step])) for k, at in enumerate(range(0, len(ids), step))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(columns[0], b.schema[0].type), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], ["_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("_id"), text_bytes(text).alias("t")).mapInArrow(cut, f"_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_pieces(spark: SparkSession, cut: DataFrame, capacity: int = SEQUENCE, block: int = BLOCK) -> DataFrame:
    """cut (with a column length) and sequence_id, offset; generations and greedy_bins: the crossovers that the piece's problem went through, and
    the bins that best fit by falling size alone made of it."""
    cut = written(spark, cut.withColumn("_row", F.monotonically_increasing_id()), "cut")
    blocks = max(1, math.ceil(cut.count() / block))
    placed = cut.select("_row", "length", F.pmod(F.xxhash64("_row"), F.lit(blocks)).alias("block"))
    on_islands = placed.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    after = GENERATIONS * (ISLANDS + 1)

    def island(key, rows):
        rows = rows.sort_by([("length", "ascending"), ("_row", "ascending")])
        sizes = rows.column("length").to_pylist()
        bins, _ = evolve(sizes, capacity, seed=key[0].as_py() * 101 + key[1].as_py())
        return rows.append_column("bin", pa.array(numbers_of(bins, len(sizes))))

    elites = on_islands.groupBy("block", "island").applyInArrow(island, "_row long, length long, block long, island int, bin long")

    def settle(key, rows):
        rows = rows.sort_by([("island", "ascending"), ("length", "ascending"), ("_row", "ascending")])
        n = len(rows) // ISLANDS
        one = rows.slice(0, n)
        sizes, at = one.column("length").to_pylist(), rows.column("bin").to_numpy()
        bins, greedy = evolve(sizes, capacity, seed=key[0].as_py() * 101 + 77, first=[bins_of(at[k * n : (k + 1) * n]) for k in range(ISLANDS)])
        at = numbers_of(bins, n)
        well = np.bincount(at, sizes, len(bins))[at] >= WELL * capacity
        return pa.table({"_row": one.column("_row"), "length": one.column("length"), "block": one.column("block"), "bin": pa.array(at), "well": pa.array(well), "greedy": pa.array([greedy] * n, pa.int64())})

    settled = written(spark, elites.groupBy("block").applyInArrow(settle, "_row long, length long, block long, bin long, well boolean, greedy long"), "settled")

    def numbered(rows: pa.Table, at: np.ndarray, first: int, generations: int, greedy) -> pa.Table:
        row, length = rows.column("_row").to_numpy(), rows.column("length").to_numpy()
        order = np.lexsort((row, at))
        offset = np.cumsum(length[order]) - length[order]
        begins = np.concatenate([[True], np.diff(at[order]) != 0])
        offset -= offset[np.flatnonzero(begins)][np.cumsum(begins) - 1]
        n = len(rows)
        return pa.table({"_row": row[order], "sequence_id": at[order] + first, "offset": offset, "generations": np.full(n, generations, np.int32), "greedy_bins": np.full(n, greedy, np.int64)})

    def done(key, rows):
        return numbered(rows, rows.column("bin").to_numpy(), key[0].as_py() << 20, after, rows.column("greedy")[0].as_py())

    def merged(key, rows):
        rows = rows.sort_by([("length", "ascending"), ("_row", "ascending")])
        sizes = rows.column("length").to_pylist()
        old = np.unique(rows.column("block").to_numpy() << 24 | rows.column("bin").to_numpy(), return_inverse=True)[1]
        bins, greedy = evolve(sizes, capacity, seed=key[0].as_py() * 101 + 55, first=[bins_of(old)])
        return numbered(rows, numbers_of(bins, len(sizes)), (1 << 60) + (key[0].as_py() << 24), after + GENERATIONS, greedy)

    out = "_row long, sequence_id long, offset long, generations int, greedy_bins long"
    good = settled.filter("well").groupBy("block").applyInArrow(done, out)
    rest = settled.filter("not well").withColumn("group", F.floor(F.col("block") / MERGED)).groupBy("group").applyInArrow(merged, out)
    return cut.join(good.unionByName(rest), "_row").drop("_row")


def pack(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = SEQUENCE, tokenizer: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset, generations, greedy_bins.

    A null or empty text is the end id alone. Repeated rows and rows with null ids are packed each. An empty table: no rows. Pieces of equal
    length are told apart by row, so ties don't matter. A sequence holds at most capacity ids, without gaps from 0. Other columns are
    ignored, whatever their names.
    """
    bounded_batches(spark)
    out = pack_pieces(spark, pieces(docs, id, text, capacity, tokenizer), capacity, block)
    return out.select(F.col("_id").alias(id), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "generations", "greedy_bins")
