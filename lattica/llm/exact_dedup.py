"""Exact dedup over an extendible-hash index that lies in the shared folder.

1. Map tasks collapse equal texts that they meet (`pages` of the index: hash, text, best row, count).
2. A histogram of the pages' bytes by the hash's first DEPTH bits (2**DEPTH rows at most) drives directory doubling:
   a bucket over its capacity splits on its next bit until it fits or the bits end. The directory (slot, bucket) is a file of the index.
3. Owner tasks process ranges of the hash: pages find their bucket in the directory and come sorted by hash, entries of one hash form a chain, and
   texts in the chain are compared byte for byte. A task holds one chain at a time.
4. Documents find their bucket in the directory as well, and in it their class by hash, told from others of the hash by SHA-256.
   A text that a third of all rows have is a hot key of that join; its rows are narrow, and Spark splits them as a skewed join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import BLANKS, dropped, written
from lattica.llm.words import bounded_batches

#: Most bits of the directory.
DEPTH = 16
#: Bytes of text that a bucket holds before it is split.
CAPACITY = 16 << 20
#: Bytes of pages for which there is an owner at least.
OWNED = 1 << 30
#: Bytes of distinct text that a map task holds before it hands its pages on.
HELD = 24 << 20

PAGE = "h long, norm binary, best_chars long, best_id long, n long"


def normalised(col: str):
    return F.translate(F.coalesce(F.col(col), F.lit("")), BLANKS, "")


def directory(histogram: dict[int, int], capacity: int, depth: int = DEPTH) -> list[int]:
    """Directory doubling: 2**depth slots, each with the number of its bucket; buckets are numbered in key order.

    A bucket over capacity is split on its next bit, its slots going to two buckets, until it fits or the bits end.
    """
    slots = 1 << depth
    ends = [0]
    for i in range(slots):
        ends.append(ends[-1] + histogram.get(i, 0))
    leaves, open_ = [], [(0, slots)]
    while open_:
        at, size = open_.pop()
        if size > 1 and ends[at + size] - ends[at] > capacity:
            open_ += [(at + size // 2, size // 2), (at, size // 2)]
        else:
            leaves.append((at, size))
    out = [0] * slots
    for bucket, (at, size) in enumerate(leaves):
        out[at : at + size] = [bucket] * size
    return out


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a task become one page entry; what is held is bounded by HELD."""
    best: dict[bytes, list] = {}
    held = 0

    def out():
        rows = list(best.items())
        for i in range(0, len(rows), 2000):
            part = rows[i : i + 2000]
            columns = list(zip(*[x[1] for x in part], strict=True))
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array([x[0] for x in part], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["h", "norm", "best_chars", "best_id", "n"])
        best.clear()

    for b in batches:
        for h, norm, chars, id in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (e := best.get(norm)) is None:
                best[norm] = [h, chars, id, 1]
                held += len(norm) + 100
            else:
                e[3] += 1
                if _better(chars, id, e[1], e[2]):
                    e[1], e[2] = chars, id
        if held > HELD:
            yield from out()
            held = 0
    if best:
        yield from out()


def _better(chars: int, id: int | None, than_chars: int, than_id: int | None) -> bool:
    if chars != than_chars:
        return chars > than_chars
    return id is not None and (than_id is None or id < than_id)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hash. Chains the entries of a hash, comparing bytes; gives a row for each distinct text."""
    chain: dict[bytes, list] = {}
    at, done = None, []

    def close():
        done.extend((at, hashlib.sha256(norm).digest(), e[1], e[2]) for norm, e in chain.items())
        chain.clear()

    def out():
        columns = zip(*done, strict=True)
        b = pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["h", "sha", "keep_id", "group_size"])
        done.clear()
        return b

    for b in batches:
        for h, norm, chars, id, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if h != at:
                close()
                at = h
            if (e := chain.get(norm)) is None:  # a dict compares the bytes of keys
                chain[norm] = [chars, id, n]
            else:
                e[2] += n
                if _better(chars, id, e[0], e[1]):
                    e[0], e[1] = chars, id
        if len(done) > 5000:
            yield out()
    close()
    if done:
        yield out()


@dataclass
class Index:
    """directory: (slot, bucket), a row for each slot, broadcast (2**depth rows); classes: (h, sha, keep_id, group_size), a row for each distinct text."""

    directory: DataFrame
    classes: DataFrame
    depth: int

    def bucketed(self, rows: DataFrame) -> DataFrame:
        """rows (with h) and the bucket that the directory has for each."""
        return rows.withColumn("slot", _slot(self.depth)).join(F.broadcast(self.directory), "slot").drop("slot")

    def found(self, rows: DataFrame) -> DataFrame:
        """rows (with h and sha), each with keep_id and group_size of its class."""
        return self.bucketed(rows).join(self.bucketed(self.classes), ["bucket", "h", "sha"]).drop("bucket", "h")


def _slot(depth: int):
    return F.shiftrightunsigned(F.col("h"), 64 - depth).cast("int")


def build_index(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, depth: int = DEPTH) -> Index:
    """The index over the normalised texts of docs. Ids are whole numbers."""
    bounded_batches(spark)
    norm = normalised(text)
    rows = docs.select(F.xxhash64(norm).alias("h"), norm.cast("binary").alias("norm"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("c"), F.col(id).cast("long").alias("i"))
    pages = written(spark, rows.mapInArrow(_collapse, PAGE), "index-pages")
    sums = pages.groupBy(_slot(depth).alias("slot")).agg(F.sum(F.length("norm") + 64).alias("b")).collect()
    slots = directory({r["slot"]: r["b"] for r in sums}, capacity, depth)
    stored = written(spark, spark.createDataFrame(list(enumerate(slots)), "slot int, bucket int").coalesce(1), "index-directory")
    index, buckets = Index(stored, None, depth), slots[-1] + 1
    owners = min(buckets, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), sum(r["b"] for r in sums) // OWNED))
    owner = F.floor(F.col("bucket").cast("long") * owners / buckets).cast("int")  # a range of neighbouring buckets
    owned = index.bucketed(pages).withColumn("owner", owner).repartitionById(owners, "owner")
    owned = owned.sortWithinPartitions("bucket", "h").select("h", "norm", "best_chars", "best_id", "n")
    index.classes = written(spark, owned.mapInArrow(_own, "h long, sha binary, keep_id long, group_size long"), "index-classes")
    dropped(spark, pages)
    return index


def _hashed(docs: DataFrame, text: str, h: str, sha: str) -> DataFrame:
    norm = normalised(text)
    return docs.withColumns({h: F.xxhash64(norm), sha: F.unhex(F.sha2(norm.cast("binary"), 256))})


def exact_dedup(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256. Ids are whole numbers; other columns are ignored.

    Texts are equal when identical after deleting `[\\x20\\x09-\\x0D]`; null counts as empty, and empty texts are equal.
    The row with the most code points, then the smallest id, stays; a null id comes after all others. Repeated rows
    (equal id and text): each gets a row, one is counted for each, all of them are marked kept. An empty table: no rows.
    """
    index = build_index(spark, docs, id, text, capacity)
    rows = _hashed(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), "_text", "h", "sha").drop("_text")
    out = index.found(rows)
    return out.select(F.col("_id").alias(id), "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def kept_documents(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns; of repeated rows with equal id and text, one.

    Null counts as the empty text, and of empty texts one row stays; a null id stays only where its class has no other. An empty table: no rows.
    docs must not have columns named __h, __sha.
    """
    index = build_index(spark, docs, id, text)
    first = index.classes.select(F.col("h").alias("__ch"), F.col("sha").alias("__class"), F.col("keep_id").alias("__keep"))
    own = _hashed(docs, text, "__h", "__sha")
    own = own.join(first, (F.col("__h") == F.col("__ch")) & (F.col("__sha") == F.col("__class")) & F.col(id).eqNullSafe(F.col("__keep")), "left_semi")
    repeated = docs.groupBy(id).count().filter("count > 1").limit(1).count() > 0
    return (own.dropDuplicates([id, "__sha"]) if repeated else own).select(*docs.columns)
