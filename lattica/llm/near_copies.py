"""N-gram Jaccard join by a grouped prefix join, and its connected components.

Texts become sets of hashed word n-grams. Under one order of all n-grams, two sets whose Jaccard similarity reaches the
threshold share an n-gram among their first few (the prefix). The order puts n-grams last that stand in many prefixes.

1. Documents with equal sets are one class; classes with equal prefix and size are one group.
2. Posting lists: for each prefix n-gram, the groups that have it, by size. Pairs of short lists are counted, and those that share
   too few prefix n-grams for their sizes are dropped. In a long list neighbours are chained, so m groups give m - 1 edges, not
   m * m. The components of all edges are clusters, and no similar pair lies in two.
   Lists of frequent n-grams are dealt to several tasks, whose chains are joined by their size ranges; what stands before the n-gram
   in a set bounds the sizes that it can be similar to there (see chains).
3. Clusters are expanded to their classes and verified with the whole sets. Pairs already connected need no check. A cluster over CHUNK
   classes is verified in chunks; then a few classes of each part found meet; then whatever isn't in the cluster's
   largest part meets all of it, chunk by chunk, so that no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from lattica.llm.common import dropped, text_bytes, written
from lattica.llm.components import UnionFind, components
from lattica.llm.words import bounded_batches, mixed, split_words

#: N-grams in more prefixes than this come last in the order ...
FREQUENT = 16
#: ... at most this many (32 MB, broadcast); beyond, FREQUENT is doubled. Any order gives the same links.
MOST_FREQUENT = 1 << 22
SALTS = 16
#: Posting lists up to this long give counted pairs, longer ones chains.
SHORT = 64
CHUNK = 600
CHUNK_BYTES = 32 << 20
#: Classes of each part of a chunk that meet those of other chunks.
PILOTS = 8
#: Bits of the map of ids that need verification: 16 for each id, as a power of two between these (16 MB at most).
LEAST_ID_BITS, MOST_ID_BITS = 16, 27
#: Prefix n-grams that a map task gathers before it hands their counts on.
FLUSH = 2_000_000

_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


class Shingler:
    """Sets of n-grams and their prefixes."""

    def __init__(self, words: int, percent: int, frequent: np.ndarray | None = None):
        self.words, self.percent = words, percent
        self.frequent = frequent if frequent is not None and len(frequent) else None

    def shingles(self, h: np.ndarray) -> np.ndarray:
        """Sorted distinct n-gram hashes of a text's word hashes; fewer words are one n-gram, no words none."""
        if not len(h):
            return np.empty(0, np.uint64)
        k = min(self.words, len(h))
        x = h[: len(h) - k + 1] + np.uint64(k)
        for j in range(1, k):
            x = mixed(x * _A[1] + h[j : len(h) - k + 1 + j])
        return np.unique(mixed(x))

    def known(self, s: np.ndarray) -> np.ndarray:
        """Which n-grams are frequent ones."""
        return self.frequent[np.minimum(np.searchsorted(self.frequent, s), len(self.frequent) - 1)] == s

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """The set's prefix, and at which place its frequent n-grams begin."""
        n = len(s)
        size = n - (self.percent * n + 99) // 100 + 1 if n else 0
        if self.frequent is None:
            return s[:size], size
        last = self.known(s)
        rare = s[~last]
        return (rare[:size], size) if len(rare) >= size else (np.concatenate([rare, s[last][: size - len(rare)]]), len(rare))


def frequent_grams(spark: SparkSession, docs: DataFrame, words: int, percent: int, limit: int = FREQUENT, most: int = MOST_FREQUENT) -> np.ndarray:
    """Sorted n-grams that stand in more than limit prefixes (limit doubled until at most `most` are left, half of them in each pass).

    Prefixes in hash order are samples of their sets. Where half a prefix or more is frequent, a second pass counts the whole set,
    so that of a passage that makes up most of many texts not only the sampled n-grams come last.
    """
    first = _frequent(spark, docs, words, percent, limit, most // 2)
    return np.union1d(first, _frequent(spark, docs, words, percent, limit, most // 2, first)) if len(first) else first


def _frequent(spark: SparkSession, docs: DataFrame, words: int, percent: int, limit: int, most: int, known: np.ndarray | None = None) -> np.ndarray:
    """N-grams in more than limit prefixes; with known ones: others in more than limit of the sets whose prefixes hold as many known ones as others."""
    sent = None if known is None else spark.sparkContext.broadcast(known.tobytes())
    bits = max(4, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, n, seen = Shingler(words, percent), [], 0, set()
        late = None if sent is None else Shingler(words, percent, np.frombuffer(sent.value, np.uint64))

        def out():
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            ends = np.searchsorted((grams >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
            rows = [(p, grams[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()) for p, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "grams", "counts"])

        for b in batches:
            for h in split_words(b.column(0)):
                if (d := xxh3_128_digest(h.tobytes())) in seen:  # a copy in the same task
                    continue
                seen.add(d)
                s = shingler.shingles(h)
                p = shingler.prefix(s)[0]
                if late is not None:
                    p = s[~late.known(s)] if 2 * np.count_nonzero(late.known(p)) >= len(p) else p[:0]
                if len(p):
                    held.append(p)
                n += len(p)
                if n > FLUSH:
                    yield out()
                    held, n, seen = [], 0, set()
        if n:
            yield out()

    def merge(key, rows):
        g = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("grams").to_pylist()])
        c = np.concatenate([np.frombuffer(x, "<u4") for x in rows.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(g, kind="stable")
        g, c = g[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        g, c = g[first], np.add.reduceat(c, first)
        return pa.table({"gram": pa.array(g[c > limit].view(np.int64), pa.int64()), "n": pa.array(c[c > limit], pa.int64())})

    counted = docs.select(text_bytes("_text").alias("t")).mapInArrow(count, "part int, grams binary, counts binary")
    found = written(spark, counted.groupBy("part").applyInArrow(merge, "gram long, n long"), "frequent-grams")
    steps = {r["s"]: r["c"] for r in found.groupBy(F.floor(F.log2(F.col("n") / limit)).cast("int").alias("s")).agg(F.count("*").alias("c")).collect()}
    low = 0
    while sum(c for s, c in steps.items() if s >= low) > most:
        low += 1
    kept = found.filter(F.col("n") >= limit * 2**low).select("gram").toArrow().column(0).to_numpy()
    dropped(spark, found)
    return np.sort(kept.view(np.uint64))


SETS = "_id long, n long, s1 long, s2 long, rare int, prefix array<long>, g1 long, g2 long"


def _two(x: np.ndarray) -> tuple[int, int]:
    d = xxh3_128_digest(x.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def prefixes(spark: SparkSession, docs: DataFrame, words: int, percent: int, sent) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words, percent, np.frombuffer(sent.value, np.uint64))
        for b in batches:
            rows = []
            for h in split_words(b.column(1)):
                s = shingler.shingles(h)
                p, rare = shingler.prefix(s)
                rows.append((len(s), *_two(s), rare, p.view(np.int64), *_two(p)))
            c = list(zip(*rows, strict=True)) or [[]] * 7
            ends = np.concatenate([[0], np.cumsum([len(x) for x in c[4]])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*c[4], np.empty(0, np.int64)]), pa.int64()))
            yield pa.record_batch([b.column(0), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32()), lists, pa.array(c[5], pa.int64()), pa.array(c[6], pa.int64())], ["_id", "n", "s1", "s2", "rare", "prefix", "g1", "g2"])

    return docs.select("_id", text_bytes("_text").alias("t")).mapInArrow(run, SETS)


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


CANDIDATES = "a long, b long, na long, nb long, fa long, fb long, c long, gram long, least long, most long, root long"


def _candidates(**columns) -> pa.RecordBatch:
    names = [x.split()[0] for x in CANDIDATES.split(", ")]
    n = len(next(iter(columns.values())))
    return pa.record_batch([pa.array(columns[x], pa.int64()) if x in columns else pa.nulls(n, pa.int64()) for x in names], names)


def _list_pairs(lists: np.ndarray, n: np.ndarray, gid: np.ndarray, more: np.ndarray, percent: int) -> pa.RecordBatch:
    """Pairs of compatible size of each list (rows by list, then size), with the number of lists that have both."""
    at, d, a, b = np.arange(len(n)), 0, [], []
    while len(at):
        d += 1
        at = at[at + d < len(n)]
        at = at[(lists[at] == lists[at + d]) & (100 * n[at] >= percent * n[at + d])]
        a.append(at)
        b.append(at + d)
    a, b = np.concatenate([*a, np.empty(0, np.int64)]), np.concatenate([*b, np.empty(0, np.int64)])
    swap = gid[a] > gid[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    order = np.lexsort((gid[b], gid[a]))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (gid[a][1:] != gid[a][:-1]) | (gid[b][1:] != gid[b][:-1])])) if len(a) else np.empty(0, np.int64)
    counts = np.diff(np.append(first, len(a)))
    a, b = a[first], b[first]
    keep = gid[a] != gid[b]
    return _candidates(a=gid[a][keep], b=gid[b][keep], na=n[a][keep], nb=n[b][keep], fa=more[a][keep], fb=more[b][keep], c=counts[keep])


def chains(spark: SparkSession, groups: DataFrame, percent: int, short: int = SHORT) -> DataFrame:
    """(a, b): edges that connect all groups that may hold similar classes.

    Rare n-grams: similar sets share at least `need` n-grams of their prefixes; pairs of lists of at most `short` groups are counted
    against it, with as many frequent ones as both prefixes could share besides. Longer lists are chained: neighbours by size are
    connected where their sizes are compatible.

    Frequent n-grams matter to pairs that share no n-gram before them. Such a set with r n-grams from this one on can be similar
    to sets of at most `reach` = (100 + percent) / percent * r - n n-grams, and x and y only if each is within the other's reach. Sets that
    reach their own size are sorted by it, and a chain ends where no earlier set reaches the next one. The others need a
    smaller set that reaches them, so they meet the chains, not one another: texts that share a long passage and are else
    unlike aren't connected by it.
    """
    rows = groups.select("gid", "n", "rare", F.size("prefix").alias("p"), F.posexplode("prefix").alias("at", "gram"))
    late = F.col("at") >= F.col("rare")
    salt = F.when(late, F.pmod(F.xxhash64("gid"), F.lit(SALTS)).cast("int")).otherwise(F.lit(-1))
    reach = F.floor((100 + percent) * (F.col("n") - F.col("at")) / percent) - F.col("n")
    more = F.when(late, reach).otherwise(F.col("p") - F.col("rare")).cast("long")
    dealt = rows.select("gram", salt.alias("salt"), "n", "gid", more.alias("more"))
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "gram", "salt").sortWithinPartitions("gram", "salt", "n", "gid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of a rare n-gram's list that may go on and is still short
        chain = None  # (gram, n, gid) of the last row of a long list that may go on, and its chain's root
        wide = None  # (gram, salt, least size, root, reach) of a frequent n-gram's chain that may go on

        def take(gram, n, gid, more, last: bool):
            nonlocal held, chain
            if held is not None:
                gram, n, gid, more = (np.concatenate([x, y]) for x, y in zip(held, (gram, n, gid, more), strict=True))
                held = None
            if not len(gram):
                return
            start = np.concatenate([[True], gram[1:] != gram[:-1]])
            which = np.cumsum(start) - 1
            long = np.bincount(which) > short
            if chain is not None and chain[0] == gram[0]:
                long[0] = True
            else:
                chain = None
            end = len(gram)
            if not last and not long[-1]:
                end = int(np.flatnonzero(start)[-1])
                held = (gram[end:], n[end:], gid[end:], more[end:])
            is_long = long[which]
            some = np.flatnonzero(~is_long[:end])
            if len(some):
                yield _list_pairs(which[some], n[some], gid[some], more[some], percent)
            some = np.flatnonzero(is_long[:end])
            if len(some):
                yield from chained(gram[some], n[some], gid[some])

        def chained(gram, n, gid):
            nonlocal chain
            if chain is not None:
                gram, n, gid = (np.concatenate([[x], y]) for x, y in zip(chain[:3], (gram, n, gid), strict=True))
            start = np.concatenate([[True], ~((gram[1:] == gram[:-1]) & (100 * n[:-1] >= percent * n[1:]))])
            root = gid[start][np.cumsum(start) - 1]
            if chain is not None:
                root[np.cumsum(start) == 1] = chain[3]
            yield from edges(gid[~start], root[~start])
            chain = (gram[-1], n[-1], gid[-1], root[-1])

        def edges(a, b):
            if len(a):
                pairs = np.unique(np.stack([a, b], 1), axis=0)
                yield _candidates(a=pairs[:, 0], b=pairs[:, 1])

        def reached(gram, salt, n, gid, reach):
            nonlocal wide
            apart = reach < n
            if apart.any():
                yield _candidates(gram=gram[apart], a=gid[apart], least=n[apart], most=reach[apart])
            gram, salt, n, gid, reach = (x[~apart] for x in (gram, salt, n, gid, reach))
            if not len(gram):
                return
            if wide is not None:
                gram, salt, n, gid, reach = (np.concatenate([[x], y]) for x, y in zip(wide, (gram, salt, n, gid, reach), strict=True))
            first = np.concatenate([[True], (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])])
            base = np.cumsum(first).astype(np.int64) << 40
            so_far = np.maximum.accumulate(base + reach) - base  # the furthest reach in the list up to each row
            start = first | np.concatenate([[True], so_far[:-1] < n[1:]])
            root = gid[start][np.cumsum(start) - 1]
            yield from edges(gid[~start], root[~start])
            at = np.flatnonzero(start)
            to = np.append(at[1:], len(n)) - 1
            wide = (gram[at[-1]], salt[at[-1]], n[at[-1]], root[-1], so_far[-1])
            at, to = at[:-1], to[:-1]
            if len(at):
                yield _candidates(gram=gram[at], least=n[at], most=so_far[to], root=root[at])

        for b in batches:
            gram, salt, n, gid, more = (c.to_numpy() for c in b.columns)
            late = salt >= 0
            if not late.all():
                yield from take(gram[~late], n[~late], gid[~late], more[~late], False)
            if late.any():
                yield from reached(gram[late], salt[late], n[late], gid[late], more[late])
        yield from take(*(np.empty(0, np.int64) for _ in range(4)), True)
        if wide is not None:
            yield _candidates(gram=[wide[0]], least=[wide[2]], root=[wide[3]], most=[wide[4]])

    found = written(spark, dealt.mapInArrow(run, CANDIDATES), "candidates")
    top, sum_ = F.greatest("na", "nb"), F.col("na") + F.col("nb")
    overlap = F.floor((percent * sum_ + 99 + percent) / (100 + percent))
    need = F.greatest(F.lit(1), overlap - F.floor((percent * top + 99) / 100) + 1)
    pairs = found.filter("c IS NOT NULL").groupBy("a", "b", "na", "nb", "fa", "fb").agg(F.sum("c").alias("c"))
    counted = pairs.filter(F.col("c") + F.least("fa", "fb") >= need).select("a", "b")

    def join(key, rows):
        t = rows.sort_by([("least", "ascending"), ("root", "ascending")])
        a, b, spans = [], [], []
        for low, high, r in zip(*(t.column(c).to_pylist() for c in ("least", "most", "root")), strict=True):
            if spans and spans[-1][1] >= low:
                a.append(r)
                b.append(spans[-1][2])
                spans[-1][1] = max(spans[-1][1], high)
            else:
                spans.append([low, high, r])
        none, nones = [None] * len(spans), [None] * len(a)
        columns = [a + none, b + none, *(nones + [s[i] for s in spans] for i in range(3))]
        gram = [key[0].as_py()] * len(columns[0])
        return pa.table([pa.array(c, pa.int64()) for c in (gram, *columns)], ["gram", "a", "b", "least", "most", "root"])

    # chains of one n-gram that overlap are connected, and what they cover together meets the sets apart
    parts = found.filter("root IS NOT NULL").select("gram", "least", "most", "root")
    joined = written(spark, parts.groupBy("gram").applyInArrow(join, "gram long, a long, b long, least long, most long, root long"), "spans")
    spans = joined.filter("root IS NOT NULL").select("gram", F.col("least").alias("low"), F.col("most").alias("high"), F.col("root").alias("b"))
    apart = found.filter("gram IS NOT NULL AND a IS NOT NULL").select("gram", "a", "least", "most")
    met = apart.join(spans, "gram").filter("least <= high AND low <= most").select("a", "b").distinct()
    plain = found.filter("c IS NULL AND gram IS NULL").select("a", "b")
    return counted.unionByName(plain).unionByName(joined.filter("a IS NOT NULL").select("a", "b")).unionByName(met)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int(np.count_nonzero(y[at] == x))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verify(members: list, percent: int, uf: UnionFind | None = None, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between members (id, prefix, set), found by their prefixes; pairs that are connected already aren't checked.

    sides: only pairs of a 0 and a 1 are links.
    """
    uf = UnionFind() if uf is None else uf
    order = sorted(range(len(members)), key=lambda i: (len(members[i][2]), members[i][0]))
    lists: dict[int, list[int]] = {}
    out = []
    for i in order:
        id, prefix, s = members[i]
        tried = set()
        for gram in prefix:
            for j in (mine := lists.setdefault(gram, [])):
                if j in tried:
                    continue
                tried.add(j)
                other = members[j]
                if (sides and sides[i] == sides[j]) or 100 * len(other[2]) < percent * len(s) or uf.find(id) == uf.find(other[0]):
                    continue
                if linked(other[2], s, percent):
                    uf.union(id, other[0])
                    out.append((id, other[0]))
            mine.append(i)
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first columns."""
    at, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != at:
                if held:
                    yield at, held
                at, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield at, held


def _member(id: int, prefix: bytes, s: bytes) -> tuple:
    return id, np.frombuffer(prefix, np.uint64).tolist(), np.frombuffer(s, np.uint64)


def _links(spark: SparkSession, rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(a, b): links found among the rows (keys, cid, prefix, set; label and side or null) of each key."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, held in _grouped(batches, n):
            uf, sides = UnionFind(), None
            if held[0][3] is not None:
                for id, _, _, label, _ in held:
                    uf.union(id, label)
                sides = [x[4] for x in held]
            for x, y in verify([_member(*x[:3]) for x in held], percent, uf, sides):
                a.append(x)
                b.append(y)
            if len(a) > 10_000:
                yield _edges(a, b)
                a, b = [], []
        yield _edges(a, b)

    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "cid", "prefix", "grams", "label", "side").mapInArrow(run, "a long, b long")


def whole_sets(spark: SparkSession, docs: DataFrame, need: DataFrame, words: int, percent: int, sent) -> DataFrame:
    """(cid, s1, s2, prefix binary, grams binary) of the documents in need (cid, s1, s2).

    A map of hashed ids keeps most other texts from being cut into n-grams; ids that share a bit are told apart by the join that follows.
    """
    id_bits = max(LEAST_ID_BITS, min(MOST_ID_BITS, (16 * need.count()).bit_length()))
    slot = F.pmod(F.xxhash64("cid"), F.lit(1 << id_bits))
    bits = need.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 AS int)))").alias("b")).toArrow()
    words64 = np.zeros(1 << (id_bits - 6), np.int64)
    words64[bits.column(0).to_numpy()] = bits.column(1).to_numpy()
    wanted = spark.sparkContext.broadcast(words64.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, on = Shingler(words, percent, np.frombuffer(sent.value, np.uint64)), np.frombuffer(wanted.value, np.uint64)
        for b in batches:
            slots = b.column(2).to_numpy()
            keep = np.flatnonzero((on[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1))
            chosen, rows = b.take(pa.array(keep)), []
            for id, h in zip(chosen.column(0).to_pylist(), split_words(chosen.column(1)), strict=True):
                s = shingler.shingles(h)
                if len(s):
                    rows.append((id, *_two(s), shingler.prefix(s)[0].tobytes(), s.tobytes()))
            c = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([*(pa.array(x, pa.int64()) for x in c[:3]), *(pa.array(x, pa.binary()) for x in c[3:])], ["cid", "s1", "s2", "prefix", "grams"])

    got = docs.filter("_id IS NOT NULL").select("_id", text_bytes("_text").alias("t"), F.pmod(F.xxhash64("_id"), F.lit(1 << id_bits)).alias("slot"))
    return got.mapInArrow(run, "cid long, s1 long, s2 long, prefix binary, grams binary")


def near_copies(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, frequent: int = FREQUENT, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id.

    A-Z are lower-cased; words are `[^\\x20\\x09-\\x0D]+`; the set holds the distinct n-grams of `words` words, or the whole text
    where it has fewer. Texts link when 100 * intersection >= percent * union. Null and empty texts and those without
    words have no n-grams and link with nothing: their component is their id. Repeated rows belong to one component;
    rows of one id with other texts count as one document that links what either links. A row without an id is in the
    component of equal texts (null if none of these has an id). An empty table: no rows.
    """
    bounded_batches(spark)
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    sent = spark.sparkContext.broadcast(frequent_grams(spark, rows, words, percent, frequent).tobytes())
    sets = written(spark, prefixes(spark, rows, words, percent, sent), "prefixes")
    classes = written(spark, sets.filter("n > 0").groupBy("s1", "s2", "n", "g1", "g2").agg(F.min("_id").alias("cid")), "classes")
    named = classes.filter("cid IS NOT NULL")
    groups = named.groupBy("n", "g1", "g2").agg(F.min(F.struct("cid", "s1", "s2")).alias("m"))
    groups = written(spark, groups.select("n", "g1", "g2", F.col("m.cid").alias("gid"), F.col("m.s1").alias("s1"), F.col("m.s2").alias("s2")), "groups")
    first = sets.select(F.col("_id").alias("gid"), "s1", "s2", "n", "rare", "prefix").join(groups.select("gid", "s1", "s2"), ["gid", "s1", "s2"], "left_semi")
    clusters = components(spark, chains(spark, first.select("gid", "n", "rare", "prefix"), percent))

    # groups expanded to their classes; clusters of one class have nothing to verify
    expanded = named.join(groups.select("n", "g1", "g2", "gid"), ["n", "g1", "g2"]).select("cid", "s1", "s2", "n", "gid")
    at = written(spark, expanded.join(clusters.withColumnRenamed("v", "gid"), "gid", "left").select("cid", "s1", "s2", "n", F.coalesce("component", "gid").alias("cluster")), "clusters")
    sizes = at.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("grams")).filter("m > 1")
    parts = F.greatest(F.ceil(F.col("m") / chunk), F.ceil(F.col("grams") * 8 / CHUNK_BYTES)).cast("int")
    sizes = written(spark, sizes.select("cluster", parts.alias("chunks")), "sizes")
    need = written(spark, at.join(sizes, "cluster").select("cid", "s1", "s2", "cluster", "chunks", F.pmod(F.xxhash64("cid", "s1"), F.col("chunks")).cast("int").alias("chunk")), "need")
    held = whole_sets(spark, rows, need, words, percent, sent)
    whole = written(spark, need.join(held, ["cid", "s1", "s2"]).withColumns({"label": F.lit(None).cast("long"), "side": F.lit(None).cast("int")}), "whole-sets")
    links = written(spark, _links(spark, whole, ["cluster", "chunk"], percent), "links")

    large = whole.filter("chunks > 1")
    if not large.isEmpty():
        links = links.unionByName(_across(spark, large, links, percent, chunk))
    found = components(spark, links)
    member = classes.join(found.withColumnRenamed("v", "cid"), "cid", "left").select("s1", "s2", F.coalesce("component", "cid").alias("component_id"))
    member = written(spark, member, "members")
    out = sets.select("_id", "n", "s1", "s2").join(member, ["s1", "s2"], "left")
    result = out.select(F.col("_id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))
    dropped(spark, whole, need, groups)
    return result


def _across(spark: SparkSession, large: DataFrame, links: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Links between chunks of clusters that have several."""
    from pyspark.sql import Window

    def labels(found: DataFrame) -> DataFrame:
        parts = components(spark, found).withColumnRenamed("v", "cid").withColumnRenamed("component", "part")
        light = large.select("cluster", "cid", "s1", "s2", "chunks", "chunk")
        return written(spark, light.join(parts, "cid", "left").select("cluster", "cid", "s1", "s2", "chunks", "chunk", F.coalesce("part", "cid").alias("label")), "labels")

    # a few classes of each part of a chunk, the ones with the least rare n-grams in their prefix, meet other chunks' ones
    sizes = large.select("cluster", "chunk", "cid", "s1", "s2", F.length("prefix").alias("len"))
    one = labels(links)
    ranked = one.join(sizes, ["cluster", "chunk", "cid", "s1", "s2"]).withColumn("r", F.row_number().over(Window.partitionBy("cluster", "chunk", "label").orderBy("len", F.xxhash64("cid"))))
    pilots = ranked.filter(F.col("r") <= PILOTS).select("cid", "s1", "s2", "label")
    meet = large.drop("label", "side").join(pilots, ["cid", "s1", "s2"]).withColumn("side", F.lit(None).cast("int")).withColumn("label", F.lit(None).cast("long"))
    meet = meet.withColumn("chunk", F.pmod(F.xxhash64("cid", F.lit(1)), F.greatest(F.lit(1), F.ceil(F.col("chunks") / 4))).cast("int"))
    two = written(spark, _links(spark, meet, ["cluster", "chunk"], percent), "links-across")

    # whatever isn't in the largest part of its cluster meets the whole cluster
    both = labels(links.unionByName(two))
    counts = both.groupBy("cluster", "label").agg(F.count("*").alias("c"))
    main = counts.groupBy("cluster").agg(F.max(F.struct("c", F.negative("label").alias("l"))).alias("m"), F.sum("c").alias("all"))
    main = written(spark, main.select("cluster", F.negative(F.col("m.l")).alias("main"), F.ceil((F.col("all") - F.col("m.c")) / chunk).cast("int").alias("others")).filter("others > 0"), "main-parts")
    rows = both.join(main, "cluster")
    every = rows.select("cid", "s1", "s2", "cluster", "label", F.col("chunk").alias("j"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("i"), F.lit(1).alias("side"))
    rest = rows.filter("label <> main").select("cid", "s1", "s2", "cluster", "label", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"), F.pmod(F.xxhash64("cid", F.lit(2)), F.col("others")).cast("int").alias("i"), F.lit(0).alias("side"))
    cells = every.unionByName(rest).join(large.select("cid", "s1", "s2", "prefix", "grams"), ["cid", "s1", "s2"])
    three = written(spark, _links(spark, cells, ["cluster", "i", "j"], percent), "links-rest")
    return two.unionByName(three)


def first_of_each(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, whose id is the least of their component; rows without an id stay.

    Null and empty texts are like nothing and stay; repeated rows of the least id stay all. An empty table: no rows. docs must not have a column named __gone.
    """
    found = near_copies(spark, docs, id, text, words, percent)
    gone = found.filter(F.col(id) != F.col("component_id")).select(F.col(id).alias("__gone")).distinct()
    return docs.join(gone, F.col(id) == F.col("__gone"), "left_anti")
