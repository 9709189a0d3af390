"""Corpus-wide word tables and their join to documents, without shuffling every word occurrence.

Words are what stands between `[\\x20\\x09-\\x0D]` characters, as UTF-8 bytes. A corpus has few frequent words and very
many rare ones. The most frequent ones (at most HEAD, whatever the corpus size) go to the workers as one small
broadcast table; only the rest is shuffled, and those words are not hot: each is rarer than every head word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import text_bytes, written

#: Words that are broadcast; at about 20 bytes each this bounds the broadcast near 5 MB.
HEAD = 262_144
#: Distinct words that a map task holds before it hands its counts on.
FLUSH = 400_000


def word_counts(docs: DataFrame, text: str = "text", lower: bool = False) -> DataFrame:
    """(word binary, n long): occurrences of every word, summed in each map task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            b = pa.record_batch([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return b

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update((t.lower() if lower else t).split())
                if len(seen) > FLUSH:
                    yield out()
        yield out()

    parts = docs.select(text_bytes(text).alias("t")).mapInArrow(count, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def head_limit(vocabulary: DataFrame, most: int = HEAD) -> int:
    """The least n with at most `most` words of n or more occurrences, to a sixteenth of a power of two."""
    steps = vocabulary.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("step")).agg(F.count("*").alias("words")).collect()
    total, low = 0, 2**62
    for step, words in sorted(((r["step"], r["words"]) for r in steps), reverse=True):
        total += words
        if total > most:
            break
        low = math.ceil(2 ** (step / 16) - 1e-9)
    return low


def head_table(vocabulary: DataFrame, low: int, values: list[str]) -> dict:
    """{word: value or tuple of values} of the words that occur low times or more: HEAD at most."""
    t = vocabulary.filter(F.col("n") >= low).select("word", *values).toArrow()
    columns = [t.column(v).to_pylist() for v in values]
    return dict(zip(t.column(0).to_pylist(), columns[0] if len(values) == 1 else zip(*columns, strict=True), strict=True))


def summed_by_document(
    spark: SparkSession,
    docs: DataFrame,
    carry: list[str],
    vocabulary: DataFrame,
    values: dict[str, str],
    text: str = "text",
    lower: bool = False,
    head: int = HEAD,
    extra: dict[str, str] | None = None,
    extra_of: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]] | None = None,
    then: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row for each row of docs: the columns `carry`, n_words, and for each of `values` (name: "long" or "double")
    the sum of it over all word occurrences of the text; words that the vocabulary lacks add nothing.

    extra: columns (name: type) that extra_of()(batch) gives in the same pass; a batch has the columns `carry`, then the texts.
    then: makes of the written rows (_row, extra) a table (_row, more columns); _row counts up within a task, in the order of its
    batches. The result has its columns, not those of extra.
    vocabulary: (word, n, *values), written. Word frequencies are counted in the task that reads the document.
    """
    names = list(values)
    low = head_limit(vocabulary, head)
    known = spark.sparkContext.broadcast(head_table(vocabulary, low, names))
    kinds = docs.select(*carry).schema
    arrow = {"long": pa.int64(), "double": pa.float64()}
    sums = ", ".join(f"h_{n} {k}" for n, k in values.items())
    more = extra or {}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "n_words long", sums, "words array<binary>", "freqs array<long>", *(f"`{x}` {k}" for x, k in more.items())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        more_of = extra_of() if extra_of else None
        for b in batches:
            n_words, words, freqs, totals = [], [], [], [[] for _ in names]
            texts = b.column(b.num_columns - 1).to_pylist()
            for t in texts:
                seen = Counter((t.lower() if lower else t).split())
                n_words.append(seen.total())
                mine = [0] * len(names)
                rare = [w for w in seen if w not in table]
                rare_n = [seen.pop(w) for w in rare]
                if len(names) == 1:
                    mine[0] = sum(map(int.__mul__ if values[names[0]] == "long" else float.__mul__, map(table.__getitem__, seen), map(int if values[names[0]] == "long" else float, seen.values())))
                elif seen:
                    found = [table[w] for w in seen]
                    for i in range(len(names)):
                        mine[i] = sum(x * y for x, y in zip(map(itemgetter(i), found), seen.values(), strict=True))
                words.append(rare)
                freqs.append(rare_n)
                for i, x in enumerate(mine):
                    totals[i].append(x)
            yield pa.record_batch(
                [*b.columns[:-1], pa.array(n_words, pa.int64()), *(pa.array(x, arrow[values[n]]) for x, n in zip(totals, names, strict=True)), pa.array(words, pa.list_(pa.binary())), pa.array(freqs, pa.list_(pa.int64())), *(more_of(b) if more_of else ())],
                [f.name for f in kinds] + ["n_words", *(f"h_{n}" for n in names), "words", "freqs", *more],
            )

    by_row = written(spark, docs.select(*carry, text_bytes(text).alias("_t")).mapInArrow(split, schema).withColumn("_row", F.monotonically_increasing_id()), "doc-words")
    rare = vocabulary.filter(F.col("n") < low).select("word", *names)
    pairs = by_row.filter(F.size("words") > 0).select("_row", F.explode(F.arrays_zip("words", "freqs")).alias("w"))
    pairs = pairs.select("_row", F.col("w.words").alias("word"), F.col("w.freqs").alias("freq"))
    added = pairs.join(rare, "word").groupBy("_row").agg(*(F.sum(F.col(n) * F.col("freq")).alias(f"t_{n}") for n in names))
    out = by_row.drop("words", "freqs").join(added, "_row", "left")
    if then:
        made = then(by_row.select("_row", *more))
        out, more = out.drop(*more).join(made, "_row"), [c for c in made.columns if c != "_row"]
    return out.select(*carry, *more, "n_words", *((F.col(f"h_{n}") + F.coalesce(F.col(f"t_{n}"), F.lit(0))).alias(n) for n in names))
