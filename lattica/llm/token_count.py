"""Token counts: pieces are counted once for each distinct pre-token and joined to the documents' pre-token frequencies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import wordstats
from lattica.llm.common import text_bytes, written
from lattica.llm.words import bounded_batches


def piece_counts(vocabulary: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(word, n, n_tokens): each distinct word is tokenized exactly once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lattica.llm.wordbpe import load

        encode = load(tokenizer).encode_batch_fast
        for b in batches:
            words = b.column(0).to_pylist()
            pieces: list[int] = []
            for i in range(0, len(words), 2000):
                pieces += [len(e) for e in encode([w.decode("utf-8", "replace") for w in words[i : i + 2000]], add_special_tokens=False)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(pieces, pa.int64())], ["word", "n", "n_tokens"])

    return vocabulary.select("word", "n").mapInArrow(count, "word binary, n long, n_tokens long")


def count_tokens(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", limit: int = 2048, tokenizer: str | None = None, head: int = wordstats.HEAD) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    The pre-token here is the white-space-delimited word, whose pieces don't depend on its neighbours. Counts of
    the most frequent words are broadcast (head words at most); the rest are shuffled. No ids are made.
    Null and empty texts: 0 bytes, 0 tokens. Repeated rows and null ids: a row for each. An empty table: no rows.
    Other columns are ignored, whatever their names.
    """
    bounded_batches(spark)
    docs = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    vocabulary = written(spark, piece_counts(wordstats.word_counts(docs, "_text"), tokenizer), "pieces")
    carried = docs.withColumn("_bytes", F.length(text_bytes("_text")).cast("long"))
    out = wordstats.summed_by_document(spark, carried, ["_id", "_bytes"], vocabulary, {"n_tokens": "long"}, "_text", head=head)
    return out.select(F.col("_id").alias(id), F.col("_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
