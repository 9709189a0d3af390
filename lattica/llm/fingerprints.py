"""I-Match fingerprints, in DataFrame functions only.

Terms are lower-cased words. The lexicon holds the terms in a band of inverse document frequency; the band is set as shares of the
documents, so its size is bounded by (mean distinct terms of a document) / LEAST_SHARE whatever the corpus size. SUBSETS randomised
sub-lexicons keep 1, 1/2, 1/4 and, four times each, 1/8 ... 1/512 of it; the small ones are what survives when much of a
long text changes. The hash of a sub-lexicon's terms is the exclusive or of the distinct terms' hashes: it is the same
in whatever order they come, which is what sorting them is for, and lets each map task fold a document's terms as it meets them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import written

#: The band: shares of the documents that hold a term.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.05
#: Sub-lexicon j keeps one in 2**HALVINGS[j] terms. Two 32-bit hashes travel in one long.
HALVINGS = [0, 1, 2, *(h for h in range(3, 10) for _ in range(4)), 9]
SUBSETS = len(HALVINGS)
LONGS = [f"x{k}" for k in range(SUBSETS // 2)]
#: Most terms for which the lexicon is broadcast (about 40 MB); a larger one is joined by shuffle.
BROADCAST = 250_000


def terms(text: Column) -> Column:
    """Distinct lower-cased words, and the empty term, which stands for the document itself."""
    return F.array_distinct(F.split(F.concat(F.lit(" "), F.lower(text)), r"[\x20\x09-\x0D]+"))


def lexicon(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, x0, x1, ...): terms in the band with their hash in each sub-lexicon that holds them, 0 in others. Written.

    The empty term is there as well, so that a document without lexicon terms stays.
    """
    n = docs.count()
    df = docs.select(F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("term")).filter("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    kept = df.filter((F.col("df") >= max(2, LEAST_SHARE * n)) & (F.col("df") <= max(2, MOST_SHARE * n)))
    part = lambda j: F.when(F.pmod(F.xxhash64("term", F.lit(j)), F.lit(1 << HALVINGS[j])) == 0, F.xxhash64("term", F.lit(-1 - j)).bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.lit(0).cast("long"))
    longs = [F.shiftleft(part(2 * k), 32).bitwiseOR(part(2 * k + 1)).alias(x) for k, x in enumerate(LONGS)]
    own = spark.createDataFrame([("", *[0] * len(LONGS))], "term string, " + ", ".join(f"{x} long" for x in LONGS))
    return written(spark, kept.select("term", *longs).unionByName(own), "lexicon")


def next_ids(spark: SparkSession, docs: DataFrame, parts: int) -> DataFrame:
    """(_id, _k, _rows, _next): each id that occurs, the largest half of its texts, its rows, the next larger id (of the last: the first).

    Ids are dealt by range; only the first id of each range (parts rows) meets in one task.
    """
    light = docs.filter("_id IS NOT NULL").groupBy("_id").agg(F.max(F.floor(F.length("_text") / 2)).alias("_k"), F.count("*").alias("_rows"))
    ranged = written(spark, light.repartitionByRange(parts, "_id").withColumn("_b", F.spark_partition_id()), "id-ranges")
    firsts = ranged.groupBy("_b").agg(F.min("_id").alias("_first"))
    everything = Window.partitionBy(F.lit(0))
    after = firsts.select("_b", F.coalesce(F.lead("_first").over(everything.orderBy("_b")), F.min("_first").over(everything)).alias("_after"))
    inside = F.lead("_id").over(Window.partitionBy("_b").orderBy("_id"))
    return ranged.withColumn("_in", inside).join(F.broadcast(after), "_b").select("_id", "_k", "_rows", F.coalesce("_in", "_after").alias("_next"))


def edited_texts(spark: SparkSession, docs: DataFrame, order: DataFrame) -> DataFrame:
    """docs (_id, _text) and _edited: the last floor(n/2) code points replaced by the next document's first as many.

    Of several rows with the next id the least beginning is taken. A row without id has no next document: nothing takes the place.
    Both sides of the join read the same exchange of texts.
    """
    named = docs.filter("_id IS NOT NULL")
    want = order.select(F.col("_next").alias("_id"), F.col("_id").alias("_for"), F.col("_k").alias("_want"))
    given = named.join(want, "_id").select(F.col("_for").alias("_id"), F.substring("_text", F.lit(1), F.col("_want").cast("int")).alias("_given"))
    if order.filter("_rows > 1").limit(1).count():
        given = given.groupBy("_id").agg(F.min("_given").alias("_given"))
    half = F.floor(F.length("_text") / 2).cast("int")
    head = F.substring("_text", F.lit(1), F.length("_text") - half)
    edited = named.join(given, "_id").select("_id", "_text", F.concat(head, F.substring("_given", F.lit(1), half)).alias("_edited"))
    return edited.unionByName(docs.filter("_id IS NULL").select("_id", "_text", head.alias("_edited")))


def hashes(prefix: str) -> Column:
    """The sub-lexicon hashes as an array of longs, 0 where a sub-lexicon has no term of the text."""
    return F.array(*(y for x in LONGS for y in (F.shiftrightunsigned(f"{prefix}{x}", 32), F.col(f"{prefix}{x}").bitwiseAND(F.lit(0xFFFFFFFF)))))


def likeness(a: str, b: str, text_a: str, text_b: str) -> Column:
    """Share of equal sub-lexicon hashes among those for which either has a term; without any: whether the texts' hashes are equal."""
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != 0)), lambda x: x))
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda x: x))
    return F.when(either > 0, both / either).otherwise((F.col(text_a) == F.col(text_b)).cast("double"))


def shown(fp: str, text: str) -> Column:
    """Each 32-bit hash in hexadecimal, "-" where a sub-lexicon has no term; without any term: the text's hash after "="."""
    some = F.exists(fp, lambda x: x != 0)
    each = F.transform(fp, lambda x: F.when(x == 0, "-").otherwise(F.lower(F.hex(x))))
    return F.when(some, F.array_join(each, ".")).otherwise(F.concat(F.lit("="), F.lower(F.hex(text))))


def fingerprints(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null counts as the empty text. A text without a lexicon term is told by its hash, and is like equal texts only. Identical rows
    (equal id and text) give one row; rows of one id with other texts each give one. A null id: near_next is null and nothing takes
    the place of the replaced half. A single document is its own next one. An empty table: no rows.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    words = lexicon(spark, rows, "_text")
    order = written(spark, next_ids(spark, rows, parts), "order")
    pairs = edited_texts(spark, rows, order)
    small = words.count() <= BROADCAST
    both = pairs.select("_id", F.length("_text").cast("long").alias("_n"), F.xxhash64("_text").alias("_t"), F.xxhash64("_edited").alias("_e"), F.unhex(F.sha2(F.col("_edited").cast("binary"), 256)).alias("_sha"), F.posexplode(F.array(terms(F.col("_text")), terms(F.col("_edited")))).alias("which", "terms"))
    each = both.select("_id", "_t", "_n", "_e", "_sha", "which", F.explode("terms").alias("term"))
    found = each.join(F.broadcast(words) if small else words, "term")
    fold = lambda x, which: F.bit_xor(F.when(F.col("which") == which, F.col(x)).otherwise(F.lit(0).cast("long")))
    grouped = found.groupBy("_id", "_t", "_n", "_e", "_sha").agg(*(fold(x, w).alias(f"{p}{x}") for w, p in ((0, "a"), (1, "b")) for x in LONGS))
    prints = written(spark, grouped.select("_id", "_t", "_n", "_e", "_sha", hashes("a").alias("a"), hashes("b").alias("b")), "prints")
    first = prints.join(order.select(F.col("_next").alias("_id"), F.col("_id").alias("_for")), "_id").groupBy("_for").agg(F.min(F.struct("_t", "a")).alias("next"))
    out = prints.join(first, F.col("_id") == F.col("_for"), "left").withColumn("next_a", F.col("next.a")).withColumn("next_t", F.col("next._t"))
    return out.select(
        F.col("_id").alias(id), F.col("_n").alias("n_chars"), F.lower(F.hex("_sha")).alias("edited_sha256"), shown("a", "_t").alias("fingerprint"), shown("b", "_e").alias("edited_fingerprint"),
        likeness("a", "b", "_t", "_e").alias("near_edited"), F.when(F.col("next_t").isNotNull(), likeness("a", "next_a", "_t", "next_t")).alias("near_next"),
    )
