"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k least of the distinct 64-bit hashes of a text's five-word shingles.
Sketches of parts merge into the sketch of the whole; two of them estimate resemblance
and containment, and one the number of distinct shingles.

Cases: null text counts as empty; under five words the whole sequence is the one
shingle; without words the sketch is empty, like any other empty one (1) and unlike the
rest (0); equal texts have equal sketches; a single document is its own next one; rows
that share a doc_id are ordered by their text's hash (one range, so one task); a row
without a doc_id has no place in the order and is its own next one; very long texts are
hashed whole; further columns are ignored; an empty table gives none.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import cuts, range_of
from . import common as C

K = 128
SHINGLE = 5
BYTES_OF_RANGE = 8 << 20
_BLANKS = " \t\n\x0b\x0c\r"


def word_hashes(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, C.SPACE), lambda w: F.xxhash64(w)))


def sketch(hashes: str, k: int = K) -> Column:
    """Of a column of word hashes, which must be a column of the child: it is looked up for each shingle."""
    w, n = F.col(hashes), F.size(hashes)
    whole = F.array(F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: F.xxhash64(a, x)))
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))
    shingles = F.when(n == 0, F.array().cast("array<bigint>")).when(n < SHINGLE, whole).otherwise(runs)
    return F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the merged sketch that lies in both."""
    both = merged(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number: exact under k, else from the k-th least hash's place in the hash range."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that lie in b."""
    j = resemblance(a, b, k)
    shared = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.hex(h))), " ")


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id and the sketch (array of long) of each text."""
    return docs.select("doc_id", word_hashes(F.col("text")).alias("_w")).select("doc_id", sketch("_w", k).alias("sketch"))


def compare(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edit, with their likeness, and that to the next document's."""
    every = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs, unnamed = every.where("doc_id is not null"), every.where("doc_id is null")
    total = C.text_bytes(docs)
    at = cuts(docs, "doc_id", max(4, -(-total // BYTES_OF_RANGE)))
    placed = docs.withColumn("range", range_of("doc_id", at))
    heads = placed.groupBy("range").agg(F.max("doc_id").alias("head"))  # at most MOST_RANGES rows
    by_range = Window.orderBy("range")
    heads = heads.select("range", F.coalesce(F.lag("head").over(by_range), F.last("head").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("doc_id"))
    # the first document of the range below ends each range, so that the next one is always at hand
    ends = docs.join(F.broadcast(heads), "doc_id").withColumn("tie", F.row_number().over(Window.partitionBy("range").orderBy(F.xxhash64("text")))).where("tie = 1")
    rows = placed.select("range", "doc_id", "text", F.lit(False).alias("end")).unionByName(ends.select("range", "doc_id", "text", F.lit(True).alias("end")))
    rows = rows.withColumn("_w", word_hashes(F.col("text"))).withColumn("a", sketch("_w", k)).drop("_w")
    order = Window.partitionBy("range").orderBy("end", F.desc("doc_id"), F.xxhash64("text"))
    rows = rows.select("doc_id", "text", "end", "a", F.lead("text").over(order).alias("next"), F.lead("a").over(order).alias("c")).where(~F.col("end"))
    alone = unnamed.withColumn("_w", word_hashes(F.col("text"))).withColumn("a", sketch("_w", k))
    alone = alone.select("doc_id", "text", F.lit(False).alias("end"), "a", F.col("text").alias("next"), F.col("a").alias("c"))
    rows = rows.unionByName(alone)
    n = F.char_length("text")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "a", "c", F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), F.substring("next", F.lit(1), F.floor(n / 3).cast("int"))).alias("edited"))
    rows = rows.withColumn("_w", word_hashes(F.col("edited"))).withColumn("b", sketch("_w", k))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("b"), k).alias("near_edited"), resemblance(F.col("a"), F.col("c"), k).alias("near_next"), distinct_shingles(F.col("a"), k).alias("distinct_shingles"),
    )
