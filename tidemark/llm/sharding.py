"""Sharding by global byte-size prefix sums, cut at equal targets.

Documents are ordered by doc_id (ties: checksum, size). Ranges of doc_id give their
totals; the sums of the ranges before, plus the running sum inside the range, are each
document's place in the corpus's bytes. Shard s holds those that begin in the s-th of
equal parts, so shards are contiguous and differ by less than two documents' sizes.

Cases: null text has no bytes; null doc_ids come first; documents longer than a part
may leave shards empty; equal rows stand side by side; no rows give none.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import cuts, range_of
from . import common as C

SHARDS = 24
ROWS_OF_RANGE = 20_000


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document of (doc_id, text)."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    sized = docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    sized = C.materialise(sized)
    n, total = sized.agg(F.count("*"), F.sum("size")).first()
    at = cuts(sized, "doc_id", max(8, n // ROWS_OF_RANGE))
    placed = sized.withColumn("range", range_of("doc_id", at))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over at most MOST_RANGES rows
    ranges = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    ranges = ranges.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("range").orderBy("doc_id", "text_crc32", "size")
    running = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = placed.join(F.broadcast(ranges), "range").select(
        "doc_id", "size", "text_crc32", (F.col("bytes_before") + running).alias("begin"), (F.col("rows_before") + F.row_number().over(inside) - 1).alias("row")
    )
    rows = C.materialise(rows.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(begin * {shards}) div {total or 1}")).cast("int")))
    first = rows.groupBy("shard").agg(F.min("row").alias("first"))  # a row for each shard
    return rows.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
