"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import query, stored, table

#: Rows that one ordered slice should hold; it only sets how finely the ordering is cut for parallel work.
SLICE_ROWS = 20_000


def _slices(n: int) -> int:
    return max(1, min(1 << 16, n // SLICE_ROWS))


def interleave(docs: DataFrame, shards: int = 8, stratum: str = "source", key: str = "doc_id", text: str = "text",
               seed: str = "7") -> DataFrame:
    """Deal rows into `shards` so that every shard has the mixture of strata of the whole table.

    Rows of one stratum are put in a seeded random order (an MD5 of seed and identifier); the row of
    rank r among n gets the fractional rank (r + 1/2) / n. All rows sorted by fractional rank form one
    interleaved sequence in which any stretch has the mixture of the whole, and the sequence is cut
    into equal runs, so shard counts differ by at most one.

    Ranks never order a whole stratum in one task: the random order and the fractional rank are
    uniform, so both are cut into even slices, rows are numbered inside a slice, and the counts of the
    slices before are added. A stratum with a third of all rows spreads like the rest.

    NULL stratum: a stratum of its own. NULL text: size 1, checksum of nothing. NULL or repeated
    identifiers: kept, ordered by the text's checksum; equal rows are interchangeable.
    Returns doc_id, stratum, size, text_crc32, shard, slot (gapless from 0 in its shard).
    """
    raw = F.col(text).cast("string").cast("binary")
    rows = stored(docs.select(
        F.col(key).alias("d"), F.col(stratum).cast("string").alias("s"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("crc"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("-"))).cast("binary")).alias("u"),
    ).withColumn("s", F.concat(F.when(F.col("s").isNull(), "0").otherwise("1"), F.coalesce("s", F.lit("")))), "deal")
    n = rows.count()
    cuts = _slices(n)
    rows = rows.withColumn("b", F.floor(F.conv(F.substring("u", 1, 8), 16, 10).cast("long") * cuts / (1 << 32)))

    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = (rows.groupBy("s", "b").agg(F.count("*").alias("k"))
              .select("s", "b", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"),
                      F.sum("k").over(Window.partitionBy("s")).alias("of")))
    inside = Window.partitionBy("s", "b").orderBy("u", "d", "crc", "size")
    ranked = (rows.withColumn("r", F.row_number().over(inside) - 1).join(counts, ["s", "b"])
              .withColumn("f", (F.col("base") + F.col("r") + 0.5) / F.col("of"))
              .select("d", "s", "size", "crc", "u", "f", F.floor(F.col("f") * cuts).alias("g")))
    ranked = stored(ranked, "deal")

    # One row per slice: at most 65536 rows, however large the table is.
    ahead = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranked.groupBy("g").agg(F.count("*").alias("k"))
               .select("g", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("base")))
    order = Window.partitionBy("g").orderBy("f", "u", "s", "d", "crc", "size")
    placed = (ranked.withColumn("r", F.row_number().over(order) - 1).join(offsets, "g")
              .withColumn("p", F.col("base") + F.col("r")))
    shard = F.expr(f"p * {shards} div {max(n, 1)}")
    return placed.withColumn("shard", shard.cast("int")).select(
        F.col("d").alias(key), F.expr("if(left(s, 1) = '0', null, substring(s, 2))").alias("stratum"), "size",
        F.col("crc").alias("text_crc32"), "shard",
        F.expr(f"p - (shard * {max(n, 1)}L + {shards - 1}) div {shards}").cast("long").alias("slot"))


@query("op5_sharding")
def op5(spark, sf_dir):
    dealt = interleave(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), "stratum")
