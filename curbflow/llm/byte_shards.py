"""Contiguous shards of near-equal bytes, cut from a global prefix sum of row sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbflow.llm.common import written


def text_bytes(text: Column, overhead: int = 16) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long")


def shard_by_bytes(
    df: DataFrame, shards: int, size: str = "size", key: str = "doc_id", tie: str | None = None
) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 within a shard).

    Rows are put in key order over range partitions and written once. The partitions' totals, one
    row each, give every partition its place in the global sum; inside a partition a window adds
    the rest. A row lies in the shard that holds the middle of its bytes, so a shard differs from
    the equal target by less than its two border rows.

    Null keys come first. Equal keys are ordered by ``tie`` and then by input position, so a key
    shared by many rows spreads over several partitions and shards. Negative and null sizes count
    as 0. An empty table gives an empty result; fewer rows than shards leave shards empty. Input
    columns named ``shard`` or ``slot`` are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    carried = [c for c in df.columns if c not in ("shard", "slot")]
    order = [F.col(key).asc_nulls_first(), *([F.col(tie)] if tie else []), F.col("_at")]
    placed = written(
        df.select(*carried)
        .withColumns(
            {
                "_size": F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)),
                "_at": F.monotonically_increasing_id(),
            }
        )
        .repartitionByRange(*order)
        .withColumn("_part", F.spark_partition_id()),
        "byte-shards",
    )
    # One row per range partition: small enough for one task and for a broadcast.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = (
        placed.groupBy("_part")
        .agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_base_bytes"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base_rows"),
            F.greatest(F.sum("_bytes").over(whole), F.lit(1)).alias("_total"),
        )
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    start = F.col("_base_bytes") + F.sum("_size").over(inside) - F.col("_size")
    middle = (2 * start + F.col("_size")).cast("decimal(20,0)") * shards
    numbered = (
        placed.join(F.broadcast(bases), "_part")
        .withColumn(
            "shard",
            F.least(F.floor(middle / (2 * F.col("_total"))), F.lit(shards - 1)).cast("int"),
        )
        .withColumn("_row", F.col("_base_rows") + F.row_number().over(inside) - 1)
    )
    # At most ``shards`` rows.
    firsts = numbered.groupBy("shard").agg(F.min("_row").alias("_first"))
    return numbered.join(F.broadcast(firsts), "shard").select(
        *carried, "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )
