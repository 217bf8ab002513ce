"""Row reconciliation from independent counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.schema import PARTITION_COLUMNS


def reconcile_counts(source: DataFrame, silver: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Per file: source rows = Silver rows = valid + quarantined.

    The three sides are counted on their own scans, each reduced map-side to one row per file,
    and then summed together; a file missing on one side shows up as zero rows there.
    """
    zero = F.lit(0).cast("bigint")

    def side(df: DataFrame, name: str) -> DataFrame:
        columns = {"source_rows": zero, "silver_rows": zero, "valid_rows": zero}
        columns["quarantine_rows"] = zero
        columns[name] = F.lit(1).cast("bigint")
        if name == "silver_rows":
            columns["valid_rows"] = F.coalesce("dq_valid", F.lit(False)).cast("bigint")
        return df.select(*PARTITION_COLUMNS, *(c.alias(n) for n, c in columns.items()))

    united = (
        side(source, "source_rows")
        .unionByName(side(silver, "silver_rows"))
        .unionByName(side(quarantine, "quarantine_rows"))
    )
    counts = ("source_rows", "silver_rows", "valid_rows", "quarantine_rows")
    summed = united.groupBy(*PARTITION_COLUMNS).agg(*(F.sum(c).alias(c) for c in counts))
    return summed.withColumn(
        "reconciled",
        (F.col("source_rows") == F.col("silver_rows"))
        & (F.col("source_rows") == F.col("valid_rows") + F.col("quarantine_rows")),
    )


def reconcile_total(per_file: DataFrame) -> DataFrame:
    """The same balance over all files; false when any single file is off."""
    return per_file.agg(
        F.count(F.lit(1)).alias("files_processed"),
        *(
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("source_rows", "silver_rows", "valid_rows", "quarantine_rows")
        ),
        F.coalesce(F.bool_and("reconciled"), F.lit(False)).alias("reconciled"),
    )
