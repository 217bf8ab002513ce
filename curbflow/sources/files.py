"""Files as data: inventory, integrity and reconciliation with what was recorded about them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.schema import PARTITION_COLUMNS
from curbflow.settings import SERVICES

# How a monthly trip file is named; the name before the underscore is one of the services.
TRIP_FILE = rf"(?i)^({'|'.join(SERVICES)})_tripdata_(\d{{4}})-(0[1-9]|1[0-2])\.parquet$"
PARQUET_MAGIC = b"PAR1"
CHUNK_BYTES = 8 * 1024 * 1024
INTEGRITY_SCHEMA = "path string, size bigint, head string, tail string, sha256 string"


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Path and length of every file below a folder; contents are pruned from the scan."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "length")
    )


def trip_files(files: DataFrame, services: Sequence[str] = SERVICES) -> DataFrame:
    """Files named like monthly trips of the chosen services; foreign names are left out."""
    unknown = set(services) - set(SERVICES)
    if unknown:
        raise ValueError(f"unknown services: {sorted(unknown)}")
    rank = ", ".join(f"'{s}'" for s in SERVICES)
    return (
        files.selectExpr("path", "length", "regexp_extract(path, '[^/]+$', 0) AS filename")
        .where(f"filename RLIKE r'{TRIP_FILE}'")
        .selectExpr(
            "path",
            "filename",
            "length",
            f"lower(regexp_extract(filename, r'{TRIP_FILE}', 1)) AS service",
            f"CAST(regexp_extract(filename, r'{TRIP_FILE}', 2) AS int) AS year",
            f"CAST(regexp_extract(filename, r'{TRIP_FILE}', 3) AS int) AS month",
        )
        .selectExpr("*", f"array_position(array({rank}), service) AS service_rank")
        .where(F.col("service").isin(list(services)))
    )


def duplicate_files(files: DataFrame) -> DataFrame:
    """Periods claimed by more than one file."""
    return (
        files.groupBy(*PARTITION_COLUMNS).agg(F.count(F.lit(1)).alias("files")).where("files > 1")
    )


def file_inventory(files: DataFrame, services: Sequence[str] = SERVICES) -> DataFrame:
    """Trip files by year, month and service; two files for one period are an error."""
    found = trip_files(files, services)
    clash = duplicate_files(found).first()
    if clash:
        raise ValueError(f"more than one file for {clash.service} {clash.year}-{clash.month:02d}")
    return found.orderBy("year", "month", "service_rank").drop("service_rank")


def open_filesystem(uri: str) -> tuple[FileSystem, str]:
    """File system and inner path of a Spark path, for use inside tasks."""
    if uri.startswith("file:"):
        return LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(uri)


def _hash_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for uri in batch["path"]:
            filesystem, path = open_filesystem(uri)
            digest, size, head, tail = hashlib.sha256(), 0, b"", b""
            with filesystem.open_input_stream(path) as stream:
                while chunk := stream.read(CHUNK_BYTES):
                    digest.update(chunk)
                    head = (head + chunk[:4])[:4]
                    tail = (tail + chunk[-4:])[-4:]
                    size += len(chunk)
            rows.append((uri, size, head.hex(), tail.hex(), digest.hexdigest()))
        yield pd.DataFrame(rows, columns=["path", "size", "head", "tail", "sha256"])


def file_integrity(files: DataFrame) -> DataFrame:
    """Size, Parquet magic and SHA-256 of each file, streamed in chunks on the executors.

    The file listing already packs files into partitions by length, so tasks are even and no file
    is ever held in memory whole.
    """
    magic = PARQUET_MAGIC.hex()
    hashed = files.select("path").mapInPandas(_hash_files, INTEGRITY_SCHEMA)
    return hashed.selectExpr(
        "path",
        "size",
        "sha256",
        f"size >= 8 AND head = '{magic}' AND tail = '{magic}' AS parquet_magic",
    )


def reconcile_manifest(files: DataFrame, sidecars: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files against their sidecar and manifest entry, with the first rule each one breaks.

    ``files``: url, size, sha256, parquet_magic. ``sidecars``: url, size_bytes, content_length,
    sha256, etag. ``manifest``: url, size_bytes, sha256, status, etag. Entity tags are compared
    only where both sides have one.
    """
    f = files.selectExpr("url", "size", "sha256", "parquet_magic", "true AS on_disk")
    s = sidecars.selectExpr(
        "url",
        "coalesce(content_length, size_bytes) AS s_length",
        "size_bytes AS s_size",
        "lower(sha256) AS s_sha",
        "etag AS s_etag",
        "true AS has_sidecar",
    )
    m = manifest.selectExpr(
        "url",
        "size_bytes AS m_size",
        "sha256 AS m_sha",
        "status AS m_status",
        "etag AS m_etag",
        "true AS in_manifest",
    )
    joined = f.join(s, "url", "full_outer").join(m, "url", "full_outer")
    return joined.selectExpr(
        "url",
        """CASE
          WHEN on_disk IS NULL OR size <= 0 THEN 'FILE_ABSENT'
          WHEN NOT parquet_magic THEN 'PARQUET_MAGIC'
          WHEN has_sidecar IS NULL THEN 'SIDECAR_ABSENT'
          WHEN s_length IS NULL OR s_length <= 0 THEN 'SIDECAR_LENGTH'
          WHEN size <> s_length OR NOT s_size <=> s_length THEN 'SIZE'
          WHEN s_sha IS NULL OR NOT s_sha RLIKE '^[0-9a-f]{64}$' THEN 'SIDECAR_SHA256'
          WHEN sha256 <> s_sha THEN 'CHECKSUM'
          WHEN in_manifest IS NULL THEN 'MANIFEST_ABSENT'
          WHEN NOT m_sha <=> sha256 THEN 'MANIFEST_SHA256'
          WHEN NOT m_size <=> s_length THEN 'MANIFEST_SIZE'
          WHEN s_etag <> m_etag THEN 'ETAG'
          WHEN coalesce(m_status NOT IN ('VALIDATED', 'SKIPPED'), true) THEN 'MANIFEST_STATUS'
          ELSE 'OK'
        END AS verdict""",
    )


# What a file was met in, as bits of ``seen_in``.
EXPECTED, LISTED, HASHED, IN_SIDECAR, IN_MANIFEST = 1, 2, 4, 8, 16
# Verdicts under which a file is as it should be.
GOOD_FILE = ("OK", "NOT_YET_PUBLISHED")


def prove_files(
    expected: DataFrame,
    listed: DataFrame,
    integrity: DataFrame,
    sidecars: DataFrame,
    manifest: DataFrame,
    *,
    historical_years: Sequence[int],
    current_year: int | None = None,
) -> DataFrame:
    """Every file that is expected, present or recorded, with the first rule it breaks.

    ``expected``: service, year, month, filename; ``listed``: path, length; ``integrity``: path,
    size, sha256, parquet_magic as read from the bytes; ``sidecars`` and ``manifest`` as in
    ``reconcile_manifest``, by url. The five are joined one after another on the file's name, so a
    row says in ``seen_in`` where it was met. Rules in order: a name that is no trip file's, a year
    outside the scope, absent (files of the current year may be), two places for one name, a length
    that changed between listing and reading, then those of ``reconcile_manifest``.
    """
    name = "regexp_extract({}, '[^/]+$', 0) AS filename"
    grid = expected.selectExpr("filename", "year AS due", f"{EXPECTED} AS e")
    found = (
        listed.selectExpr("path", name.format("path"), "length")
        .groupBy("filename")
        .agg(F.min("length").alias("length"), F.count(F.lit(1)).alias("places"), F.lit(LISTED).alias("l"))
    )
    read = (
        integrity.selectExpr(name.format("path"), "size", "sha256", "parquet_magic")
        .groupBy("filename")
        .agg(*[F.min(c).alias(c) for c in ("size", "sha256", "parquet_magic")], F.lit(HASHED).alias("h"))
    )
    checked = reconcile_manifest(
        integrity.selectExpr(f"{name.format('path')}".replace("filename", "url"), "size", "sha256", "parquet_magic"),
        sidecars.withColumn("url", F.regexp_extract("url", "[^/]+$", 0)),
        manifest.withColumn("url", F.regexp_extract("url", "[^/]+$", 0)),
    ).groupBy(F.col("url").alias("filename")).agg(F.min("verdict").alias("recorded"))
    told = [
        records.selectExpr(name.format("url"), f"{bit} AS {alias}").distinct()
        for records, bit, alias in ((sidecars, IN_SIDECAR, "s"), (manifest, IN_MANIFEST, "m"))
    ]
    rows = grid
    for side in (found, read, *told, checked):
        rows = rows.join(side, "filename", "full_outer")
    years = ", ".join(str(y) for y in (*historical_years, *([current_year] if current_year is not None else [])))
    optional = f"due = {current_year}" if current_year is not None else "false"
    return rows.withColumn("file_year", F.expr(f"CAST(nullif(regexp_extract(filename, r'{TRIP_FILE}', 2), '') AS int)")).selectExpr(
        "filename",
        "coalesce(e, 0) + coalesce(l, 0) + coalesce(h, 0) + coalesce(s, 0) + coalesce(m, 0) AS seen_in",
        f"""CASE
          WHEN file_year IS NULL THEN 'UNKNOWN_NAME'
          WHEN file_year NOT IN ({years}) OR e IS NULL THEN 'OUT_OF_SCOPE'
          WHEN l IS NULL AND {optional} AND s IS NULL AND m IS NULL THEN 'NOT_YET_PUBLISHED'
          WHEN l IS NULL THEN 'FILE_ABSENT'
          WHEN places > 1 THEN 'DUPLICATE'
          WHEN NOT length <=> size THEN 'LISTED_SIZE'
          ELSE recorded
        END AS verdict""",
    )


def ingest_summary(manifest: DataFrame) -> DataFrame:
    """Transfers of a batch: how many, bytes moved, how many were already there."""
    return manifest.agg(
        F.count(F.lit(1)).alias("downloads"),
        F.coalesce(F.sum("transferred_bytes"), F.lit(0)).alias("downloaded_bytes"),
        F.count_if(F.col("status") == "SKIPPED").alias("skipped"),
    )
