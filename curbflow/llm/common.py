"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.session import scratch_path

# The white space between words, as the contracts state it ([\x20\x09-\x0D]).
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, and no executor holds it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_ROWS = 256


def small_batches(df: DataFrame) -> DataFrame:
    """The frame itself, in a session that hands Python at most BATCH_ROWS whole texts at a time:
    a worker's memory then follows the longest texts and not the default of ten thousand rows."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which Arrow gives the memory it keeps for later back: a Python worker lives on
    for other tasks and stages."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped


def word_array(text: Column) -> Column:
    """Words between white-space runs; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def words_of(text: bytes | None) -> list[bytes]:
    """The same words in Python: ``bytes.split`` splits on exactly these six characters."""
    return text.split() if text else []


def bytes_column(batch: pa.RecordBatch, name: str) -> Iterator[bytes | None]:
    """One column's texts as UTF-8 bytes, one at a time."""
    for value in batch.column(name).cast(pa.large_binary()):
        yield value.as_py()


class Interned(dict):
    """Word to consecutive id, learned as words are met; ``fresh`` holds those not yet described."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.fresh.append(word)
        return at


def file_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder in the shared store (file, hdfs, s3, gs)."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)
