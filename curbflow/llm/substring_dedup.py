"""Removing long word sequences that repeat across documents, with a count-min prefilter.

Windows are counted in sketches first. Tasks fill one partition sketch a block of rows, and the
sketches are merged by slices of the hash range, so no task or driver ever holds a whole sketch. A
merged count is never below the true one. Every block then learns which of its own counters repeat,
and only windows whose counters all repeat are grouped exactly. All numbers on their way are sorted
and packed, one or two bytes a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as pads
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbflow.llm.common import file_store, lean, small_batches, words_of, written
from curbflow.llm.text_hash import Hashed, hashed_texts, mix
from curbflow.session import scratch_path

WINDOW = 50
ROWS = 2  # rows of the sketch
SLICE_WINDOWS = 1 << 21  # windows a slice of the sketch is sized for
WIDTH = 1 << 24  # counters in a row of a slice
FLUSH = 1 << 19  # windows held before a partition sketch is packed, at least
MOST_HELD = 1 << 22  # and at most
ROW_WINDOWS = 1 << 10  # windows a packed row should have for each slice
GROUP_FLUSH = 1 << 18
SALTS = 4  # parts in which a block's windows to remove are written


def counters(h1: np.ndarray, h2: np.ndarray, slices: int, row: int) -> np.ndarray:
    """The counter of each window in a row of the sketch: its slice, then its place in it."""
    with np.errstate(over="ignore"):
        place = mix(h2 + np.uint64(row)) & np.uint64(WIDTH - 1)
        return (h1 % np.uint64(slices)) * np.uint64(WIDTH) + place


@lru_cache(maxsize=1)
def _squeezer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@lru_cache(maxsize=1)
def _expander() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def pack(numbers: np.ndarray) -> bytes:
    """Sorted distinct numbers below 2^32 as packed gaps, their bytes in planes."""
    gaps = np.diff(numbers, prepend=np.uint64(0)).astype("<u4")
    return _squeezer().compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_expander().decompress(raw), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.uint64))


def _packed_rows(block: int, found: list[tuple[np.ndarray, np.ndarray]], slices: int) -> pa.RecordBatch:
    """One row a slice that was met and sketch row: the counters met once, and those met more often."""
    out: dict[str, list] = {"slice": [], "block": [], "r": [], "once": [], "more": []}
    h1 = np.concatenate([a for a, _ in found])
    h2 = np.concatenate([b for _, b in found])
    for r in range(ROWS):
        keys = np.sort(counters(h1, h2, slices, r))
        first = np.append(True, keys[1:] != keys[:-1])
        starts = np.flatnonzero(first)
        unique, twice = keys[starts], np.diff(np.append(starts, len(keys))) > 1
        of = unique // np.uint64(WIDTH)
        edges = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
        for a, b in zip(edges, edges[1:], strict=False):
            place, many = unique[a:b] % np.uint64(WIDTH), twice[a:b]
            out["slice"].append(int(of[a]))
            out["block"].append(block)
            out["r"].append(r)
            out["once"].append(pack(place[~many]))
            out["more"].append(pack(place[many]))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))


def merge_slice(pdf: pd.DataFrame) -> pd.DataFrame:
    """Add up one slice; give every partition sketch those of its counters that reach two."""
    replies = []
    for r, part in pdf.groupby("r"):
        counts = np.zeros(WIDTH, np.uint8)
        for once, more in zip(part["once"], part["more"], strict=True):
            at = unpack(once).astype(np.int64)
            counts[at] = np.minimum(counts[at] + 1, 2)
            counts[unpack(more).astype(np.int64)] = 2
        for block, once, more in zip(part["block"], part["once"], part["more"], strict=True):
            own = np.concatenate([unpack(once), unpack(more)])
            own = np.sort(own[counts[own.astype(np.int64)] >= 2])
            if len(own):
                replies.append((block, pdf["slice"].iloc[0], r, pack(own)))
    return pd.DataFrame(replies, columns=["block", "slice", "r", "repeated"])


def _stored_by_block(df: DataFrame, name: str, *salt: Column) -> str:
    """Stored in a folder a block. A block is brought to one task, so that it is one file, or to as
    many as ``salt`` has values."""
    path = scratch_path(df.sparkSession, name)
    df.repartition("block", *salt).write.partitionBy("block").parquet(path)
    return path


def _of_block(path: str, block: int) -> pa.Table | None:
    """What was stored for one block, read by the task that works on the block."""
    import pyarrow.fs as pafs

    store, root = file_store(path)
    folder = f"{root}/block={block}"
    if store.get_file_info(folder).type == pafs.FileType.NotFound:
        return None
    return pads.dataset(folder, filesystem=store, format="parquet").to_table()


def _among(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys


@dataclass(frozen=True)
class _Blocks:
    """The rows as written once, with block and key, and how many slices their windows need."""

    rows: DataFrame
    slices: int


def _write_blocks(df: DataFrame, key: str, text: str) -> _Blocks:
    rows = written(small_batches(df).withColumns({"_block": F.spark_partition_id().cast("long"), "_key": F.col(key).cast("long")}), "dedup-rows")
    # Words have more than one character: this many windows at most, but for very short words.
    chars = rows.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("long")).first()[0]
    return _Blocks(rows, max(8, -(-chars // (6 * SLICE_WINDOWS))))


def _runs(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, Hashed]]:
    """Hashed runs of texts that lie in one block, with the texts' keys and where there is one."""
    for whole in batches:
        blocks = whole.column("_block").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            batch = whole.slice(a, b - a)
            keyed = batch.column("_key").is_valid().to_numpy(zero_copy_only=False)
            keys = batch.column("_key").fill_null(0).to_numpy(zero_copy_only=False)
            for run in hashed_texts(batch.column(text)):
                span = slice(run.at, run.at + run.count)
                yield int(blocks[a]), keys[span], keyed[span], run


def repeated_windows(blocks: _Blocks, text: str, window: int = WINDOW) -> str:
    """Where, by block, the windows are stored that start in two documents: their hashes and the
    smallest key they start in. A block lists a window only if it has one to remove."""
    slices = blocks.slices
    flush = min(max(FLUSH, ROW_WINDOWS * slices), MOST_HELD)
    narrow = blocks.rows.select("_block", "_key", text)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, current = [], 0, None
        for block, _, keyed, run in _runs(batches, text):
            if found and (block != current or held >= flush):
                yield _packed_rows(current, found, slices)
                found, held = [], 0
            current = block
            h1, h2, at = run.windows(window)
            with_key = keyed[run.text_of(at)]
            if with_key.any():
                found.append((h1[with_key], h2[with_key]))
                held += len(found[-1][0])
        if found:
            yield _packed_rows(current, found, slices)

    sketches = narrow.mapInArrow(lean(sketch), "slice long, block long, r int, once binary, more binary")
    replies = _stored_by_block(
        sketches.groupBy("slice").applyInPandas(merge_slice, "block long, slice long, r int, repeated binary"), "dedup-repeats"
    )

    def keys_of(block: int) -> list[np.ndarray]:
        stored = _of_block(replies, block)
        rows: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(ROWS)]
        if stored is not None:
            for s, r, raw in zip(stored["slice"].to_pylist(), stored["r"].to_pylist(), stored["repeated"].to_pylist(), strict=True):
                rows[r].append(unpack(raw) + np.uint64(s * WIDTH))
        return [np.unique(np.concatenate(r)) for r in rows]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats, found, held, current = [], [], 0, None
        for block, keys, keyed, run in _runs(batches, text):
            if found and (block != current or held >= GROUP_FLUSH):
                yield _least(current, found)
                found, held = [], 0
            if block != current:
                current, repeats = block, keys_of(block)
            h1, h2, at = run.windows(window)
            for r in range(ROWS):
                inside = _among(repeats[r], counters(h1, h2, slices, r))
                h1, h2, at = h1[inside], h2[inside], at[inside]
            texts = run.text_of(at)
            with_key = keyed[texts]
            if with_key.any():
                found.append((h1[with_key], h2[with_key], keys[texts][with_key]))
                held += len(found[-1][0])
        if found:
            yield _least(current, found)

    # A window has one row a block, however many documents hold it: a common one stays small.
    listed = narrow.mapInArrow(lean(pick), "h1 long, h2 int, block long, low long, high long")
    same = Window.partitionBy("h1", "h2")
    hits = listed.withColumn("least", F.min("low").over(same)).filter("high > least").select("block", "h1", "h2", "least")
    return _stored_by_block(hits, "dedup-hits", F.pmod("h2", F.lit(SALTS)))


def _least(block: int, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The distinct windows of some documents of a block, with their smallest and largest key."""
    h1, h2, keys = (np.concatenate(x) for x in zip(*found, strict=True))
    h2 = (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)
    order = np.lexsort((keys, h2, h1))
    h1, h2, keys = h1[order], h2[order], keys[order]
    first = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
    starts = np.flatnonzero(first)
    last = np.append(starts[1:], len(h1)) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(h1[starts].view(np.int64)), pa.array(h2[starts]), pa.array(np.full(len(starts), block, np.int64)), pa.array(keys[starts]), pa.array(keys[last])],
        ["h1", "h2", "block", "low", "high"],
    )


def _listed_hits(path: str, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's windows to remove: first hashes in order, second hashes, least keys."""
    stored = _of_block(path, block)
    if stored is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    order = np.argsort(h1 := stored["h1"].to_numpy())
    return h1[order], stored["h2"].to_numpy()[order], stored["least"].to_numpy()[order]


def _hit(listed: tuple[np.ndarray, np.ndarray, np.ndarray], h1: np.ndarray, h2: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which windows are listed with a least key below their own."""
    first, second, least = listed
    h1, h2 = h1.view(np.int64), (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)
    out = np.zeros(len(h1), bool)
    at = np.searchsorted(first, h1)
    open_at = np.flatnonzero(at < len(first))
    # Equal first hashes lie side by side: a window listed by two parts of a block, or an accident.
    while len(open_at := open_at[first[at[open_at]] == h1[open_at]]):
        p = at[open_at]
        out[open_at] |= (second[p] == h2[open_at]) & (least[p] < keys[open_at])
        at[open_at] += 1
        open_at = open_at[at[open_at] < len(first)]
    return out


def covered_words(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    steps[starts] += 1
    np.subtract.at(steps, starts + window, 1)
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``df`` without words that an earlier document has in the same ``window`` words' sequence.

    A word goes if some window of ``window`` consecutive words that covers it also starts in a row
    with a smaller key; windows are those of the input. Adds ``n_words`` and ``n_removed``; a text
    that loses words becomes its other words joined by one space, any other text stays as it is
    (null stays null). Windows never cross rows. Texts shorter than a window lose nothing. Rows with
    equal keys do not remove from each other; rows with a null key neither lose nor remove anything.
    Windows are taken as equal when two hashes of 96 bits in all agree. Input columns named
    ``n_words`` or ``n_removed`` are replaced; an empty table stays empty.
    """
    source = df.drop("n_words", "n_removed")
    blocks = _write_blocks(source, key, text)
    hits = repeated_windows(blocks, text, window)
    names = source.columns
    schema = T.StructType(
        [*source.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    )

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, listed = None, None
        for batch in batches:
            bodies = batch.column(text).cast(pa.large_binary())
            texts: list[bytes | None] = []
            counts, removed = [], []
            for block, keys, keyed, run in _runs([batch], text):
                if block != current:
                    current, listed = block, _listed_hits(hits, block)
                h1, h2, at = run.windows(window)
                own = run.text_of(at)
                gone = _hit(listed, h1, h2, keys[own]) & keyed[own]
                drop = covered_words(at[gone], len(run.hashes), window)
                sums = np.append(0, np.cumsum(drop))
                lost = sums[run.first[1:]] - sums[run.first[:-1]]
                counts.append(np.diff(run.first))
                removed.append(lost)
                for i in range(run.count):
                    body = bodies[len(texts)].as_py()
                    if lost[i]:
                        left = drop[run.first[i] : run.first[i + 1]].tolist()
                        body = b" ".join([w for w, d in zip(words_of(body), left, strict=True) if not d])
                    texts.append(body)
            none = [np.zeros(0, np.int64)]
            columns = {c: batch.column(c) for c in names} | {text: pa.array(texts, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays(
                [*columns.values(), pa.array(np.concatenate(counts or none)), pa.array(np.concatenate(removed or none))],
                [*names, "n_words", "n_removed"],
            )

    return blocks.rows.mapInArrow(lean(strip), schema)
