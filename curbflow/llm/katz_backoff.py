"""Language-model scores of texts by Katz backoff, learned from the corpus itself.

Texts become token streams, cut into chunks of bounded size. Level by level, from single words up,
every chunk asks for the n-grams it holds: it sends each once, with its count in training texts and
its probability at the level below. The n-grams are dealt to slices by their history, and a slice
adds up counts and, per history, what the backoff weight is made of. What a chunk asked for is kept
in a table that is partitioned by groups of chunks, and the chunk evaluates its tokens from it.

For history h and word w, with c the count of hw in training texts and C that of h before any word:

    P(w | h) = d(c) c / C                   if c > 0
             = a(h) P(w | h without its first word)   otherwise
    a(h)     = (1 - sum of d(c) c / C over seen w) / (1 - sum of P(w | shorter h) over the same w)

so the probabilities after any history sum to one over the training words and one unknown word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import file_store, lean, small_batches, written
from curbflow.llm.text_hash import hashed_texts, mix
from curbflow.session import scratch_path

U64 = np.uint64
START, END = U64(0x5374617274), U64(0x456E64)  # outside the text: before its first word, after its last
WORD_MASK = U64((1 << 48) - 1)  # words after one history are told apart by this much of their hash
RARE = 5  # counts up to this are discounted
CHUNK_TOKENS = 1 << 20
SLICE_TOKENS = 1 << 21
HOT_TOKENS = 1 << 19
MOST_PARTS = 1 << 17
GROUP_CHUNKS = 16


# --- packed arrays --------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers as compressed planes of bytes: planes that are all zero cost nothing."""
    if not len(numbers):
        return b""
    return _zstd()[0].compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(raw: bytes, kind: type = np.int64) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    planes = np.frombuffer(_zstd()[1].decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_few(values: np.ndarray) -> tuple[bytes, bytes]:
    """Doubles of which many are equal: the distinct ones, and each value's place among them."""
    distinct, at = np.unique(values, return_inverse=True)
    return pack(distinct), pack(at.astype(np.int64))


# --- token streams --------------------------------------------------------------------------------


@dataclass
class _Stream:
    """Pieces of texts on their way into a chunk. A piece is ``order - 1`` tokens of context and the
    tokens to score; a text longer than a chunk is several pieces."""

    order: int
    limit: int
    hashes: list[np.ndarray] = field(default_factory=list)
    lengths: list[np.ndarray] = field(default_factory=list)
    rows: list[np.ndarray] = field(default_factory=list)
    held: int = 0

    def add(self, words: np.ndarray, first: np.ndarray, rows: np.ndarray) -> Iterator[None]:
        """Take whole texts, given as words laid end to end; stop each time a chunk is full."""
        context = self.order - 1
        sizes = np.diff(first) + context + 1
        ends = np.cumsum(sizes)
        stream = np.full(int(ends[-1]) if len(ends) else 0, START, U64)
        own = np.repeat(ends - sizes + context - first[:-1], np.diff(first)) + np.arange(len(words))
        stream[own] = words
        stream[ends - 1] = END
        if len(sizes) == 1 and len(stream) > self.limit:
            for at in range(0, len(stream) - context, self.limit):
                piece = stream[at : at + self.limit + context]
                yield from self._take(piece, np.array([len(piece)]), rows)
        else:
            yield from self._take(stream, sizes, rows)

    def _take(self, stream: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> Iterator[None]:
        self.hashes.append(stream)
        self.lengths.append(sizes)
        self.rows.append(rows)
        self.held += len(stream)
        if self.held >= self.limit:
            yield

    def flush(self) -> tuple[np.ndarray, ...]:
        out = np.concatenate(self.hashes), np.concatenate(self.lengths), np.concatenate(self.rows)
        self.hashes, self.lengths, self.rows, self.held = [], [], [], 0
        return out


CHUNK_COLUMNS = "chunk long, texts long, size long, words binary, tokens binary, lengths binary, trains binary, rows binary"
KINDS = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}


def _batch(rows: list[dict[str, object]], schema: str) -> pa.RecordBatch:
    columns = [part.split(" ") for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], KINDS[k]) for c, k in columns], [c for c, _ in columns])


def _each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, object], pa.RecordBatch]]:
    """One row at a time, as a dictionary and as a batch of its own."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            yield {n: one.column(n)[0].as_py() for n in one.schema.names if n != "keys"}, one


def _chunk_row(name: int, texts: int, stream: np.ndarray, lengths: np.ndarray, rows: np.ndarray, trains: np.ndarray) -> dict[str, object]:
    words, at, counts = np.unique(stream, return_inverse=True, return_counts=True)
    # Frequent words first: their numbers are small, and bytes of small numbers compress.
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return {
        "chunk": name, "texts": texts, "size": len(stream), "words": pack(words[order]), "tokens": pack(place[at]),
        "lengths": pack(lengths.astype(np.int64)), "trains": pack(trains), "rows": pack(rows),
    }


def token_chunks(df: DataFrame, key: str, trains: str, text: str, order: int, limit: int) -> DataFrame:
    """Chunks of about ``limit`` tokens: their distinct words, each token's place among these, and
    the rows' keys. ``texts`` counts the training texts that are new in a chunk."""
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        stream = _Stream(order, limit)
        made, met, last = 0, 0, -1
        keys: list[pa.Array] = []
        base = 0  # the row that ``keys`` begin at

        def out() -> pa.RecordBatch:
            nonlocal made, last, keys, base
            tokens, lengths, codes = stream.flush()
            rows, trained = codes >> 1, codes & 1
            made += 1
            texts = len(np.unique(rows[(trained > 0) & (rows > last)]))
            last = int(rows[-1])
            known = pa.concat_arrays(keys)
            own = known.take(pa.array(rows - base))
            keys, base = [known.slice(last - base)], last
            row = _batch([_chunk_row(task + made, texts, tokens, lengths, task + rows, trained)], CHUNK_COLUMNS)
            listed = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            return pa.RecordBatch.from_arrays([*row.columns, listed], [*row.schema.names, "keys"])

        for batch in batches:
            keys.append(batch.column(key))
            trained = batch.column(trains).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = (met + np.arange(batch.num_rows)) * 2 + trained
            met += batch.num_rows
            for run in hashed_texts(batch.column(text), lower=True):
                for _ in stream.add(run.hashes, run.first, codes[run.at : run.at + run.count]):
                    yield out()
        if stream.held:
            yield out()

    narrow = small_batches(df).select(key, trains, text)
    return written(narrow.mapInArrow(lean(cut), f"{CHUNK_COLUMNS}, keys array<{kind}>"), "katz-chunks")


# --- counts and discounts -------------------------------------------------------------------------


@dataclass(frozen=True)
class Level:
    """What is known of all n-grams of one length: counts of counts from 1, tokens, kinds."""

    of_count: tuple[int, ...]
    tokens: int
    kinds: int

    @property
    def discounts(self) -> np.ndarray:
        return discounts(self.of_count)


def discounts(of_count: tuple[int, ...]) -> np.ndarray:
    """Katz's discount ratios d(1), d(2), ... by Good-Turing: what they free is the share of n-grams
    met once. The cutoff is the largest up to RARE for which all ratios lie between 0 and 1; tables
    too small for any cutoff give half a count of each rare n-gram."""
    for cutoff in range(min(RARE, len(of_count) - 1), 0, -1):
        n = np.array(of_count[: cutoff + 1], np.float64)
        if (n[:cutoff] <= 0).any():
            continue
        beyond = (cutoff + 1) * n[cutoff] / n[0]
        r = np.arange(1, cutoff + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratios = ((r + 1) * n[1:] / (r * n[:-1]) - beyond) / (1 - beyond)
        if np.isfinite(ratios).all() and (ratios > 0).all() and (ratios < 1).all():
            return np.append(ratios, np.ones(RARE - cutoff))
    return (np.arange(1, RARE + 1) - 0.5) / np.arange(1, RARE + 1)


def kept_counts(counts: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """d(c) c of every count."""
    return counts * np.append(np.append(0.0, ratios), 1.0)[np.minimum(counts, len(ratios) + 1)]


def single_chances(counts: np.ndarray, level: Level) -> np.ndarray:
    """P(w) of words by their counts. All words that training texts do not hold are one kind, and
    what the discounts free is theirs."""
    d = level.discounts
    free = sum((1 - d[r - 1]) * r * level.of_count[r - 1] for r in range(1, RARE + 1))
    whole = level.tokens if free > 0 else level.tokens + 1
    return np.where(counts > 0, kept_counts(counts, d), free if free > 0 else 1.0) / whole


# --- requests -------------------------------------------------------------------------------------

ASK_SCHEMA = "slice long, chunk long, histories binary, sizes binary, words binary, counts binary, below binary, below_at binary"
REPLY_SCHEMA = "chunk long, slice long, counts binary, totals binary, rare binary, sums binary"


@dataclass(frozen=True)
class Plan:
    """How n-grams are dealt out, alike for all chunks."""

    order: int
    slices: int
    hot: int  # a history met more often is split into parts
    texts: int  # training texts, the count of what precedes a first word

    def parts(self, counts: np.ndarray) -> np.ndarray:
        return 1 + np.maximum(counts - 1, 0) // self.hot


@dataclass
class _Asked:
    """The distinct n-grams of one length of a chunk, in the order in which it asks for them."""

    grams: np.ndarray  # by token: the place of its n-gram in the order, -1 where none is asked
    slices: np.ndarray  # by n-gram
    histories: np.ndarray  # by n-gram
    words: np.ndarray
    counts: np.ndarray
    below: np.ndarray  # the word's probability one level below; after single words, its count
    split: np.ndarray  # by n-gram: whether its history is in several slices
    extra_slices: np.ndarray  # parts of split histories that no own n-gram lies in, by slice
    extra: np.ndarray

    def by_slice(self) -> Iterator[tuple[int, slice, np.ndarray]]:
        """Every slice that something is asked of, its n-grams, and its histories in order."""
        present = np.unique(np.concatenate([self.slices, self.extra_slices]))
        edges = [np.searchsorted(x, present, side).tolist() for x in (self.slices, self.extra_slices) for side in ("left", "right")]
        for s, a, b, c, d in zip(present.tolist(), *edges, strict=True):
            yield s, slice(a, b), np.unique(np.concatenate([self.histories[a:b], self.extra[c:d]]))


class Chunk:
    """A chunk's tokens, evaluated level by level."""

    def __init__(self, row: dict[str, object], plan: Plan) -> None:
        self.name, self.plan = row["chunk"], plan
        self.words = unpack(row["words"], U64)
        self.tokens = unpack(row["tokens"])
        self.lengths = unpack(row["lengths"])
        self.rows, self.trained = unpack(row["rows"]), unpack(row["trains"])
        starts = np.cumsum(self.lengths) - self.lengths
        self.inside = np.arange(len(self.tokens)) - np.repeat(starts, self.lengths)
        self.scored = self.inside >= plan.order - 1
        self.counted = self.scored & np.repeat(self.trained > 0, self.lengths)
        self.padding = self.words[self.tokens] == START
        self.level, self.single = 0, Level((0,) * (RARE + 1), 0, 0)
        # Of the n-gram that ends at each token: its place in this chunk, hash and count; and the
        # token's probability after it without its last word.
        self.ids = np.zeros(len(self.tokens), np.int64)
        self.hashes = np.zeros(len(self.tokens), U64)
        self.seen = np.zeros(len(self.tokens), np.int64)
        self.chance = np.zeros(len(self.tokens))

    def ask(self) -> _Asked:
        """The n-grams of the next length."""
        k, hashes = self.level + 1, self.words[self.tokens]
        asked = np.flatnonzero((self.inside >= k - 1) & ~self.padding)
        before = np.maximum(asked - 1, 0)
        kinds = len(self.words)
        keys = self.tokens[asked] if k == 1 else self.ids[before] * kinds + self.tokens[asked]
        _, first, at = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.bincount(at, self.counted[asked], len(first)).astype(np.int64)
        one = asked[first]
        words = hashes[one]
        if k == 1:
            histories, split = np.zeros(len(one), U64), np.ones(len(one), np.int64)
            slices = words % U64(self.plan.slices)
        else:
            histories = self.hashes[one - 1]
            split = self.plan.parts(np.where(self.padding[one - 1], self.plan.texts, self.seen[one - 1]))
            slices = self._slice(histories, mix(words) % split.astype(U64))
            words = words & WORD_MASK
        extra, extra_slices = self._other_parts(histories, split, slices)
        order = np.lexsort((words, histories, slices))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        grams = np.full(len(self.tokens), -1)
        grams[asked] = place[at]
        return _Asked(
            grams, slices[order], histories[order], words[order], counts[order], (self.seen if k == 2 else self.chance)[one][order], split[order] > 1,
            extra_slices, extra,
        )

    def _slice(self, histories: np.ndarray, part: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(histories + part * U64(0x9E3779B97F4A7C15)) % U64(self.plan.slices)

    def _other_parts(self, histories: np.ndarray, split: np.ndarray, slices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hot = split > 1
        if not hot.any():
            return np.zeros(0, U64), np.zeros(0, U64)
        own, first = np.unique(histories[hot], return_index=True)
        parts = split[hot][first]
        all_h = np.repeat(own, parts)
        part = np.arange(len(all_h)) - np.repeat(np.cumsum(parts) - parts, parts)
        all_s = self._slice(all_h, part.astype(U64))
        have = set(zip(slices[hot].tolist(), histories[hot].tolist(), strict=True))
        pairs = sorted(set(zip(all_s.tolist(), all_h.tolist(), strict=True)) - have)
        return np.array([h for _, h in pairs], U64), np.array([s for s, _ in pairs], U64)

    def take(self, asked: _Asked, replies: dict[int, dict[str, object]], level: Level) -> None:
        """Evaluate all tokens one level further from what the slices have replied."""
        k, d = self.level + 1, level.discounts
        parts = list(asked.by_slice())
        counts = np.concatenate([unpack(replies[s]["counts"]) for s, _, _ in parts])
        if k == 1:
            chance = single_chances(counts, level)
            self.single, mixed = level, asked.words
        else:
            chance = self._backed_off(asked, parts, replies, counts, d, self.single)
            with np.errstate(over="ignore"):
                mixed = mix(asked.histories * U64(0xC2B2AE3D27D4EB4F) + asked.words)
        has = asked.grams >= 0
        at = asked.grams[has]
        self.ids = np.where(has, asked.grams, len(counts))
        self.seen = np.zeros(len(has), np.int64)
        self.seen[has] = counts[at]
        self.hashes = np.full(len(has), mix(START + U64(k)))
        self.hashes[has] = mixed[at]
        self.chance = np.zeros(len(has))
        self.chance[has] = chance[at]
        self.level = k

    def _backed_off(
        self, asked: _Asked, parts: list[tuple[int, slice, np.ndarray]], replies: dict[int, dict[str, object]],
        counts: np.ndarray, d: np.ndarray, single: Level,
    ) -> np.ndarray:
        found = [
            (h, unpack(r["totals"]), unpack(r["rare"]).reshape(RARE, -1).T, unpack(r["sums"], np.float64))
            for h, r in ((h, replies[s]) for s, _, h in parts)
        ]
        h, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        # The parts of a split history are put together here, in the order of their slices.
        totals = np.bincount(at, np.concatenate([f[1] for f in found]), len(h))
        sums = np.bincount(at, np.concatenate([f[3] for f in found]), len(h))
        rare = np.concatenate([f[2] for f in found])
        # Where nothing unseen is asked of a history, only whether it frees anything is right, and needed.
        free = sum(np.bincount(at, rare[:, r - 1], len(h)) * ((1 - d[r - 1]) * r) for r in range(1, RARE + 1))
        # A history whose every count is above the rare ones frees nothing: one count is added.
        whole = np.where(free > 0, totals, totals + 1)
        weight = np.where(totals > 0, np.where(free > 0, free, 1.0) / whole / np.maximum(1 - sums, 1e-15), 1.0)
        of = np.searchsorted(h, asked.histories)
        below = single_chances(asked.below, single) if self.level == 1 else asked.below
        return np.where(counts > 0, kept_counts(counts, d) / np.maximum(whole[of], 1), weight[of] * below)


def _requests(chunk: Chunk) -> list[dict[str, object]]:
    """A row a slice that the chunk has something to ask of. Single words have no history."""
    asked, single, out = chunk.ask(), chunk.level == 0, []
    for s, own, h in asked.by_slice():
        words = asked.words[own]
        # A count says all of a single word's probability and takes less room.
        below = (b"", pack(asked.below[own])) if chunk.level == 1 else pack_few(asked.below[own])
        at = np.searchsorted(h, asked.histories[own])
        # The last bit of a size marks a history that is put together from several slices.
        sizes = 2 * np.bincount(at, minlength=len(h)) + 1
        sizes[at[~asked.split[own]]] &= -2
        out.append({
            "slice": s, "chunk": chunk.name, "histories": b"" if single else pack(np.diff(h, prepend=U64(0))),
            "sizes": b"" if single else pack(sizes), "words": pack(np.diff(words, prepend=U64(0)) if single else words),
            "counts": pack(asked.counts[own]), "below": below[0], "below_at": below[1],
        })
    return out


def merge_slice(pdf: pd.DataFrame, levels: tuple[Level, ...]) -> pd.DataFrame:
    """Add one slice up and reply to every chunk; a last row, of no chunk, has the slice's counts of
    counts, its tokens and kinds. ``levels`` are those below; without any, n-grams are words of no history."""
    single = not levels
    s = int(pdf["slice"].iloc[0])
    own, sizes_of, of, words, counts, below = [], [], [], [], [], []
    for row in pdf.itertuples():
        histories = np.cumsum(unpack(row.histories, U64), dtype=U64)
        w = unpack(row.words, U64)
        own.append(histories)
        sizes_of.append(unpack(row.sizes))
        of.append(np.zeros(len(w), U64) if single else np.repeat(histories, sizes_of[-1] >> 1))
        words.append(np.cumsum(w, dtype=U64) if single else w)
        counts.append(unpack(row.counts))
        at = unpack(row.below_at)
        below.append(single_chances(at, levels[0]) if len(levels) == 1 else unpack(row.below, np.float64)[at])
    lengths = [len(w) for w in words]
    ends = np.cumsum(lengths)
    h, w, c, p = (np.concatenate(x) for x in (of, words, counts, below))
    del of, words, counts, below
    with np.errstate(over="ignore"):
        keys = w if single else mix(h * U64(0x9E3779B97F4A7C15) + mix(w))
    order = np.argsort(keys, kind="stable")
    first = np.append(True, keys[order][1:] != keys[order][:-1]) if len(keys) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    total = np.add.reduceat(c[order], starts) if len(starts) else np.zeros(0, np.int64)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(first) - 1
    seen = total > 0
    names, at = np.unique(h[order][starts][seen], return_inverse=True)
    known, sizes = total[seen], len(names)
    totals = np.bincount(at, known, sizes).astype(np.int64)
    rare = np.stack([np.bincount(at, known == r, sizes).astype(np.int64) for r in range(1, RARE + 1)], 1)
    sums = np.bincount(at, p[order][starts][seen], sizes)
    # A history that is asked for and never met stands for zeros, at the end.
    names = np.append(names, U64(0))
    totals, sums, rare = np.append(totals, 0), np.append(sums, 0.0), np.vstack([rare, np.zeros((1, RARE), np.int64)])
    replies = []
    for chunk, asked_h, coded, end, n in zip(pdf["chunk"], own, sizes_of, ends, lengths, strict=True):
        place = np.searchsorted(names[:-1], asked_h)
        place[names[place] != asked_h] = sizes
        asked = total[back[end - n : end]]
        # Only an unseen n-gram needs its history's backoff weight. Of other histories the chunk
        # needs to know no more than which rare counts there are.
        unseen = np.bincount(np.repeat(np.arange(len(coded)), coded >> 1), asked == 0, len(coded)) if len(coded) else np.zeros(0)
        weighed = (unseen > 0) | (coded & 1 > 0)
        rare_of = np.where(weighed[:, None], rare[place], np.minimum(rare[place], 1))
        sums_of = np.where(weighed, sums[place], 0.0)
        replies.append((chunk, s, pack(asked), pack(totals[place]), pack(np.ascontiguousarray(rare_of.T).ravel()), pack(sums_of)))
    stats = [int((known == r).sum()) for r in range(1, RARE + 2)] + [int(known.sum()), len(known)]
    replies.append((-1, s, pack(np.array(stats)), b"", b"", b""))
    return pd.DataFrame(replies, columns=[c.split(" ")[0] for c in REPLY_SCHEMA.split(", ")])


def _merger(levels: tuple[Level, ...]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: merge_slice(pdf, levels)


class _Replies:
    """The stored replies of one level, read by the task that works on a chunk."""

    def __init__(self, path: str, groups: int) -> None:
        self.path, self.groups = path, groups

    def of(self, chunk: int) -> dict[int, dict[str, object]]:
        store, root = file_store(self.path)
        folder = f"{root}/group={_group(chunk, self.groups)}"
        if store.get_file_info(folder).type == pafs.FileType.NotFound:
            return {}
        found = pads.dataset(folder, filesystem=store, format="parquet").to_table(filter=pads.field("chunk") == chunk)
        return {row["slice"]: row for row in found.to_pylist()}


def _group(chunk: int, groups: int) -> int:
    """Chunks are named by task and place in it: both take part."""
    return ((chunk >> 32) * 31 + (chunk & 0xFFFFFFFF)) % groups


def _levels(chunks: DataFrame, plan: Plan, groups: int) -> tuple[list[Level], list[_Replies]]:
    levels: list[Level] = []
    tables: list[_Replies] = []
    for k in range(1, plan.order + 1):
        known, stored = tuple(levels), tuple(tables)

        def asks(batches: Iterator[pa.RecordBatch], known=known, stored=stored) -> Iterator[pa.RecordBatch]:
            for row, _ in _each_row(batches):
                yield _batch(_requests(_evaluated(row, plan, known, stored)), ASK_SCHEMA)

        asked = chunks.drop("keys").mapInArrow(lean(asks), ASK_SCHEMA)
        path = scratch_path(chunks.sparkSession, f"katz-level{k}")
        group = F.when(F.col("chunk") < 0, F.lit(-1).cast("long")).otherwise(
            F.pmod(F.shiftright("chunk", 32) * 31 + F.col("chunk").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(groups))
        )
        # One folder and one file a group of chunks, so files grow with chunks and not with tasks.
        replies = asked.groupBy("slice").applyInPandas(_merger(known), REPLY_SCHEMA).withColumn("group", group)
        replies.repartition("group").sortWithinPartitions("group", "chunk").write.partitionBy("group").parquet(path)
        # One row a slice reaches the driver: a dozen numbers each.
        stats = chunks.sparkSession.read.schema(f"{REPLY_SCHEMA}, group long").parquet(path).filter("group = -1 AND chunk = -1").select("counts").collect()
        sums = np.sum([unpack(r["counts"]) for r in stats], axis=0) if stats else np.zeros(RARE + 3, np.int64)
        levels.append(Level(tuple(int(x) for x in sums[: RARE + 1]), int(sums[-2]), int(sums[-1])))
        tables.append(_Replies(path, groups))
    return levels, tables


def _evaluated(row: dict[str, object], plan: Plan, levels: tuple[Level, ...], tables: tuple[_Replies, ...]) -> Chunk:
    chunk = Chunk(row, plan)
    for level, table in zip(levels, tables, strict=True):
        chunk.take(chunk.ask(), table.of(chunk.name), level)
    return chunk


def _scores(chunk: Chunk, counts: np.ndarray, level: Level) -> list[np.ndarray]:
    """By piece of a text: tokens, known ones, base and model log10 probability."""
    piece = np.repeat(np.arange(len(chunk.lengths)), chunk.lengths)[chunk.scored]
    base = np.log10((counts + 0.5) / (level.tokens + 0.5 * (level.kinds + 1)))[chunk.scored]
    n = len(chunk.lengths)
    return [
        np.bincount(piece, minlength=n), np.bincount(piece, counts[chunk.scored] > 0, n).astype(np.int64),
        np.bincount(piece, base, n), np.bincount(piece, np.log10(chunk.chance[chunk.scored]), n),
    ]


def score_texts(
    df: DataFrame, trains: Column, order: int = 2, key: str = "doc_id", text: str = "text",
    chunk_tokens: int = CHUNK_TOKENS,
) -> DataFrame:
    """Log10 probability of every text under a Katz backoff model of n-grams up to ``order``, learned
    from the texts for which ``trains`` holds.

    Tokens are the words with A-Z lower-cased and one end a text; a first word's history is the start
    of the text. Gives the key, ``trains``, ``n_tokens``, ``n_known`` (tokens met in training),
    ``train_tokens``, ``base_score`` (single words, half a count added) and ``score``. Discounts are
    Good-Turing's for counts up to 5, backoff weights make every history's probabilities sum to one
    over the training words and one unknown word.

    A null or blank text has its end alone. Null and repeated keys are texts of their own; a null
    ``trains`` is false. Without any training text every token is unknown, at probability one. An
    empty table gives none. Columns other than key and text are read by ``trains`` at most.
    Words are taken as equal when 64 bits of their hash are, and after one history when 48 of them
    are. A text longer than a chunk is several pieces whose scores are added.

    A history met more than 2^19 times (more in corpora beyond 2^36 tokens, so that there are never
    over 2^17 parts) is split over slices by its next word, so no slice grows with one history.
    """
    wanted = df.select(F.col(key), F.coalesce(trains, F.lit(False)).alias("_trains"), F.col(text).alias("_text"))
    chunks = token_chunks(wanted, key, "_trains", "_text", order, chunk_tokens)
    tokens, count, texts = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("size", F.lit(1), "texts")]).first()
    plan = Plan(order, max(8, -(-tokens // SLICE_TOKENS)), max(HOT_TOKENS, tokens // MOST_PARTS), texts)
    levels, tables = _levels(chunks, plan, max(1, count // GROUP_CHUNKS))

    kind = df.schema[key].dataType.simpleString()
    names = [key, "_row", "trains", "n_tokens", "n_known", "base_score", "score"]

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, one in _each_row(batches):
            chunk = _evaluated(row, plan, tuple(levels[:1]), tuple(tables[:1]))
            counts = chunk.seen
            for level, table in zip(levels[1:], tables[1:], strict=True):
                chunk.take(chunk.ask(), table.of(chunk.name), level)
            columns = [chunk.rows, chunk.trained > 0, *_scores(chunk, counts, levels[0])]
            yield pa.RecordBatch.from_arrays([one.column("keys").flatten(), *map(pa.array, columns)], names)

    schema = f"`{key}` {kind}, _row long, trains boolean, n_tokens long, n_known long, base_score double, score double"
    pieces = chunks.mapInArrow(lean(evaluate), schema)
    sums = [F.sum(c).alias(c) for c in names[3:]]
    return pieces.groupBy("_row").agg(F.first(key).alias(key), F.first("trains").alias("trains"), *sums).select(
        key, "trains", "n_tokens", "n_known", F.lit(levels[0].tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
