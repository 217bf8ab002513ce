"""Near-duplicate documents by exact n-gram Jaccard, found through parity sketches.

A document's set of shingles is written as a parity sketch: each shingle flips one of 2^40 bits,
and the odd ones are kept. Two sketches differ in no more bits than the sets differ in shingles,
and sets that link differ in at most a quarter of the smaller one. If a partner may differ in d
bits, a sketch is cut into d + 1 chunks that hold one odd bit each; d differences spoil d chunks,
so one is intact in the partner. Chunks are cut around the rarest bits first, in an order all
sketches share, which keeps common passages out of the keys. Documents of a size band that meet in
a chunk are candidates. All bits before the first chunk they share differ, so their places in both
orders bound the distance of the sketches from below and drop most candidates at once; the others
are verified on their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbflow.llm.common import lean, small_batches, written
from curbflow.llm.components import connected
from curbflow.llm.substring_dedup import _of_block, _stored_by_block
from curbflow.llm.text_hash import hashed_texts, mix

SHINGLE = 5
LINK_PERCENT = 80
COMMON_BITS = 20  # counters of the sketch that orders bits by how common they are
COMMON_SLICES = 16
SKETCH_BITS = 40
FOLD_WORDS = 16
LEADERS = 3
LOW = (1 << 32) - 1
PER_SALT = 512
U64 = np.uint64


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted. A-Z count as a-z."""
    for run in hashed_texts(column, lower=True):
        windows, _, at = run.windows(size, both=False)
        edges = np.searchsorted(at, run.first)
        for i in range(run.count):
            a, b = edges[i], edges[i + 1]
            if a < b:
                yield np.unique(windows[a:b])
                continue
            words = run.hashes[run.first[i] : run.first[i + 1]]
            if not len(words):
                yield np.zeros(0, U64)
                continue
            with np.errstate(over="ignore"):
                spread = mix(words + np.arange(1, len(words) + 1, dtype=U64))
                yield mix(np.array([spread.sum(dtype=U64) + U64(len(words))], U64))


def chosen_sets(batch: pa.RecordBatch, text: str, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row number, set) of the rows of a batch whose numbers are wanted."""
    rids = batch.column("_rid").to_numpy(zero_copy_only=False)
    at = np.flatnonzero(np.isin(rids, wanted))
    if len(at):
        yield from zip(rids[at].tolist(), shingle_sets(batch.column(text).take(pa.array(at))), strict=True)


def counter_of(bits: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(bits) >> U64(64 - COMMON_BITS)).astype(np.int64)


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """The odd bits of the sketch, from sorted shingles: two shingles on one bit cancel out."""
    bits = shingles >> U64(64 - SKETCH_BITS)
    starts = np.flatnonzero(np.append(True, bits[1:] != bits[:-1])) if len(bits) else np.zeros(0, np.int64)
    return bits[starts[np.diff(np.append(starts, len(bits))) % 2 == 1]]


def folded(bits: np.ndarray) -> np.ndarray:
    """The sketch folded by exclusive or to about a bit an odd bit, as words of 64 bits.

    The length is a power of two that follows the size, FOLD_WORDS words at least. Folding lets
    more bits cancel, so the distance of folded sketches is below that of the whole.
    """
    size = max(64 * FOLD_WORDS, 1 << len(bits).bit_length())
    with np.errstate(over="ignore"):
        at = mix(bits + U64(2)) & U64(size - 1)
    odd = (np.bincount(at.astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def sketches_fit(a: str, b: str, n_a: str, n_b: str) -> str:
    """SQL condition: the folded sketches do not rule out that the sets link. Of sets that may link
    one sketch is at most twice as long; it is folded once more, by its halves."""

    def like(x: str, y: str) -> str:
        return (
            f"CASE WHEN size({x}) > size({y}) THEN zip_with(slice({x}, 1, size({y})), "
            f"slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q) ELSE {x} END"
        )

    apart = f"aggregate(zip_with({like(a, b)}, {like(b, a)}, (p, q) -> bit_count(p ^ q)), 0, (s, p) -> s + p)"
    return f"9 * {apart} <= {n_a} + {n_b}"


def in_order(bits: np.ndarray, common: np.ndarray, most: int, seed: int) -> np.ndarray | None:
    """The first ``most`` + 1 odd bits in the common order, rare ones first; None if there are fewer."""
    if len(bits) <= most:
        return None
    with np.errstate(over="ignore"):
        ranked = common[counter_of(bits)].astype(U64) << U64(56) | mix(bits + U64(seed)) >> U64(8)
    if len(bits) > most + 1:
        bits, ranked = (x[np.argpartition(ranked, most)[: most + 1]] for x in (bits, ranked))
    return bits[np.argsort(ranked)]


def chunk_keys(bits: np.ndarray, band: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(bits + U64(1)) ^ U64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def key_bands(n: int) -> list[tuple[int, int]]:
    """(band, largest difference) under which a set of ``n`` shingles looks for partners: its own
    band, for partners from it and the next, and the band below, for smaller partners there."""
    band = n.bit_length() - 1
    out = [(band, n // 4)]
    limit = (1 << band) - 1  # the largest set of the band below
    if band and 4 * n <= 5 * limit:
        out.append((band - 1, min(2 * n // 9, limit // 4)))
    return out


def _digests(rows: DataFrame, text: str) -> DataFrame:
    """Per row its set's size, digest and folded sketch (kind 0); per task, slices of how often bits occur (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.zeros(1 << COMMON_BITS, np.int64)
        for batch in batches:
            sizes, first, second, small = [], [], [], []
            for bits in shingle_sets(batch.column(text)):
                sizes.append(len(bits))
                with np.errstate(over="ignore"):
                    first.append(int(mix(bits).sum(dtype=U64).view(np.int64)) if len(bits) else 0)
                    second.append(int(np.bitwise_xor.reduce(mix(bits + U64(1))).view(np.int64)) if len(bits) else 0)
                odd = parity_sketch(bits)
                small.append(folded(odd))
                np.add.at(common, counter_of(odd), 1)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), batch.column("_rid"), batch.column("_key"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(small, pa.list_(pa.int64())), pa.nulls(n, pa.binary())],
                ["kind", "rid", "key", "n", "s1", "s2", "sketch", "counts"],
            )
        squeeze = zstandard.ZstdCompressor(level=1).compress
        parts = [squeeze(p.astype("<u4").tobytes()) for p in np.split(np.minimum(common, (1 << 32) - 1), COMMON_SLICES)]
        none = pa.nulls(COMMON_SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(COMMON_SLICES, np.int32)), none, none, pa.array(np.arange(COMMON_SLICES)), none, none, pa.nulls(COMMON_SLICES, pa.list_(pa.int64())), pa.array(parts, pa.binary())],
            ["kind", "rid", "key", "n", "s1", "s2", "sketch", "counts"],
        )

    return written(
        rows.mapInArrow(lean(run), "kind int, rid long, key long, n long, s1 long, s2 long, sketch array<long>, counts binary"), "jaccard-digests"
    )


def _common_bits(digests: DataFrame) -> np.ndarray:
    """How common each counter's bits are, in steps of a logarithm: one byte a counter, 2^20 in
    all at any size of input. It orders chunks and decides nothing else."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        expand = zstandard.ZstdDecompressor().decompress
        total = np.zeros((1 << COMMON_BITS) // COMMON_SLICES, np.int64)
        for raw in pdf["counts"]:
            total += np.frombuffer(expand(raw), "<u4")
        return pd.DataFrame({"n": [pdf["n"].iloc[0]], "steps": [np.minimum(255, 4 * np.log2(total + 1)).astype(np.uint8).tobytes()]})

    rows = digests.filter("kind = 1").select("n", "counts").groupBy("n").applyInPandas(add, "n long, steps binary").collect()
    out = np.zeros(1 << COMMON_BITS, np.uint8)
    width = (1 << COMMON_BITS) // COMMON_SLICES
    for row in rows:
        out[row["n"] * width : (row["n"] + 1) * width] = np.frombuffer(row["steps"], np.uint8)
    return out


def _by_block(df: DataFrame, rid: str, name: str) -> str:
    """Stored by the block that a row number belongs to: its upper bits are the partition."""
    return _stored_by_block(df.withColumn("block", F.shiftright(rid, 33)), name)


class _Listed:
    """What is stored for the blocks of a batch: row numbers, and each one's pairs if there are any."""

    def __init__(self, path: str) -> None:
        self.path, self.blocks, self.table = path, None, None

    def rids(self, batch: pa.RecordBatch) -> np.ndarray:
        blocks = np.unique(batch.column("_rid").to_numpy(zero_copy_only=False) >> 33).tolist()
        if blocks != self.blocks:
            stored = [t for b in blocks if (t := _of_block(self.path, b)) is not None]
            self.blocks, self.table = blocks, pa.concat_tables(stored).sort_by("rid") if stored else None
            self.known = self.table["rid"].to_numpy() if stored else np.zeros(0, np.int64)
        return self.known

    def roles(self, rid: int) -> Iterator[tuple[int, int]]:
        a, b = np.searchsorted(self.known, [rid, rid + 1])
        own = self.table.slice(a, b - a)
        return zip(own["a"].to_pylist(), own["salt"].to_pylist(), strict=True)


def _keys(rows: DataFrame, text: str, chosen: str, common: np.ndarray, seed: int) -> DataFrame:
    """(key, place, rid, n) of the chosen rows; a row whose sketch has too few odd bits has n = -1.

    A place is a rank and, in its lower half, the number of chunks before this one. The rank puts
    documents made of common bits first: in a family of edited copies, the text they were made from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = _Listed(chosen)
        for batch in batches:
            keys, places, rids, sizes = [], [], [], []
            for rid, shingles in chosen_sets(batch, text, listed.rids(batch)):
                bits, bands = parity_sketch(shingles), key_bands(len(shingles))
                rank = int(16 * (255 - common[counter_of(bits)].mean())) if len(bits) else 0
                ordered = in_order(bits, common, max(most for _, most in bands), seed)
                for band, most in bands:
                    n = len(shingles) if ordered is not None else -1
                    found = chunk_keys(ordered[: most + 1], band) if ordered is not None else np.zeros(1, U64)
                    keys.append(found.view(np.int64))
                    places.append(np.arange(len(found)) + (rank << 32))
                    rids.append(np.full(len(found), rid, np.int64))
                    sizes.append(np.full(len(found), n, np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (keys, places, rids, sizes)], ["key", "place", "rid", "n"]
                )

    return rows.mapInArrow(lean(run), "key long, place long, rid long, n int")


def may_link(n_a: np.ndarray, before_a: np.ndarray, n_b: np.ndarray, before_b: np.ndarray) -> np.ndarray:
    """Whether two sets may link that share a chunk with so many chunks before it in each.

    Of the first chunk they share, every chunk before it is odd in one sketch alone. Sets that link
    differ in at most (n_a + n_b) / 9 shingles. At a later shared chunk the answer may be no; the
    first one has fewer before it and keeps the pair.
    """
    small, large = np.minimum(n_a, n_b).astype(np.int64), np.maximum(n_a, n_b).astype(np.int64)
    return (100 * small >= LINK_PERCENT * large) & (9 * (before_a + before_b) <= small + large)


class _Groups:
    """Rows sorted by key and place, a batch at a time: the first LEADERS rows of a key meet all others.

    Rows behind them are passed on (kind 1) where two or more are left, for later rounds. Only the
    first rows of the key at hand are carried from batch to batch, so a group may be of any size.
    """

    def __init__(self) -> None:
        self.key, self.seen = None, 0
        self.heads = np.full((LEADERS + 1, 3), -1, np.int64)  # rid, place and n of its first rows

    def feed(self, key: np.ndarray, place: np.ndarray, rid: np.ndarray, n: np.ndarray) -> list[tuple]:
        """Arrays (kind, key, a, b, n) of one batch; b of kind 1 is the place."""
        n = n.astype(np.int64)
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        group = np.repeat(np.arange(len(starts)), sizes)
        before = np.zeros(len(starts), np.int64)
        heads = np.full((len(starts), LEADERS + 1, 3), -1, np.int64)
        if key[0] == self.key:
            before[0], heads[0] = self.seen, self.heads
        turn = np.arange(len(key)) - starts[group] + before[group]
        first = turn <= LEADERS
        heads[group[first], turn[first]] = np.column_stack([rid[first], place[first], n[first]])
        out = []
        for j in range(LEADERS):
            rows = np.flatnonzero(turn > j)
            lead = heads[group[rows], j]
            fit = may_link(lead[:, 2], lead[:, 1] & LOW, n[rows], place[rows] & LOW)
            rows, lead = rows[fit], lead[fit, 0]
            if len(rows):
                out.append((np.zeros(len(rows), np.int32), key[rows], np.minimum(lead, rid[rows]), np.maximum(lead, rid[rows]), n[rows]))
        late = np.flatnonzero(turn > LEADERS)
        if len(late):
            out.append((np.ones(len(late), np.int32), key[late], rid[late], place[late], n[late]))
            at = late[turn[late] == LEADERS + 1]
            if len(at):
                lead = heads[group[at], LEADERS]
                out.append((np.ones(len(at), np.int32), key[at], lead[:, 0], lead[:, 1], lead[:, 2]))
        last = len(starts) - 1
        self.key, self.seen, self.heads = key[-1], int(before[last] + sizes[last]), heads[last]
        return out


def _meet(keys: DataFrame) -> DataFrame:
    """kind 0: (a, b) pairs to verify; kind 1: rows of groups not yet done; kind 2: too few bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups()
        for batch in batches:
            key, place, rid, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "place", "rid", "n"))
            short = n < 0
            out = []
            if short.any():
                out.append((np.full(int(short.sum()), 2, np.int32), key[short], rid[short], rid[short], n[short].astype(np.int64)))
                key, place, rid, n = key[~short], place[~short], rid[~short], n[~short]
            if len(key):
                out += groups.feed(key, place, rid, n)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["kind", "key", "a", "b", "n"])

    return (
        keys.repartition("key").sortWithinPartitions("key", "place", "rid")
        .mapInArrow(lean(run), "kind int, key long, a long, b long, n long")
    )


def verified(rows: DataFrame, text: str, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets link.

    Every set goes once to each pair it is the second of, and first sets once to every PER_SALT of
    their pairs, so a first set with very many partners is compared in many tasks.
    """
    counted = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_SALT).alias("salts")), "a").withColumn(
        "salt", F.pmod(F.xxhash64("b"), F.col("salts"))
    )
    seconds = counted.select(F.col("b").alias("rid"), "a", "salt")
    firsts = counted.select(F.col("a").alias("rid"), "a", "salt").distinct()
    roles = _by_block(seconds.unionByName(firsts), "rid", "jaccard-roles")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = _Listed(roles)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            held = 0
            for rid, shingles in chosen_sets(batch, text, listed.rids(batch)):
                raw = shingles.tobytes()
                for a, salt in listed.roles(rid):
                    for column, value in zip(out, (a, salt, rid, raw), strict=True):
                        column.append(value)
                    held += len(raw)
                if held > 1 << 23:
                    yield _set_rows(out)
                    out, held = ([], [], [], []), 0
            if out[0]:
                yield _set_rows(out)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, np.zeros(0, U64)
        for batch in batches:
            a_out, b_out = [], []
            for a, salt, rid, raw in zip(batch.column("a").to_pylist(), batch.column("salt").to_pylist(), batch.column("rid").to_pylist(), batch.column("set"), strict=True):
                other = np.frombuffer(raw.as_py(), U64)
                if rid == a:
                    at, first = (a, salt), other
                    continue
                if at != (a, salt):
                    raise ValueError("a pair's first set is missing")
                both = len(np.intersect1d(first, other, assume_unique=True))
                if 100 * both >= LINK_PERCENT * (len(first) + len(other) - both):
                    a_out.append(a)
                    b_out.append(rid)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return written(
        rows.mapInArrow(lean(sets_of), "a long, salt long, rid long, set binary")
        .repartition("a", "salt")
        # a is the smaller of its pair, so its own set comes first.
        .sortWithinPartitions("a", "salt", "rid")
        .mapInArrow(lean(compare), "a long, b long"),
        "jaccard-links",
    )


def _set_rows(out: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["a", "salt", "rid", "set"])


def _with_components(df: DataFrame, column: str, nodes: DataFrame, name: str) -> DataFrame:
    named = nodes.select(F.col("node").alias(column), F.col("component").alias(name))
    return df.join(named, column, "left").withColumn(name, F.coalesce(name, column))


def _joined(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` after more links: only the components that these connect are worked on again."""
    ends = _with_components(_with_components(links, "a", nodes, "ca"), "b", nodes, "cb")
    roots = connected(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    moved = roots.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    known = nodes.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return written(known.unionByName(roots.join(nodes, "node", "left_anti")), "jaccard-nodes")


def link_components(rows: DataFrame, text: str, found: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, component) over all links among documents that share a chunk.

    First each document meets the one it shares most chunks with, then every other pair whose ends
    are still apart. In a group with more members than leaders, documents outside its largest
    component lead in turn, a growing number a round, until all that is left of it is connected; so
    a group of near copies takes one round and no group is compared pair by pair.
    """
    met = found.filter("kind = 0").groupBy("a", "b").agg(F.count("*").alias("shared"))
    for end in ("a", "b"):
        met = met.join(sketches.select(F.col("rid").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"s_{end}")), end)
    pairs = written(met.filter(sketches_fit("s_a", "s_b", "n_a", "n_b")).select("a", "b", "shared"), "jaccard-pairs")
    nearest = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    nodes = written(connected(verified(rows, text, written(nearest.select("a", "b"), "jaccard-nearest"))), "jaccard-nodes")
    apart = _with_components(_with_components(pairs, "a", nodes, "ca"), "b", nodes, "cb").filter("ca <> cb")
    apart = written(apart.join(nearest, ["a", "b"], "left_anti").select("a", "b"), "jaccard-apart")
    if not apart.isEmpty():
        nodes = _joined(nodes, verified(rows, text, apart))
    tested = pairs.select("a", "b")
    groups = found.filter("kind = 1").select("key", F.col("a").alias("rid"), F.col("b").alias("place"), "n").distinct()
    groups = groups.withColumn("before", F.col("place").bitwiseAND(F.lit(LOW)))
    # A member with too many chunks before this one links with nobody here, not even with the
    # member that has the fewest.
    fewest = groups.groupBy("key").agg(F.min("before").alias("_fewest"))
    groups = groups.join(fewest, "key").filter("4 * (before + _fewest) <= n").drop("_fewest")
    # Keys with the same members are one group. The first key that a pair shares may be any of them,
    # so a member takes its least place over all: no pair is refused that its first key would keep.
    alike = groups.groupBy("key").agg(F.xxhash64(F.sum(F.xxhash64("rid").cast("decimal(38,0)")), F.count("*")).alias("_class"))
    merged = groups.join(alike, "key").groupBy("_class", "rid").agg(F.min("place").alias("place"), F.min("n").alias("n"))
    groups = merged.select(F.col("_class").alias("key"), "rid", "place", "n", F.col("place").bitwiseAND(F.lit(LOW)).alias("before"))
    groups = groups.join(sketches.select("rid", "sketch"), "rid")
    groups = written(groups, "jaccard-groups")
    leaders = 256
    while True:
        members = _with_components(groups, "rid", nodes, "c")
        split = members.groupBy("key").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).filter("_lo < _hi").select("key")
        live = written(members.join(split, "key", "left_semi"), "jaccard-live")
        if live.isEmpty():
            return nodes
        largest = live.groupBy("key", "c").agg(F.count("*").alias("_n")).groupBy("key").agg(
            F.max_by("c", F.struct("_n", "c")).alias("_main")
        )
        turn = Window.partitionBy("key").orderBy("place", "rid")
        lead = written(
            live.join(largest, "key").filter("c <> _main").withColumn("_turn", F.row_number().over(turn))
            .filter(F.col("_turn") <= leaders).select("key", F.col("rid").alias("lead"), F.col("c").alias("lead_c"), F.col("n").alias("lead_n"), F.col("before").alias("lead_before"), F.col("sketch").alias("lead_sketch")),
            "jaccard-leaders",
        )
        fit = F.expr(
            f"100 * least(n, lead_n) >= {LINK_PERCENT} * greatest(n, lead_n) AND 9 * (before + lead_before) <= n + lead_n AND "
            + sketches_fit("sketch", "lead_sketch", "n", "lead_n")
        )
        fresh = (
            live.join(lead, "key").filter((F.col("c") != F.col("lead_c")) & fit)
            .select(F.least("rid", "lead").alias("a"), F.greatest("rid", "lead").alias("b")).distinct()
            .join(tested, ["a", "b"], "left_anti")
        )
        fresh = written(fresh, "jaccard-fresh")
        if not fresh.isEmpty():
            nodes = _joined(nodes, verified(rows, text, fresh))
            tested = tested.unionByName(fresh)
        led = lead.select("key", F.col("lead").alias("rid"))
        groups = written(live.select("key", "rid", "place", "n", "before", "sketch").join(led, ["key", "rid"], "left_anti"), "jaccard-groups")
        leaders *= 16


def _grouped(source: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows as written once, and (rid, key, n, component) of each; a component is named by the
    least row number of its sets, and of a row without shingles by its own."""
    rows = written(
        small_batches(source).withColumns({"_rid": F.monotonically_increasing_id(), "_key": F.col(key).cast("long")}), "jaccard-rows"
    )
    narrow = rows.select("_rid", "_key", text)
    digests = _digests(narrow, text)
    sets = digests.filter("kind = 0").drop("kind", "counts", "sketch")
    sketches = digests.filter("kind = 0").select("rid", "n", "sketch")
    by_set = ["n", "s1", "s2"]
    classes = written(sets.filter("n > 0").groupBy(*by_set).agg(F.min("rid").alias("rep")), "jaccard-classes")
    # Sets of one to three shingles link with equal sets alone.
    chosen = _by_block(classes.filter("n > 3").select(F.col("rep").alias("rid")), "rid", "jaccard-chosen")
    common = _common_bits(digests)
    seed = 0
    while True:
        found = written(_meet(_keys(narrow, text, chosen, common, seed)), "jaccard-found")
        if found.filter("kind = 2").isEmpty():
            break
        seed += 1  # another order of the bits, for all
    nodes = link_components(narrow, text, found, sketches)
    named = _with_components(classes, "rep", nodes, "component").select(*by_set, "component")
    members = sets.join(named, by_set, "left").select(
        "rid", "key", "n", F.coalesce("component", "rid").alias("component")
    )
    return rows, written(members, "jaccard-members")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``n_shingles`` and ``component_id``, the least key that links lead to.

    Words are those between white space, A-Z in lower case; a set has the distinct sequences of
    SHINGLE words, or the whole sequence where there are fewer words. Two rows link when their sets'
    Jaccard similarity is at least LINK_PERCENT hundredths. Null, empty and blank texts have empty
    sets and link with nothing: their component is their own key. Rows with equal sets are one class
    and are compared once, whatever their number. Null keys are never the least where another is;
    a component of null keys alone has a null id. Repeated keys are separate rows. Input columns
    named like the two new ones are replaced; an empty table stays empty.

    Shingles are told apart by 64-bit hashes.
    """
    source = df.drop("n_shingles", "component_id")
    rows, members = _grouped(source, key, text)
    least = members.groupBy("component").agg(F.min("key").alias("component_id"))
    found = members.join(least, "component").select(F.col("rid").alias("_rid"), F.col("n").alias("n_shingles"), "component_id")
    return rows.join(found, "_rid").select(*source.columns, "n_shingles", "component_id")


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each component: the one with the least key, null keys last, and of
    equal keys the first. Rows without shingles all stay. Texts are not shuffled: the rows to drop
    are listed by block, and each task leaves out those of its own blocks."""
    rows, members = _grouped(df, key, text)
    order = F.struct(F.col("key").isNull().alias("no_key"), "key", "rid")
    first = members.groupBy("component").agg(F.min(order).alias("_first"))
    surplus = members.join(first, "component").filter("rid <> _first.rid").select("rid")
    dropped = _by_block(surplus, "rid", "jaccard-dropped")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, gone = None, np.zeros(0, np.int64)
        for batch in batches:
            rids = batch.column("_rid").to_numpy(zero_copy_only=False)
            keep = np.ones(len(rids), bool)
            for block in np.unique(rids >> 33).tolist():
                if block != current:
                    current, stored = block, _of_block(dropped, block)
                    gone = stored["rid"].to_numpy() if stored is not None else np.zeros(0, np.int64)
                keep &= ~np.isin(rids, gone)
            yield batch.filter(pa.array(keep)).select(names)

    return rows.mapInArrow(lean(run), df.schema)
