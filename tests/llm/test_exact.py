"""Every operator against a brute-force version, with nulls, blanks, repeats and odd texts."""

from __future__ import annotations

import hashlib
import json
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cases import documents, texts  # noqa: E402

from curbflow.llm import va_search  # noqa: E402
from curbflow.llm.byte_shards import shard_by_bytes, text_bytes  # noqa: E402
from curbflow.llm.components import connected  # noqa: E402
from curbflow.llm.host_rules import base_measures, host_rates, host_rules  # noqa: E402
from curbflow.llm.jaccard_join import keep_first, near_duplicates  # noqa: E402
from curbflow.llm.piece_codec import PIECES, decode_pieces, encode_pieces, load_model, tokenizer_path  # noqa: E402
from curbflow.llm.quality_mil import score_quality, train_quality  # noqa: E402
from curbflow.llm.reply_trees import (  # noqa: E402
    conversation_digests, format_branches, format_turns, loss_text, parse_turns, root_paths,
)
from curbflow.llm.source_mix import POINT_BITS, bit_reversed, mix_sources, mixed_rows, schedule_slots  # noqa: E402
from curbflow.llm.substring_dedup import SALTS, WIDTH, _packed_rows, _write_blocks, counters, pack, remove_repeats, repeated_windows, unpack  # noqa: E402
from curbflow.llm.token_files import (  # noqa: E402
    build_levels, find_documents, key_occurrences, places, read_digests, text_encoder, write_token_files,
)
from curbflow.session import scratch_path  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def split(text):
    return text.encode().split() if text else []


# --- 1: exact top-k -------------------------------------------------------------------------------


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.integers(-40, 41, 8).tolist() for i in range(300)}
    for i in range(100, 140):
        vectors[i] = vectors[100]  # a very common vector, and with it ties
    rows = [(i, v, "x") for i, v in vectors.items()] + [(7, vectors[7], "x"), (900, None, "x"), (901, [1, None] * 4, "x"), (None, [1] * 8, "x"), (902, [5, 5], "x")]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>, score string").repartition(4)
    got = defaultdict(list)
    for r in va_search.exact_top_k(df, F.col("vec_id") % 20 == 0, k=20, bits=3, block=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    assert set(got) == {i for i in vectors if i % 20 == 0}
    for q, found in got.items():
        scores = sorted(((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q))
        assert found == [(-s, i) for s, i in scores[:20]]


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1, 2]), (20, [3, 4]), (21, [0, 0])], "vec_id long, v array<long>")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in va_search.exact_top_k(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1, 20, 11), (0, 2, 21, 0), (20, 1, 0, 11), (20, 2, 21, 0)}
    assert va_search.exact_top_k(df.limit(0), F.lit(True)).count() == 0


def test_empty_vectors_score_zero_among_themselves(spark):
    df = spark.createDataFrame([(0, []), (20, []), (21, []), (40, [3, 4]), (41, [1, 2])], "vec_id long, v array<long>")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in va_search.exact_top_k(df, F.col("vec_id") % 20 == 0, k=2).collect()}
    assert got == {(0, 1, 20, 0), (0, 2, 21, 0), (20, 1, 0, 0), (20, 2, 21, 0), (40, 1, 41, 11)}


def test_unusable_vectors(spark):
    df = spark.createDataFrame([(1, [1.5, -0.1]), (2, [float("nan"), 0.0]), (3, [None, 0.0]), (4, None), (5, [float("-inf"), 0.0])], "vec_id long, e array<float>")
    got = df.filter(va_search.usable(F.col("e"))).select(va_search.scaled(F.col("e"), 64).alias("v")).collect()
    assert [r.v for r in got] == [[96, -7]]


# --- 2: token files -------------------------------------------------------------------------------


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(2)
    h1, h2 = (rng.integers(0, 1 << 63, 5000).astype(np.uint64) for _ in range(2))
    levels = build_levels(h1, h2)
    assert sorted(places(levels, h1, h2).tolist()) == list(range(5000))
    assert build_levels(h1[:0], h2[:0]) == []


def test_encoder_equals_the_library_on_odd_spaces():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    odd = ["a  b", "  lead", "trail  ", " \n b", "a \nb", "it's 's x", "tab\t x", "a  b", "x \x1cy", "<|endoftext|> a", " ", "\n", "é 😀 x", "a Ġ b", "a　 b", "a ​ b"]
    odd += [t for _, t in texts() if t]
    for text, ids in zip(odd * 2, text_encoder().encode(odd * 2), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    files = write_token_files(docs, scratch_path(spark, "test-tokens"), keys_per_index=16)
    assert files.buckets > 3
    rows = read_digests(files, find_documents(files, key_occurrences(docs))).collect()
    expected, start = Counter(), 0
    by_key = defaultdict(list)
    for d, t in texts():
        by_key[d].append(library.encode(t or "", add_special_tokens=False).ids + [2])
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.start, r.n_tokens, r.ids_crc32))
    for d in sorted(by_key, key=lambda k: (k is not None, k or 0)):
        at = start
        got = sorted(found[d])
        assert len(got) == len(by_key[d])
        for s, n, _ in got:
            assert s == at
            at += n
        sums = Counter((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in by_key[d])
        assert Counter((n, c) for _, n, c in got) == sums
        start = at
    assert not expected
    absent = spark.createDataFrame([(10_000 + i, 0) for i in range(200)], "doc_id long, occurrence long")
    assert find_documents(files, absent).count() == 0


def test_token_files_of_nothing(spark, empty):
    files = write_token_files(empty, scratch_path(spark, "test-tokens"))
    assert read_digests(files, find_documents(files, key_occurrences(empty))).count() == 0


# --- 3: substring dedup ---------------------------------------------------------------------------


def removed_by_hand(rows, window):
    first = {}
    for d, t in rows:
        if d is not None:
            w = split(t)
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return Counter(out)


@pytest.mark.parametrize("window", [3, 50])
def test_repeats_removed_as_by_hand(docs, window):
    got = remove_repeats(docs, window=window).select("doc_id", "n_words", "n_removed", "text").collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, b" ".join(split(r.text))) for r in got) == removed_by_hand(texts(), window)
    before = Counter(texts())
    assert all(before[(r.doc_id, r.text)] for r in got if not r.n_removed)


def test_packing_follows_the_windows_and_not_the_slices():
    rng = np.random.default_rng(5)
    h1, h2 = (rng.integers(0, 1 << 63, 300).astype(np.uint64) for _ in range(2))
    h1[200:], h2[200:] = h1[:100], h2[:100]
    got = _packed_rows(3, [(h1[:150], h2[:150]), (h1[150:], h2[150:])], 1 << 35).to_pylist()
    for r in range(2):
        want = Counter(counters(h1, h2, 1 << 35, r).tolist())
        rows = [row for row in got if row["r"] == r]
        assert len({row["slice"] for row in rows}) == len(rows) <= 200
        for name, many in (("once", False), ("more", True)):
            found = [row["slice"] * WIDTH + p for row in rows for p in unpack(row[name]).tolist()]
            assert sorted(found) == sorted(k for k, n in want.items() if (n > 1) == many)


def test_files_of_repeats_follow_the_blocks_and_not_the_tasks(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 7}x{j}" for j in range(60))) for i in range(240)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        blocks = _write_blocks(docs.repartition(6), "doc_id", "text")
        path = repeated_windows(blocks, "text", 50)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = spark.read.parquet(path)
    assert stored.select("block").distinct().count() == 6
    assert len(stored.inputFiles()) <= 6 * SALTS


def test_remove_repeats_of_nothing_and_columns(empty):
    got = remove_repeats(empty)
    assert got.count() == 0
    assert dict(got.dtypes)["n_words"] == "bigint"


def test_packing():
    numbers = np.array([0, 1, 5, 70_000, 4_000_000_000], np.uint64)
    assert unpack(pack(numbers)).tolist() == numbers.tolist()
    assert len(unpack(pack(numbers[:0]))) == 0


# --- 4: quality -----------------------------------------------------------------------------------


def test_quality_learns_and_scores_everything(spark, docs):
    junk = {d for d, t in texts() if t and (t.startswith("###") or t.startswith("THE END") or t.startswith("word word"))}
    labels = [(d, 0 if d in junk else 1) for d, _ in texts() if d is not None and d not in (10, 11, 12)] + [(None, 1), (61, None)]
    model = train_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = score_quality(docs, model).collect()
    assert len(rows) == len(texts())
    assert all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text, r.score) == r.score
    assert all((r.score < 0.5) == (r.doc_id in junk) for r in rows if r.doc_id is not None and r.doc_id > 18)


def test_quality_without_rows_or_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = train_quality(docs, none)
    assert {r.score for r in score_quality(docs, model).collect()} == {0.5}
    assert score_quality(empty, train_quality(empty, none)).count() == 0


def test_gradients_are_right():
    from curbflow.llm.quality_mil import FEATURES, fit

    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, FEATURES)).astype(np.float32) for n in (1, 3, 2)]
    y = np.array([1.0, 0.0, 1.0])
    model = fit(bags, y, epochs=1)
    x, starts = np.concatenate(bags).astype(np.float64), np.array([0, 1, 4])

    def loss():
        s = model.forward(x, starts)["s"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for name, g in model.gradients(x, starts, y).items():
        w = model.weights[name] = np.array(model.weights[name], np.float64)
        at = (0,) * w.ndim
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6, name


# --- 5: reply trees -------------------------------------------------------------------------------


def test_paths_of_trees_circles_and_orphans(spark):
    nodes = [(1, None), (2, 1), (3, 1), (4, 2), (5, 4), (6, 99), (7, 8), (8, 7), (9, 8), (10, None)]
    got = defaultdict(dict)
    for r in root_paths(spark.createDataFrame(nodes, "node long, parent long")).collect():
        got[r.leaf][r.distance] = r.node
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {5: [5, 4, 2, 1], 3: [3, 1], 6: [6], 10: [10]}


def test_best_branches_and_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", None, "", "a\\b#<c>\n", "x: y\n### user: z</turn>\n"]
    nodes = [(1, None, 5, "user", said[0], 1.0), (2, 1, 5, "assistant", said[1], 1.0), (3, 1, 5, "assistant", said[3], 3.0), (4, 3, 5, None, said[4], None), (9, None, None, "assistant", said[0], 0.0)]
    df = spark.createDataFrame(nodes, "node long, parent long, conversation long, role string, text string, score double")
    rows = {(r.root, r.rank): r for r in format_branches(df, branches=2).collect()}
    assert set(rows) == {(1, 1), (1, 2), (9, 1)}
    best = rows[1, 1]
    assert (best.leaf, best.n_turns, best.conversation) == (4, 3, 5)
    assert parse_turns(best.formatted) == [("user", said[0]), ("assistant", said[3]), ("", said[4])]
    assert loss_text(best.formatted, [(s.first, s.last) for s in best.loss_spans]) == said[3]
    assert rows[1, 2].leaf == 2
    digests = {r.conversation: r for r in conversation_digests(format_branches(df)).collect()}
    assert digests[None].loss_sha256 == hashlib.sha256(said[0].encode()).hexdigest()
    assert format_branches(df.limit(0)).count() == 0


def test_roles_with_marks():
    turns = [("a: b\\#<", "x"), ("😀", "é" * 3)]
    formatted, spans = format_turns(turns, "😀")
    assert parse_turns(formatted) == turns
    assert loss_text(formatted, spans) == "ééé"
    with pytest.raises(ValueError):
        parse_turns(formatted + "x")


# --- 6: shards ------------------------------------------------------------------------------------


def test_shards_are_contiguous_gapless_and_even(docs):
    sizes = docs.select("doc_id", text_bytes(F.col("text")).alias("size"), F.col("shard"), F.crc32(F.col("text").cast("binary")).alias("c"))
    rows = shard_by_bytes(sizes, 5, tie="c").collect()
    assert len(rows) == len(texts())
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 16 for _, t in texts())
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    last = None
    for shard in range(5):
        own = sorted((r for r in rows if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 5) <= largest
        for r in own:
            key = (r.doc_id is not None, r.doc_id or 0)
            assert last is None or key >= last
            last = key
    assert shard_by_bytes(sizes.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        shard_by_bytes(sizes, 0)


def test_one_key_spreads_over_shards(spark):
    rows = spark.range(1000).select(F.lit(1).alias("doc_id"), F.lit(10).alias("size"))
    counts = shard_by_bytes(rows, 4).groupBy("shard").count().collect()
    assert {r["shard"]: r["count"] for r in counts} == {i: 250 for i in range(4)}


# --- 7: mixing ------------------------------------------------------------------------------------


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_sources, out = sum(sizes.values()), set(order), {}
    while True:
        level = left / sum(weight[s] for s in open_sources) if open_sources else 0
        over = [s for s in open_sources if weight[s] * level >= 3 * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in open_sources}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
            open_sources.discard(s)


def test_mix_meets_targets(docs):
    mix = mix_sources(docs, block_words=32)
    rows = mix.documents.collect()
    assert len(rows) == len(texts())
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert sorted(r.size for r in rows) == sorted(len(split(t)) for _, t in texts())
    by_hand = targets_by_hand(sizes)
    for s in sizes:
        assert abs(target[s] - by_hand[s]) < 1e-6
        assert abs(taken[s] - target[s]) <= 1
    slots = Counter()
    for p in mix.parts.collect():
        slots[p.slot] += p.words
    assert max(slots.values()) <= 32
    again = mix_sources(docs.repartition(3), block_words=32).documents
    pick = lambda df: Counter((r.doc_id, r.size, r.taken) for r in df)
    assert pick(again.collect()) == pick(rows)
    assert all((split(r.text)) for r in mixed_rows(docs).collect())


def test_mix_prefixes_stay_near_the_shares(spark, docs):
    mix = mix_sources(docs, block_words=16)
    share = {r.source: r.target for r in mix.documents.select("source", "target").distinct().collect()}
    total = sum(share.values())
    slots = sorted({(p.slot, p.source) for p in mix.parts.collect()}, key=lambda x: x[0])
    seen = Counter()
    for n, (_, source) in enumerate(slots[: len(slots) // 2], 1):
        seen[source] += 1
        assert all(abs(seen[s] - n * share[s] / total) < 8 for s in share)


def test_mix_of_nothing(spark, empty):
    mix = mix_sources(empty)
    assert (mix.documents.count(), mix.parts.count()) == (0, 0)
    blank = documents(spark, [(1, None), (2, " ")])
    assert [r.taken for r in mix_sources(blank).documents.collect()] == [0, 0]


def _stated_targets(spark, limits):
    rows = [(i, limit, sum(limits[:i]), sum(limits)) for i, limit in enumerate(limits)]
    return spark.createDataFrame(rows, "_id int, _limit long, _from long, _all long")


def test_slots_are_the_first_points_of_every_interval(spark):
    limits = [700, 1, 0, 64, 129, 2, 3104]
    got: dict[int, list[int]] = {}
    for r in schedule_slots(_stated_targets(spark, limits), 8).collect():
        got.setdefault(r["_id"], []).append(r.slot)
    point = [int(f"{i:013b}"[::-1], 2) / (1 << 13) for i in range(1 << 13)]
    for i, limit in enumerate(limits):
        low, high, blocks = sum(limits[:i]) / sum(limits), sum(limits[: i + 1]) / sum(limits), -(-limit // 8)
        want = [n for n, p in enumerate(point) if low <= p < high][:blocks]
        assert sorted(got.get(i, []))[:blocks] == want
        assert len(set(got.get(i, []))) == len(got.get(i, [])) <= (blocks + 4 * POINT_BITS if blocks else 0)


def test_schedule_does_not_grow_with_the_smallest_source(spark):
    # Three words among 10^12: drawing to the first point there would take 10^11 slots and more.
    limits, block_words = [10**12 // 3, 3, 2 * 10**12 // 3], 10**7
    rows = schedule_slots(_stated_targets(spark, limits), block_words).groupBy("_id").count().collect()
    needed = {i: -(-limit // block_words) for i, limit in enumerate(limits)}
    assert len(rows) == 3
    assert all(needed[r["_id"]] <= r["count"] <= needed[r["_id"]] + 4 * POINT_BITS for r in rows)


def test_one_short_document_is_a_source(spark):
    docs = spark.createDataFrame([(i, "a", "w " * 40) for i in range(3000)] + [(9999, "b", "one two three")], "doc_id long, source string, text string")
    rows = {r.doc_id: r for r in mix_sources(docs, block_words=16).documents.collect()}
    assert rows[9999].taken == rows[9999].target == 9
    assert sum(r.taken for r in rows.values()) == 3000 * 40 + 3


def test_points_are_bit_reversed(spark):
    got = [r[0] for r in spark.range(6).select(bit_reversed(F.col("id")) / float(1 << POINT_BITS)).collect()]
    assert got == [0, 0.5, 0.25, 0.75, 0.125, 0.625]


# --- 8: near duplicates ---------------------------------------------------------------------------


def components_by_hand(rows):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in split(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(set)
    for i, (d, _) in enumerate(rows):
        least[find(i)].add(d)
    return [(d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)], [find(i) for i in range(len(rows))]


def family(seed, n=60, words=60, edits=9):
    """Many near copies around the threshold, some linked only through others."""
    import random

    from cases import sentence

    rng = random.Random(seed)
    rows, last = [], sentence(rng, words).split(" ")
    for i in range(n):
        w = list(last)
        for _ in range(rng.randint(0, edits) // 4):
            w[rng.randrange(len(w))] = sentence(rng, 1)
        if i % 7 == 0:
            last = w
        rows.append((1000 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("rows", [texts(), family(1), family(2, words=9), family(3, n=90, words=200, edits=40)], ids=["cases", "family", "short", "long"])
def test_components_as_by_hand(spark, rows):
    got = near_duplicates(documents(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    expected, groups = components_by_hand(rows)
    assert Counter(tuple(r) for r in got) == Counter(expected)
    kept = keep_first(documents(spark, rows))
    assert kept.count() == len(set(groups))
    assert kept.columns == documents(spark, []).columns


def test_components_of_nothing(empty):
    assert near_duplicates(empty).count() == 0
    assert keep_first(empty).count() == 0


def test_connected_long_chain_and_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 300)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(50)}


# --- 9: host rules --------------------------------------------------------------------------------


def measures_by_hand(text):
    text = text or ""
    w = split(text)
    wins = defaultdict(list)
    for i in range(len(w) - 7):
        wins[tuple(w[i : i + 8])].append(i)
    covered = {p for at in wins.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if split(x)]
    chars = sum(len(x.decode()) for x in w)
    return len(w), chars, sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures_as_by_hand(docs):
    got = base_measures(docs).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert len(got) == len(texts())
    for r in got:
        assert tuple(r)[1:6] == measures_by_hand(r.text), r.text
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_host_verdicts_reach_their_documents(spark, empty):
    good = "plain words that say a thing or two about the world and go on for a while without any repeats at all here"
    rows = [(i, good + f" {i}") for i in range(60)] + [(100 + i, "bad " * 40) for i in range(40)]
    host = lambda d: None if d < 30 else "mixed" if d < 60 else "bad"
    df = spark.createDataFrame([(d, t, host(d)) for d, t in rows], "doc_id long, text string, source string")
    df = df.unionByName(spark.createDataFrame([(999, good, "bad")], df.schema))
    kept = {r.doc_id: r.kept for r in host_rules(df).collect()}
    assert kept == {d: d < 60 for d, _ in rows} | {999: False}
    rates = {r["_host"]: r for r in host_rates(base_measures(df), "source").collect()}
    assert rates["bad"].failures == 40 and 0.5 < rates["bad"].host_rate < 40 / 41 + 1e-9
    assert host_rules(empty).count() == 0


# --- 10: pieces -----------------------------------------------------------------------------------


def best_score_by_hand(model, text):
    """Exact dynamic programme over all pieces, without the automaton."""
    pieces = {p: s for p, (_, s, _) in model.automaton.items()}
    best = [0.0]
    for p in range(1, len(text) + 1):
        found = [best[a] + pieces[text[a:p]] for a in range(max(0, p - 40), p) if text[a:p] in pieces]
        if text[p - 1] not in pieces:
            found.append(best[p - 1] + model.unknown)
        best.append(max(found))
    return best[-1]


def test_pieces_are_best_and_decode(docs):
    rows = decode_pieces(encode_pieces(docs)).select("text", "ids", "decoded").collect()
    assert len(rows) == len(texts())
    model = load_model(tokenizer_path(PIECES))
    score = {i: s for _, s, i in (v for _, v in model.automaton.items())}
    for r in rows:
        assert r.decoded == (r.text or "").replace("▁", " ")
        if not r.text:
            assert r.ids == []
        elif len(r.text) < 3000:
            marked = "▁" + r.text.replace(" ", "▁")
            unknown = sum(c not in model.singles for c in marked)
            own = sum(score.get(i, 0.0) for i in r.ids)
            assert abs(own + unknown * model.unknown - best_score_by_hand(model, marked)) < 1e-3


def test_pieces_equal_the_library_lattice():
    import sentencepiece

    raw = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES)).serialized_model_proto()
    at = raw.rindex(b"\x18\x02 \x80\xfa\x01")  # the file's kind, set to a best-score model
    library = sentencepiece.SentencePieceProcessor(model_proto=raw[:at] + b"\x18\x01" + raw[at + 2 :])
    model = load_model(tokenizer_path(PIECES))
    for text in ("the", "at the end of it", "Hello world", "that unhappiness is in international hands"):
        best = library.nbest_encode_as_pieces(text, 2)[0]
        assert [library.id_to_piece(int(i)) for i in next(iter(model.encoder.encode([text])))] == best


def test_pieces_of_nothing(empty):
    got = decode_pieces(encode_pieces(empty))
    assert got.count() == 0
    assert dict(got.dtypes)["ids"] == "array<int>"


def test_every_query_is_registered():
    from curbflow.llm.queries import QUERIES

    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 11))
    assert json.dumps(sorted(QUERIES))


# --- hashing --------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [16, 64, 1 << 20])
def test_word_hashes_do_not_depend_on_pieces(monkeypatch, limit):
    import pyarrow as pa

    from curbflow.llm import text_hash

    column = pa.array([t.encode() if t is not None else None for _, t in texts()] + [b"x" * 300 + b" y"], pa.binary())
    whole = [run.hashes for run in text_hash.hashed_texts(column)]
    monkeypatch.setattr(text_hash, "CHUNK_BYTES", limit)
    parts = list(text_hash.hashed_texts(column))
    assert np.array_equal(np.concatenate(whole), np.concatenate([run.hashes for run in parts]))
    assert sum(run.count for run in parts) == len(column)
    counts = np.concatenate([np.diff(run.first) for run in parts]).tolist()
    assert counts == [len(split(t)) for _, t in texts()] + [2]
    by_word = {}
    words = [w for _, t in texts() for w in split(t)] + [b"x" * 300, b"y"]
    for word, value in zip(words, np.concatenate(whole).tolist(), strict=True):
        assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word)
