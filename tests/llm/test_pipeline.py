"""Every stage of the corpus pipeline against a brute-force version of what its input asks for."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from curbflow.llm.common import table, written
from curbflow.llm.quality_mil import score_quality, train_quality

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of each stage, with awkward rows among the documents."""
    docs = table(spark, SF_DIR, "documents")
    long = " ".join(f"w{i}" for i in range(130))
    odd = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "one"), (-5, long), (-6, long), (-7, long + " tail of its own"), (-8, "😀 é ▁ x")]
    more = spark.createDataFrame([(k, t) for k, t in odd], "doc_id long, text string").select(
        "doc_id", "text", F.lit("en").alias("lang"), F.when(F.col("doc_id") % 2 == 0, "src0").alias("source"), F.length("text").cast("long").alias("n_chars")
    )
    frame = written(docs.select(more.columns).unionByName(more).select(docs.columns), "pipeline-test")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, frame, SF_DIR), name)
        if name == "quality_classifier":  # go on with the odd rows also where they are rejected
            after_all = written(after.filter("doc_id >= 0").unionByName(frame.filter("doc_id < 0")), "pipeline-test")
        else:
            after_all = after
        out[name] = frame, after
        frame = after_all
    return out


def rows(frame):
    return [r.asDict() for r in frame.collect()]


def test_columns_stay_those_of_documents(steps):
    for name, (before, after) in list(steps.items())[:-1]:
        assert after.schema == before.schema, name


def test_quality_keeps_what_the_classifier_does_not_reject(spark, steps):
    before, after = steps["quality_classifier"]
    scores = score_quality(before, train_quality(before, table(spark, SF_DIR, "labels")))
    want = {r.doc_id for r in scores.collect() if r.score >= 0.5}
    assert {r["doc_id"] for r in rows(after)} == want
    assert 0 < len(want) < before.count()


def test_one_document_of_each_group_of_near_duplicates_stays(steps):
    before, after = map(rows, steps["near_duplicates"])
    sets = {}
    for r in before:
        w = words(re.sub("[A-Z]", lambda m: m.group().lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {d: d for d in sets}
    by_shingle = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by_shingle[x].append(d)
    pairs = {(a, b) for ds in by_shingle.values() for a in ds for b in ds if a < b}
    linked = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        moved = False
        for a, b in linked:
            low = min(group[a], group[b])
            moved |= group[a] != low or group[b] != low
            group[a] = group[b] = low
        if not moved:
            break
    assert sorted(r["doc_id"] for r in after) == sorted(set(group.values()))
    assert any(d != g for d, g in group.items())


def test_repeated_passages_are_removed(steps):
    before, after = map(rows, steps["substring_dedup"])
    first = {}
    for r in before:
        w = words(r["text"])
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    want, lost = {}, 0
    for r in before:
        w = words(r["text"])
        gone = {p for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < r["doc_id"] for p in range(i, i + 50)}
        lost += len(gone)
        want[r["doc_id"]] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r["text"]
    assert lost > 0
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in after)


def test_mix_takes_sources_near_their_targets(steps):
    before, after = map(rows, steps["source_mix"])
    assert {r["doc_id"]: r["text"] for r in after}.items() <= {r["doc_id"]: r["text"] for r in before}.items()
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in before:
        n = len(words(r["text"]))
        sizes[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    for r in after:
        taken[r["source"]] += len(words(r["text"]))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, stopped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped)
        whole = sum(weight[s] for s in order if s not in stopped)
        target = {s: 3 * sizes[s] if s in stopped else rest * weight[s] / whole for s in order}
        over = {s for s in order if s not in stopped and target[s] > 3 * sizes[s]}
        if not over:
            break
        stopped |= over
    for s in order:
        assert abs(taken[s] - target[s]) <= longest[s] + 1, s


def test_pieces_decode_to_the_texts(steps):
    before, after = steps["piece_encoding"]
    done = rows(after)
    assert Counter(r["doc_id"] for r in done) == Counter(r["doc_id"] for r in rows(before))
    assert all(r["n_pieces"] == len(r["ids"]) for r in done)
    texts = {r["doc_id"]: r["text"] for r in rows(before)}
    # U+2581 stands for a space among pieces, as in the library.
    assert all(r["round_trip"] or "▁" in texts[r["doc_id"]] for r in done)


def test_the_whole_run_is_its_stages_one_after_another(spark):
    whole = corpus_pipeline.run(spark, SF_DIR)
    ids = {r.doc_id for r in table(spark, SF_DIR, "documents").select("doc_id").collect()}
    got = rows(whole)
    assert got and {r["doc_id"] for r in got} <= ids
    assert whole.columns == ["doc_id", "source", "n_pieces", "ids", "round_trip"]
    assert all(r["round_trip"] for r in got)


def test_columns_with_clashing_names_come_through(spark):
    own = ["score", "n_words", "n_removed", "size", "ids", "component_id", "taken", "_row"]
    docs = table(spark, SF_DIR, "documents").limit(60)
    frame = written(docs.select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in own]), "pipeline-test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, frame, SF_DIR), name)
        assert after.schema == frame.schema, name
        assert after.filter(" OR ".join(f"{n} <> concat('{n}-', doc_id)" for n in own)).isEmpty(), name
        frame = after
    assert frame.count() > 0


def test_an_empty_table_passes_through(spark):
    frame = table(spark, SF_DIR, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        if name == "quality_classifier":
            continue  # a classifier needs labelled documents
        frame = written(stage(spark, frame, SF_DIR), name)
    assert frame.count() == 0
