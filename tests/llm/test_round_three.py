"""Fill in the middle, backoff scores and whitening against brute force; search by repeated ids."""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections import Counter, defaultdict
from functools import lru_cache
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cases import documents, texts  # noqa: E402

from curbflow.llm import katz_backoff, va_search  # noqa: E402
from curbflow.llm.fill_middle import cut_points, fill_in_middle, restored  # noqa: E402
from curbflow.llm.katz_backoff import RARE, discounts, score_texts  # noqa: E402
from curbflow.llm.token_files import BYTE_PAIRS, _tokenizer, text_encoder  # noqa: E402
from curbflow.llm.whitening import deviations, jacobi_davidson, whiten  # noqa: E402


# --- 1: a key with several vectors ----------------------------------------------------------------


def top_k(spark, rows, k=3):
    frame = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    found = va_search.exact_top_k(frame, F.col("vec_id") % 20 == 0, k)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())


def test_a_key_with_two_vectors_is_two_candidates(spark):
    rows = [(0, [1, 2]), (20, [3, 4]), (21, [5, 5]), (21, [6, 6]), (21, [6, 6])]
    assert [r for r in top_k(spark, rows) if r[0] == 0] == [(0, 1, 21, 18), (0, 2, 21, 15), (0, 3, 20, 11)]
    # A key that asks with two vectors never finds itself.
    assert all(r[2] != 20 for r in top_k(spark, [*rows, (20, [9, 9])]) if r[0] == 20)


def test_search_is_exact_beyond_the_exact_range_of_doubles(spark):
    rng = np.random.default_rng(5)
    big = (1 << 28) - rng.integers(0, 4, (60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(big)]
    ints = [[int(x) for x in v] for v in big]
    want = []
    for q in range(0, 60, 20):
        scores = sorted(((-sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), c) for c in range(60) if c != q))
        want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scores[:5])]
    assert top_k(spark, rows, 5) == want
    # Components no long could hold the products of take no part.
    assert top_k(spark, [*rows, (7, [1 << 62] * 8), (8, [-(1 << 63)] * 8)], 5) == want


# --- 2: pieces split here -------------------------------------------------------------------------


def test_chunks_split_here_have_the_ids_of_the_library():
    odd = [
        "a'b c's it's 12ab ²x µm ſx \n\n x\ny .\n\nz ... a.\nb", "x y", "Ünï_x __a-b(c) 3.14\n5", "\n a",
        " \n", "a\n b", "a \nb", "don't\nstop 'll", "×÷ ɐa ٠ _", "a\nb\nc,d\n.e 1a2b", "~`[]{}|\\ ^@ <a>\nb>", "",
    ]
    every = [t or "" for _, t in texts()] + odd
    library = _tokenizer(BYTE_PAIRS)
    for text, ids in zip(every, text_encoder().encode(every), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


# --- 11: fill in the middle -----------------------------------------------------------------------


def brute_fim(key, text, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", text, None, None, text
    if h[3] % 100 < 80:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m), text
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m), text


def test_fill_in_middle_matches_brute_force(spark):
    rows = texts() + [(k, t) for k in range(200, 260) for t in ("a <P", "<S>x", " < M> <", "퟿\U0001f600 \x1c b\n", "P> S> M> <")]
    frame = spark.createDataFrame([(k, t, "f", "o") for k, t in rows], "doc_id long, text string, form string, n string").repartition(4)
    out = fill_in_middle(frame)
    assert out.columns == ["doc_id", "text", "n", "form", "output", "prefix_chars", "middle_chars"]
    got = Counter(
        (r.doc_id, r.text, r.n, r.form, r.output, r.prefix_chars, r.middle_chars, r.back)
        for r in out.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    )
    assert got == Counter((k, t, *brute_fim(k, t)) for k, t in rows)
    assert {g[3] for g in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_of_long_texts_and_of_none(spark):
    long = "word \n" * 400_000
    assert cut_points(long, 399_999, 400_005)[0] == 400_001
    assert cut_points("", 5, 9) == (0, 0, 0)
    assert fill_in_middle(documents(spark, [])).count() == 0


# --- 12: Katz backoff -----------------------------------------------------------------------------


class Brute:
    """The model over whole Counters, with the recursion written out."""

    def __init__(self, rows, order):
        self.order = order
        lower = [re.sub("[A-Z]", lambda m: m.group().lower(), t or "") for t, _ in rows]
        self.tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", t), "</s>"] for t in lower]
        self.counts = [Counter() for _ in range(order + 1)]
        for tokens, (_, trains) in zip(self.tokens, rows, strict=True):
            padded = ["<s>"] * (order - 1) + tokens
            for i in range(order - 1, len(padded) if trains else 0):
                for k in range(1, order + 1):
                    self.counts[k][tuple(padded[i - k + 1 : i + 1])] += 1
        self.after = [defaultdict(dict) for _ in range(order + 1)]
        for k in range(1, order + 1):
            for gram, c in self.counts[k].items():
                self.after[k][gram[:-1]][gram[-1]] = c
        self.ratio = [None] + [
            discounts(tuple(sum(c == r for c in self.counts[k].values()) for r in range(1, RARE + 2))) for k in range(1, order + 1)
        ]
        self.total = sum(self.counts[1].values())
        self.history, self.chance = lru_cache(None)(self._history), lru_cache(None)(self._chance)

    def kept(self, k, c):
        return c * (self.ratio[k][c - 1] if c <= RARE else 1.0)

    def _history(self, k, h):
        """What counts are divided by, what is freed, and the unseen words' share one level below."""
        seen = self.after[k].get(h)
        if not seen:
            return None if k > 1 else (1, 1.0, 1.0)
        whole, free = sum(seen.values()), sum(c - self.kept(k, c) for c in seen.values())
        if not any(c <= RARE and self.ratio[k][c - 1] < 1 for c in seen.values()):
            whole, free = whole + 1, 1.0
        return whole, free, 1.0 if k == 1 else 1 - sum(self.chance(k - 1, h[1:], w) for w in seen)

    def _chance(self, k, h, w):
        found = self.history(k, h)
        if found is None:
            return self.chance(k - 1, h[1:], w)
        whole, free, below = found
        if c := self.counts[k][(*h, w)]:
            return self.kept(k, c) / whole
        return free / whole / below * (1.0 if k == 1 else self.chance(k - 1, h[1:], w))

    def rows(self):
        single, kinds = self.counts[1], len(self.counts[1])
        for tokens in self.tokens:
            padded = ["<s>"] * (self.order - 1) + tokens
            base = sum(math.log10((single[(w,)] + 0.5) / (self.total + 0.5 * (kinds + 1))) for w in tokens)
            score = sum(
                math.log10(self.chance(self.order, tuple(padded[i - self.order + 1 : i]), padded[i]))
                for i in range(self.order - 1, len(padded))
            )
            yield len(tokens), sum(single[(w,)] > 0 for w in tokens), self.total, base, score


@pytest.mark.parametrize(("order", "chunk", "hot"), [(1, 500, 50), (2, 1 << 20, 1 << 19), (2, 300, 20), (3, 700, 30)])
def test_backoff_scores_match_brute_force(spark, monkeypatch, order, chunk, hot):
    """Also with chunks shorter than texts, and histories split over slices."""
    monkeypatch.setattr(katz_backoff, "HOT_TOKENS", hot)
    rows = [(i, t, i % 5 != 1, "x", "y") for i, (_, t) in enumerate(texts())]
    frame = spark.createDataFrame(rows, "doc_id long, text string, learns boolean, score string, chunk string").repartition(3)
    brute = Brute([(r[1], r[2]) for r in rows], order)
    found = {r.doc_id: r for r in score_texts(frame, F.col("learns"), order=order, chunk_tokens=chunk).collect()}
    assert len(found) == len(rows)
    for row, want in zip(rows, brute.rows(), strict=True):
        got = found[row[0]]
        assert (got.trains, got.n_tokens, got.n_known, got.train_tokens) == (row[2], *want[:3])
        assert got.base_score == pytest.approx(want[3], rel=1e-9)
        assert got.score == pytest.approx(want[4], rel=1e-9)
    words = [w for (w,) in brute.counts[1]] + ["never met"]
    for h in list(brute.after[order])[:20]:
        assert sum(brute.chance(order, h, w) for w in words) == pytest.approx(1, abs=1e-9)


def test_backoff_of_untaught_and_repeated_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, None), (3, " \n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in score_texts(frame, F.lit(None).cast("boolean")).collect()))
    assert got == [(0, 2, 0, 0, 0.0), (1, 3, 0, 0, 0.0), (1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0), (3, 1, 0, 0, 0.0)]
    assert score_texts(documents(spark, []), F.lit(True)).count() == 0
    keyed = spark.createDataFrame([("x", "a b a"), ("y", "a b")], "doc_id string, text string")
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in score_texts(keyed, F.col("doc_id") == "x").collect()}
    assert got == {"x": (4, 4, 4), "y": (3, 3, 4)}


def test_discounts_are_ratios_that_free_the_singletons_share():
    of_count = (1000, 300, 140, 80, 50, 35)
    d = discounts(of_count)
    assert ((d > 0) & (d <= 1)).all()
    assert sum((1 - x) * r * n for r, (x, n) in enumerate(zip(d, of_count, strict=False), 1)) == pytest.approx(of_count[0])
    for odd in ((0,) * 6, (5, 0, 0, 0, 0, 0), (3, 9, 1, 0, 0, 0), (1, 1, 1, 1, 1, 1)):
        assert ((discounts(odd) > 0) & (discounts(odd) <= 1)).all()


# --- 13: whitening --------------------------------------------------------------------------------


@pytest.mark.parametrize(("dim", "spread"), [(1, 1), (3, 1), (40, 1), (40, 9), (130, 1)])
def test_jacobi_davidson_finds_leading_pairs(dim, spread):
    a = np.random.default_rng(dim).standard_normal((500, dim))
    a[:, : min(3, dim)] *= spread
    matrix = a.T @ a / 500
    values, vectors = jacobi_davidson(lambda block: matrix @ block, dim, 4)
    want = np.linalg.eigvalsh(matrix)[::-1][:4]
    assert values == pytest.approx(want, rel=1e-12)
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() < 1e-12 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_whitening_matches_dense_algebra(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(0, [3, 2, 1.5, 1, 0.5, 0.1], (300, 6))
    vectors[100:220] = vectors[100]  # a common vector counts once in the fit
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(vectors)] + [
        (5, vectors[5].tolist(), "x", 1), (None, vectors[6].tolist(), "x", 1), (900, None, "x", 1), (901, [1.0, None] * 3, "x", 1),
        (902, [float("nan")] * 6, "x", 1), (903, [float("inf")] * 6, "x", 1), (904, [], "x", 1), (905, [1e300] * 6, "x", 1),
        (906, [1.0, 2.0], "x", 1), (907, [2.0, 1.0], "x", 1), (908, [0.5], "x", 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, n int").repartition(4)
    got = whiten(frame).collect()
    x = np.floor(256 * vectors).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:4], basis[:, ::-1][:, :4]
    want = (x - sums / n) @ (basis / np.sqrt(values))
    six = [r for r in got if r.n == n]
    assert Counter(r.vec_id for r in six) == Counter({i: 4 for i in range(300)} | {5: 8, None: 4})
    for c in range(4):
        mine = {r.vec_id: r for r in six if r.component == c + 1 and r.vec_id is not None}
        column = np.array([mine[i].whitened for i in range(300)])
        assert min(np.abs(column - want[:, c]).max(), np.abs(column + want[:, c]).max()) < 1e-9
        assert mine[0].explained == pytest.approx(values[c] / np.trace(centred.T @ centred / n), rel=1e-10)
        assert mine[0].identity_error < 1e-10
        assert [mine[i].deviation for i in range(300)] == ((n * x - sums) ** 2).sum(1).tolist()
    # Two vectors of another length are a fit of one component; one alone has no variance.
    assert sorted((r.vec_id, r.component, r.n) for r in got if r.n != n) == [(906, 1, 2), (907, 1, 2)]
    assert whiten(frame.limit(0)).count() == 0


def test_deviations_stay_exact_or_null():
    x = np.array([[1 << 30, -(1 << 30)], [3, 4]])
    assert deviations(x, 5, np.array([7, -7])) == [None if v >= 1 << 63 else v for v in (2 * (5 * (1 << 30) - 7) ** 2, (15 - 7) ** 2 + (20 + 7) ** 2)]
    assert deviations(x, 1, np.array([0, 0])) == [2 << 60, 25]
