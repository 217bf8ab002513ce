"""Small tables with the awkward rows every operator must take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, ids string, score string, n_words string, component_id string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(n))


def texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    """(doc_id, text): nulls, blanks, exact and near copies, shared passages, a very long text."""
    rng = random.Random(seed)
    passage = sentence(rng, 70)
    base = sentence(rng, 120).split(" ")
    out: list[tuple[int | None, str | None]] = [
        (10, None), (11, ""), (12, " \t\n "), (None, sentence(rng, 80)), (None, None), (13, "one"), (14, "One"),
        (15, "a  b c d \x1c e"), (16, "word " * 400), (17, "Line one here\nLine one here\n\nlast line"),
        (18, sentence(rng, 6000)), (19, passage), (20, sentence(rng, 30) + " " + passage + "\n" + sentence(rng, 9)),
        (21, passage + " " + sentence(rng, 300)), (19, passage), (22, "😀 é ### </turn> \\ ▁ x"),
        (23, "### $$$ *** &&& " * 20), (24, "THE END!! " * 60), (25, sentence(rng, 4)), (25, sentence(rng, 4)),
        (None, passage),
    ]
    for i in range(30, 50):  # near copies of one text, each with words of its own
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        out.append((i, " ".join(words)))
    for i in range(50, 60):  # exact copies
        out.append((i, " ".join(base)))
    for i in range(60, 90):
        out.append((i, sentence(rng, rng.randint(3, 260))))
    rng.shuffle(out)
    return out


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    sources = ["hot", "hot", "hot", "b", None, "ä"]
    return spark.createDataFrame(
        [(d, t, "en", sources[i % 6], len(t or ""), 7, "x", "y", "z", "w", "c") for i, (d, t) in enumerate(rows)], DOCS
    ).repartition(5)
