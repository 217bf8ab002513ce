"""Links inside groups that have more members than leaders."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cases import documents  # noqa: E402

from curbflow.llm.jaccard_join import near_duplicates  # noqa: E402


def words(name: str, n: int) -> str:
    return " ".join(f"{name}{i}" for i in range(n))


def behind_leaders(tag: str, start: int) -> list[tuple[int, str]]:
    """Two texts of 720 shingles, each with 80 of its own, that link at exactly 80 %.

    All keys they share also belong to three longer texts of commoner words, which lead and link with nobody.
    The two share more keys than the one whose places let the pair through.
    """
    shared, rest = words(f"{tag}t", 114), words(f"{tag}u", 534)
    rows = [(start + i, f"{shared} {words(f'{tag}own{i}x', 76)} {rest}") for i in range(2)]
    longer = [words(f"{tag}r{i}x", 890) for i in range(3)]
    rows += [(start + 2 + i, f"{shared} {text}") for i, text in enumerate(longer)]
    return rows + [(start + 5 + i, " ".join([rest, *longer])) for i in range(20)]


def test_links_behind_leaders_are_kept(spark):
    rows = [row for i, tag in enumerate("abcd") for row in behind_leaders(tag, 100 * i)]
    got = near_duplicates(documents(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert {r.n_shingles for r in got if r.doc_id % 100 < 2} == {720}
    # The two are one component, the copies behind them another, and each longer text its own.
    least = [0, 0, 2, 3, 4] + [5] * 20
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 100 + least[i % 100] for i, _ in rows}
