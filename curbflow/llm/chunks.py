"""Encoding texts by their distinct chunks: each chunk is encoded once per task, then looked up."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np


class ChunkEncoder:
    """Ids of whole texts, for encoders that never look across some of the spaces.

    ``cut(left, right)`` says whether the space between two neighbours of ``text.split(" ")`` is
    such a border. Every chunk between borders goes to ``encode_many`` once and its ids stay in a
    pool of bounded size; a text is put together from the pool with array operations. A text whose
    parts all have borders on both sides, the usual case, takes one dictionary lookup a word.
    """

    def __init__(
        self,
        encode_many: Callable[[list[str]], Iterable[Sequence[int]]],
        cut: Callable[[str, str], bool],
        joiner: str = " ",
        head: str = "",
        limit: int = 300_000,
    ) -> None:
        self.encode_many, self.cut, self.joiner, self.head, self.limit = encode_many, cut, joiner, head, limit
        self._clear()

    def _clear(self) -> None:
        self.plain: dict[str, int] = {}  # parts with a border on both sides, without the joiner
        self.whole: dict[str, int] = {}  # other chunks as they are encoded
        self.fresh: list[str] = []
        self.known = 0
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int32)

    def _new(self, chunk: str) -> int:
        self.fresh.append(chunk)
        return self.known + len(self.fresh) - 1

    def _whole(self, chunk: str) -> int:
        at = self.whole.get(chunk)
        if at is None:
            at = self.whole[chunk] = self._new(chunk)
        return at

    def _plan(self, text: str) -> list[int]:
        first, *parts = text.split(" ")
        plan = list(map(self.plain.get, parts))
        if None in plan:
            for i, at in enumerate(plan):
                if at is None:
                    plan[i] = self._part(parts[i])
        if -1 not in plan and (not plan or (first and self.cut(first, "x"))):
            return [self._whole(self.head + first), *plan]
        plan, chunk, left = [], self.head + first, first
        for right in parts:
            if self.cut(left, right):
                plan.append(self._whole(chunk))
                chunk = self.joiner + right
            else:
                chunk += self.joiner + right
            left = right
        plan.append(self._whole(chunk))
        return plan

    def _part(self, part: str) -> int:
        at = self.plain.get(part)
        if at is None:
            clean = part.isalnum() or (bool(part) and self.cut(part, "x") and self.cut("x", part))
            at = self.plain[part] = self._new(self.joiner + part) if clean else -1
        return at

    def _learn(self) -> None:
        if not self.fresh:
            return
        ids = list(self.encode_many(self.fresh))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))
        if self.used + len(flat) > len(self.pool):
            grown = np.zeros(max(2 * len(self.pool), self.used + len(flat)), np.int32)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used += len(flat)
        self.known += len(self.fresh)
        self.uses = np.concatenate([self.uses, np.zeros(len(self.fresh), np.int32)])
        self.fresh = []

    def _ids(self, plan: list[int]) -> np.ndarray:
        at = np.array(plan, np.int64)
        self.uses[at] += 1
        lengths = self.lengths[at]
        before = np.cumsum(lengths) - lengths
        total = int(before[-1] + lengths[-1])
        return self.pool[np.repeat(self.starts[at] - before, lengths) + np.arange(total)]

    def encode(self, texts: Iterable[str], chars: int = 1 << 20) -> Iterator[np.ndarray]:
        """The ids of each text, in order; about ``chars`` characters are planned at a time."""
        plans: list[list[int] | None] = []
        held = 0
        for text in texts:
            plans.append(self._plan(text) if text else None)
            held += len(text)
            if held >= chars:
                yield from self._flush(plans)
                plans, held = [], 0
        yield from self._flush(plans)

    def _flush(self, plans: list[list[int] | None]) -> Iterator[np.ndarray]:
        self._learn()
        for plan in plans:
            yield self._ids(plan) if plan is not None else np.zeros(0, np.int32)
        if self.known > self.limit or self.used > 16 * self.limit:
            self._forget()

    def _forget(self) -> None:
        """Keep the chunks that two texts or more have used, if they are at most half of the pool."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > self.limit // 2 or int(self.lengths[kept].sum()) > 8 * self.limit:
            self._clear()
            return
        lengths = self.lengths[kept]
        before = np.cumsum(lengths) - lengths
        pool = self.pool[np.repeat(self.starts[kept] - before, lengths) + np.arange(int(lengths.sum()))]
        place = np.full(self.known, -2, np.int64)
        place[kept] = np.arange(len(kept))
        moved = place.tolist()
        self.plain = {part: moved[at] for part, at in self.plain.items() if at >= 0 and moved[at] >= 0}
        self.whole = {chunk: moved[at] for chunk, at in self.whole.items() if moved[at] >= 0}
        self.pool, self.used, self.known = pool, len(pool), len(kept)
        self.starts, self.lengths, self.uses = before, lengths, np.zeros(len(kept), np.int32) + 1
