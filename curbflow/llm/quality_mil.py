"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded by its own figures; a gated attention,
learned from document labels alone, weighs the encodings, and the weighted sum is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbflow.llm.common import Interned, bytes_column, lean, small_batches, words_of

PASSAGE_WORDS = 64
MAX_WORDS_KNOWN = 300_000


def _classes() -> np.ndarray:
    """Byte to class: other text, lower, upper, digit, sentence marks, symbols, beyond ASCII."""
    kind = np.zeros(256, np.int64)
    for chars, value in (
        (b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3),
        (b".,;:'\"-()", 4), (b"#*$%&|<>", 5), (b"!?", 6),
    ):
        kind[list(chars)] = value
    kind[128:] = 7
    return kind


CLASSES = _classes()
N_CLASSES = 8
FEATURES = N_CLASSES + 8


class PassageEncoder:
    """Figures of every passage of ``PASSAGE_WORDS`` words: shares of byte classes, word length,
    words met before in the passage, equal neighbours, word pairs met before in the document,
    length and line ends. A text without words is one passage of zeros with a mark of its own."""

    def __init__(self) -> None:
        self.known = Interned()

    def passages(self, text: bytes | None) -> np.ndarray:
        words = words_of(text)
        n = len(words)
        if not n:
            empty = np.zeros((1, FEATURES), np.float32)
            empty[0, -1] = 1.0
            return empty
        if len(self.known) > MAX_WORDS_KNOWN:
            self.known = Interned()
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, n)
        self.known.fresh.clear()
        lengths = np.fromiter(map(len, words), np.int64, n)
        of_word = np.arange(n) // PASSAGE_WORDS
        count = int(of_word[-1]) + 1
        size = np.bincount(of_word, minlength=count).astype(np.float64)
        chars = np.bincount(of_word, lengths, count)
        body = np.frombuffer(b"".join(words), np.uint8)
        of_byte = np.repeat(of_word, lengths)
        shares = np.bincount(of_byte * N_CLASSES + CLASSES[body], minlength=count * N_CLASSES).reshape(count, N_CLASSES)
        distinct = np.unique(of_word << 40 | ids) >> 40
        distinct = np.bincount(distinct, minlength=count)
        same = np.zeros(n, bool)
        same[1:] = ids[1:] == ids[:-1]
        again = np.zeros(n, bool)
        if n > 1:
            pairs = ids[:-1] << 32 | ids[1:]
            again[1:] = True
            again[1:][np.unique(pairs, return_index=True)[1]] = False
        out = np.empty((count, FEATURES), np.float32)
        out[:, :N_CLASSES] = shares / np.maximum(chars, 1)[:, None]
        out[:, N_CLASSES] = np.log1p(chars / size)
        out[:, N_CLASSES + 1] = distinct / size
        out[:, N_CLASSES + 2] = np.bincount(of_word, same, count) / size
        out[:, N_CLASSES + 3] = np.bincount(of_word, again, count) / size
        out[:, N_CLASSES + 4] = np.log1p(size)
        out[:, N_CLASSES + 5] = text.count(b"\n") / n
        out[:, N_CLASSES + 6] = np.log1p(n)
        out[:, N_CLASSES + 7] = 0.0
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class MilModel:
    """Weights of encoder (E, e), gated attention (V, U, w) and score (c, d), and the scaling."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = (v * u) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(h * a[:, None], starts)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "sizes": sizes, "s": _sigmoid(z @ p["c"] + p["d"])}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *(len(b) for b in bags[:-1])])
        return self.forward(np.concatenate(bags).astype(np.float64), starts)["s"]

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.weights, self.forward(x, starts)
        n, sizes = len(y), f["sizes"]
        ds = (f["s"] - y) / n
        dz = ds[:, None] * p["c"][None, :]
        dz_each = np.repeat(dz, sizes, 0)
        da = (dz_each * f["h"]).sum(1)
        mean_da = np.repeat(np.add.reduceat(da * f["a"], starts), sizes)
        dl = f["a"] * (da - mean_da)
        dv = dl[:, None] * p["w"][None, :] * f["u"] * (1 - f["v"] ** 2)
        du = dl[:, None] * p["w"][None, :] * f["v"] * f["u"] * (1 - f["u"])
        dh = dz_each * f["a"][:, None] + dv @ p["V"].T + du @ p["U"].T
        dpre = dh * (1 - f["h"] ** 2)
        return {
            "E": f["x"].T @ dpre, "e": dpre.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du,
            "w": ((f["v"] * f["u"]) * dl[:, None]).sum(0), "c": f["z"].T @ ds, "d": np.array(ds.sum()),
        }


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 60, seed: int = 5, hidden: int = 16, gate: int = 8) -> MilModel:
    """Minimise log loss with Adam over batches of bags. Without bags every score is one half."""
    rng = np.random.default_rng(seed)
    shapes = {"E": (FEATURES, hidden), "e": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "d": ()}
    weights = {k: rng.normal(0, 0.3, s) if len(s) > 1 or k in "wc" else np.zeros(s) for k, s in shapes.items()}
    if not bags:
        weights["c"] = np.zeros(hidden)
        return MilModel(weights, np.zeros(FEATURES), np.ones(FEATURES))
    flat = np.concatenate(bags).astype(np.float64)
    model = MilModel(weights, flat.mean(0), flat.std(0) + 1e-3)
    first = {k: np.zeros_like(w) for k, w in weights.items()}
    second = {k: np.zeros_like(w) for k, w in weights.items()}
    step, batch = 0, 128
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            x = np.concatenate([bags[i] for i in chosen]).astype(np.float64)
            starts = np.cumsum([0, *(len(bags[i]) for i in chosen[:-1])])
            step += 1
            for k, g in model.gradients(x, starts, labels[chosen]).items():
                g = g + 1e-4 * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def in_fold(key: str, fold: int, folds: int = 3):
    """True where crc32 of the key as text falls into ``fold``; null keys are in none."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train_quality(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    max_documents: int = 4000, max_passages: int = 256, epochs: int = 60,
) -> MilModel:
    """Fit on at most ``max_documents`` labelled documents, the first in the order of a hash of the
    key, of at most ``max_passages`` passages each. That bound is for fitting only: scores always
    take every passage. Rows with a null key or label are not learned from; a key labelled twice
    takes its smaller label; a key that several documents carry gives several bags."""
    chosen = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("_key")).agg(F.min(F.col(label)).cast("double").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key").limit(max_documents)
    )
    # At most ``max_documents`` rows.
    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PassageEncoder()
        for batch in batches:
            keys, found, kept = batch.column("_key").to_pylist(), [], []
            for i, body in enumerate(bytes_column(batch, "_text")):
                bag = encoder.passages(body)
                if len(bag) <= max_passages:
                    kept.append(i)
                    found.append(bag.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i] for i in kept], batch.column("_key").type), pa.array(found, pa.binary()), batch.column("_label").take(pa.array(kept, pa.int64()))],
                ["_key", "bag", "label"],
            )

    kind = rows.schema["_key"].dataType.simpleString()
    sample = small_batches(rows).mapInArrow(lean(encode), f"_key {kind}, bag binary, label double").collect()
    sample.sort(key=lambda r: (str(r["_key"]), bytes(r["bag"])))  # the same order in every run
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in sample]
    return fit(bags, np.array([r["label"] for r in sample]), epochs)


def score_quality(df: DataFrame, model: MilModel, text: str = "text", score: str = "score") -> DataFrame:
    """``df`` with a score between 0 and 1 from the whole of each row's text alone.

    Null, empty and blank texts are bags of one marked passage and get a score as well. Equal texts
    get equal scores. An input column named like ``score`` is replaced.
    """
    source = df.drop(score)
    schema = T.StructType([*source.schema.fields, T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PassageEncoder()
        for batch in batches:
            scores, bags, held = [], [], 0
            for body in bytes_column(batch, text):
                bags.append(encoder.passages(body))
                held += len(bags[-1])
                if held > 4096:
                    scores.append(model.score(bags))
                    bags, held = [], 0
            if bags:
                scores.append(model.score(bags))
            flat = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flat)], [*batch.schema.names, score])

    return small_batches(source).mapInArrow(lean(run), schema)
