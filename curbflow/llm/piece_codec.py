"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from curbflow.llm.chunks import ChunkEncoder
from curbflow.llm.common import lean, small_batches

MARK = "▁"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceModel:
    """Pieces, scores and bytes of a SentencePiece file, and the automaton over the pieces.

    The file's processor is used to read the vocabulary only. A character that no piece covers is
    written as its UTF-8 bytes, at a score below every piece.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        vocab = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(vocab.get_piece_size())
        self.bytes_of: list[bytes] = [b""] * len(ids)
        self.byte_id: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        self.singles: set[str] = set()
        lowest = 0.0
        self.crosses = False
        for i in ids:
            piece = vocab.id_to_piece(i)
            if vocab.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif not (vocab.is_control(i) or vocab.is_unknown(i) or vocab.is_unused(i)):
                score = float(vocab.get_score(i))
                lowest = min(lowest, score)
                self.automaton.add_word(piece, (len(piece), score, i))
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
                if len(piece) == 1:
                    self.singles.add(piece)
                rest = piece.lstrip(MARK)
                self.crosses |= MARK in rest
        self.automaton.make_automaton()
        self.unknown = lowest - 10.0

    def viterbi(self, text: str) -> list[int]:
        """The best-scoring pieces of marked text; of equal scores the longer last piece wins.

        The automaton reads each character once; at every position it names all pieces that end
        there, longest first, by following its output links, and each relaxes that position's best.
        """
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        closed = 0

        def close(p: int) -> None:
            if text[p - 1] not in self.singles:
                score = best[p - 1] + self.unknown
                if best[p] is None or score > best[p]:
                    best[p], back[p] = score, (p - 1, -1)

        for end, (length, score, piece) in self.automaton.iter(text):
            p = end + 1
            while closed < p - 1:
                closed += 1
                close(closed)
            total = best[p - length] + score
            if best[p] is None or total > best[p]:
                best[p], back[p] = total, (p - length, piece)
        while closed < n:
            closed += 1
            close(closed)
        out: list[int] = []
        p = n
        while p:
            start, piece = back[p]
            if piece < 0:
                out.extend(self.byte_id[b] for b in reversed(text[start:p].encode("utf-8", "replace")))
            else:
                out.append(piece)
            p = start
        return out[::-1]

    @cached_property
    def encoder(self) -> ChunkEncoder:
        """Whole texts. No piece has the mark behind another character, so the best path of a text
        is made of the best paths between such places, and words are encoded once each. It stays
        with the Python worker, so later tasks know the words of earlier ones."""
        if self.crosses:
            cut = lambda left, right: False  # noqa: E731 - one chunk: pieces may cross spaces
        else:
            cut = lambda left, right: bool(left) and left[-1] != MARK
        return ChunkEncoder(
            lambda chunks: [self.viterbi(c.replace(" ", MARK)) for c in chunks], cut, joiner=MARK, head=MARK, limit=200_000
        )

    def decode(self, ids: np.ndarray) -> str:
        """The text: marks are spaces, the mark put in front of every text goes, bytes are UTF-8."""
        table = self.bytes_of
        text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


def _replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | {name: values}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode_pieces(
    df: DataFrame, text: str = "text", ids: str = "ids", decoded: str | None = None, model: str = PIECES
) -> DataFrame:
    """``df`` with the piece ids of each whole text; a null or empty text has no ids. With
    ``decoded``, the ids are decoded again in the same pass, into a column of that name.

    Every row is encoded by itself, so repeated rows agree and an empty table stays empty. An input
    column named like ``ids`` is replaced. U+2581 in a text is a space to this vocabulary.
    """
    source = df.drop(ids) if ids != text else df
    schema = _schema(df, ids, T.ArrayType(T.IntegerType(), False))
    if decoded:
        source = source.drop(decoded)
        fields = [f for f in schema.fields if f.name != decoded]
        schema = T.StructType([*fields, T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_model(tokenizer_path(model))
        encoder = pieces.encoder
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = (x.as_py() or "" for x in batch.column(text))
                found = list(encoder.encode(texts))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = np.concatenate(found) if found else np.zeros(0, np.int32)
                batch = _replaced(batch, ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                if decoded:
                    batch = _replaced(batch, decoded, pa.array([pieces.decode(x) for x in found], pa.string()))
                yield batch

    return small_batches(source).mapInArrow(lean(run), schema)


def decode_pieces(
    df: DataFrame, ids: str = "ids", text: str = "decoded", model: str = PIECES
) -> DataFrame:
    """``df`` with the text of each row's ids; null ids give the empty text."""
    source = df.drop(text) if text != ids else df
    schema = _schema(df, text, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_model(tokenizer_path(model))
        for batch in batches:
            column = batch.column(ids)
            texts = [
                pieces.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in column
            ]
            yield _replaced(batch, text, pa.array(texts, pa.string()))

    return small_batches(source).mapInArrow(lean(run), schema)
