"""SentencePiece encoding by an Aho-Corasick automaton and a single-pass Viterbi search.

The automaton over all pieces reads a text once.  At each position its output links name every
piece that ends there, longest first; each relaxes the best score of the position from the
best score of its start.  The best segmentation is read off backwards.  A character that no
piece covers costs ``unknown_penalty`` more than the least likely piece and becomes byte pieces
where the model has them, else the unknown id.

Pieces of the usual models do not cross the beginning of a word, so the search runs word by
word; a worker keeps the ids of the words it has met.  A model with pieces that do cross is
searched text by text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm import hashing
from concordat.llm.common import batch, holding, texts
from concordat.llm.tokens import WordCache, by_size

SPACE = "▁"
_MODELS: dict[str, PieceModel] = {}


class PieceModel(WordCache):
    """Pieces and scores of one model file; one per worker and file."""

    unknown_penalty = 10.0

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        super().__init__()
        self._library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self._library
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.scores = np.array([sp.get_score(i) for i in range(size)])
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(size)]
        self.unknown = sp.unk_id()
        self._byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if sp.is_byte(i)}
        self._bytes = {b: i for i, b in self._byte_of.items()}
        self._control = {i for i in range(size) if sp.is_control(i)}
        plain = [i for i in range(size) if not special[i]]
        self._least = min((self.scores[i] for i in plain), default=0.0) - self.unknown_penalty
        self._automaton = ahocorasick.Automaton()
        for i in plain:
            self._automaton.add_word(self.pieces[i], (len(self.pieces[i]), float(self.scores[i]), i))
        self._automaton.make_automaton()
        self.by_word = not any(SPACE in self.pieces[i].lstrip(SPACE) for i in plain)

    def normalized(self, text: str) -> str:
        """The text as the model's pieces spell it, with the mark for spaces."""
        return self._library.normalize(text)

    def best(self, text: str) -> list[int]:
        """Ids of the best segmentation of a normalized text; of equal scores the longest last piece wins."""
        n = len(text)
        score = [0.0] + [float("-inf")] * n
        back = [(0, -1)] * (n + 1)
        least, done = self._least, 0
        for last, (length, gain, piece) in self._automaton.iter(text):
            end = last + 1
            while done < end - 1:  # positions where no piece ends are reached by an unknown character
                done += 1
                if score[done - 1] + least > score[done]:
                    score[done], back[done] = score[done - 1] + least, (1, -1)
            if score[end - length] + gain > score[end]:
                score[end], back[end] = score[end - length] + gain, (length, piece)
            if score[end - 1] + least > score[end]:
                score[end], back[end] = score[end - 1] + least, (1, -1)
        while done < n:
            done += 1
            if score[done - 1] + least > score[done]:
                score[done], back[done] = score[done - 1] + least, (1, -1)
        out: list[int] = []
        while n:
            length, piece = back[n]
            if piece >= 0:
                out.append(piece)
            elif self._bytes:
                out += [self._bytes[b] for b in reversed(text[n - length : n].encode("utf-8", "replace"))]
            else:
                out.append(self.unknown)
            n -= length
        return out[::-1]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.best(w.replace("\x00", SPACE)) for w in words]
        return np.array([i for f in found for i in f], np.uint32), np.array([len(f) for f in found], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit numbers."""
        spelled = [self.normalized(t) for t in texts]
        if not self.by_word:
            return [np.array(self.best(s), np.uint32) for s in spelled]
        data = [s.replace(SPACE, "\x00").encode() if "\x00" not in s else None for s in spelled]
        joined = b"".join(d or b"" for d in data)
        bounds = np.cumsum([0, *(len(d or b"") for d in data)])
        raw = np.frombuffer(joined, np.uint8)
        mark = raw == 0
        start = mark & ~np.insert(mark[:-1], 0, False) if len(raw) else mark
        start[bounds[:-1][bounds[:-1] < len(raw)]] = True
        begin = np.flatnonzero(start)
        found = self._of_ranges(joined, begin, np.append(begin[1:], len(raw)), bounds) if len(raw) else [
            np.empty(0, np.uint32) for _ in texts
        ]
        return [f if d is not None else np.array(self.best(s), np.uint32) for f, d, s in zip(found, data, spelled)]

    def decode(self, ids) -> str:
        """The text of ids: pieces and bytes in turn, control ids left out."""
        out = bytearray()
        for i in ids:
            if i in self._byte_of:
                out.append(self._byte_of[i])
            elif i not in self._control:
                out += self.pieces[i].encode()
        text = out.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _release() -> None:
    _MODELS.clear()
    hashing.release()


def model(path: str) -> PieceModel:
    holding("pieces", _release)
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def with_pieces(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, score, decoded): best piece ids of each row, their summed score, their text.

    Null texts count as empty and have no ids; repeated rows give repeated rows; other columns
    are ignored.
    """
    out = pa.schema([
        ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("score", pa.float64()), ("decoded", pa.string()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in by_size(batches, 1):
            found = m.encode(texts(b.column(1)))
            yield batch(
                out, b.column(0), [i.astype(np.int32) for i in found], [float(m.scores[i].sum()) for i in found],
                [m.decode(i.tolist()) for i in found],
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id long, ids array<int>, score double, decoded string"
    )


def checked(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, score, decoded_sha256) from the ids and text of ``with_pieces``."""
    out = pa.schema([
        ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("score", pa.float64()),
        ("decoded_sha256", pa.string()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in by_size(batches, 1):
            found = m.encode(texts(b.column(1)))
            yield batch(
                out, b.column(0), [len(i) for i in found], [zlib.crc32(i.astype("<u4").tobytes()) for i in found],
                [float(m.scores[i].sum()) for i in found],
                [hashlib.sha256(m.decode(i.tolist()).encode("utf-8", "replace")).hexdigest() for i in found],
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id long, n_tokens long, ids_crc32 long, score double, decoded_sha256 string"
    )
