"""Token ids of whole texts by the tokenizers library, each distinct word encoded once.

Meant for word tokenizers that drop white space, never let a piece cross it and mark the last
piece of each word (``word_bpe_49k.json``): the ids of a text are those of its words in turn.
Words are cut at ASCII white space, and between a letter and an ASCII mark other than the
apostrophe, where such tokenizers always cut.  They are found and told apart by numpy for a batch
of texts at once; a worker keeps the ids of some ``_WORDS`` words, those that came again for
longer, and asks the library for the others in bulk.
Texts with the marks of special tokens go to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from concordat.llm import hashing
from concordat.llm.common import holding

_WORDS = 400_000
_SPECIAL = "<|"
# Words of one part: letters that stay single letters in lower case, or ASCII marks but the apostrophe.
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+")
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
# Second bytes of U+00C0 to U+00FF, without the signs of multiplication and division.
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[[39, *range(48, 58), *range(65, 91), *range(97, 123)]] = False
_ENCODERS: dict[str, Encoder] = {}


class WordCache:
    """Ids of the words met so far.  Words are byte ranges, told apart by a hash."""

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self._keys = np.empty(0, np.uint64)  # hashes of the words met, ascending
        self._place = np.empty(0, np.int32)  # where their ids begin is at this place of _start
        self._start = np.zeros(1, np.int64)
        self._ids = np.empty(0, np.uint32)
        self._again = np.empty(0, bool)  # by place: met more than once since the last _trim

    def _trim(self) -> None:
        """Forget the words that did not come again, and some of the others if these are too many."""
        kept = np.flatnonzero(self._again[self._place])[: _WORDS // 2]
        place = self._place[kept]
        begin, size = self._start[place], self._start[place + 1] - self._start[place]
        self._keys, self._ids = self._keys[kept], self._ids[_ranges(begin, size)]
        self._place = np.arange(len(kept), dtype=np.int32)
        self._start = np.concatenate([[0], np.cumsum(size)])
        self._again = np.zeros(len(kept), bool)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in turn and how many each has."""
        raise NotImplementedError

    def _of_ranges(self, joined: bytes, begin: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Ids of the words in ``joined[begin:end]``, cut into texts at ``bounds``."""
        if len(self._keys) > _WORDS:
            self._trim()
        base, raw = hashing.BASES[0], np.frombuffer(joined, np.uint8)
        key = hashing.of_ranges(hashing.prefix(raw.astype(np.uint64) + np.uint64(1), base), begin, end, base)
        distinct, first, inverse, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self._keys, distinct)
        known = np.zeros(len(distinct), bool)
        new = np.arange(len(distinct))
        if len(self._keys):
            near = np.minimum(at, len(self._keys) - 1)
            known = self._keys[near] == distinct
            new = np.flatnonzero(~known)
        place = np.empty(len(distinct), np.int64)
        place[known] = self._place[at[known]]
        self._again[place[known]] = True
        if len(new):
            words = [joined[a:b].decode() for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist())]
            ids, sizes = self._words(words)
            n = len(self._keys)
            place[new] = np.arange(n, n + len(new))
            self._keys = np.insert(self._keys, at[new], distinct[new])
            self._place = np.insert(self._place, at[new], place[new])
            self._start = np.concatenate([self._start, self._start[-1] + np.cumsum(sizes)])
            self._ids = np.concatenate([self._ids, ids])
            self._again = np.concatenate([self._again, times[new] > 1])
        word = place[inverse]
        size = self._start[word + 1] - self._start[word]
        ids = self._ids[_ranges(self._start[word], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(begin, bounds)]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]


class Encoder(WordCache):
    """Encodes texts with one tokenizer file; one per worker and file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        size = self._tokenizer.get_vocab_size()
        self._ends = np.array([(self._tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _words(self, words: list[str], together: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in turn and how many each has."""
        plain = np.array([bool(_PLAIN.fullmatch(w)) for w in words], bool)
        sizes = np.zeros(len(words), np.int64)
        ids: list[np.ndarray] = []
        order: list[np.ndarray] = []

        def alone(which: np.ndarray) -> None:
            for i, x in zip(which.tolist(), self._library([words[i] for i in which])):
                sizes[i] = len(x)
                ids.append(x)
                order.append(np.array([i]))

        # plain words have one part each, so the ends of parts cut a joint text up again
        which = np.flatnonzero(plain)
        groups = [which[at : at + together] for at in range(0, len(which), together)]
        for group, x in zip(groups, self._library([" ".join(words[i] for i in g) for g in groups])):
            ends = np.flatnonzero(self._ends[x])
            if len(ends) != len(group) or (len(x) and ends[-1] != len(x) - 1):
                alone(group)
                continue
            sizes[group] = np.diff(ends, prepend=-1)
            ids.append(x)
            order.append(group)
        alone(np.flatnonzero(~plain))
        if not ids:
            return np.empty(0, np.uint32), sizes
        flat, order_ = np.concatenate(ids), np.concatenate(order)
        begin = np.empty(len(words), np.int64)
        begin[order_] = np.cumsum(sizes[order_]) - sizes[order_]
        return flat[_ranges(begin, sizes)], sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit numbers."""
        special = [i for i, t in enumerate(texts) if _SPECIAL in t]
        data = [b"" if _SPECIAL in t else t.encode("utf-8", "replace").lower() for t in texts]
        joined = b"\n".join(data)
        raw = np.frombuffer(joined, np.uint8)
        out = self._encode(joined, raw, np.cumsum([0, *(len(d) + 1 for d in data)])) if len(raw) else [
            np.empty(0, np.uint32) for _ in texts
        ]
        for i, ids in zip(special, self._library([texts[i] for i in special]) if special else ()):
            out[i] = ids
        return out

    def _encode(self, joined: bytes, raw: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        space, mark, letter = _SPACE[raw], _MARK[raw], _LETTER[raw]
        wide = np.flatnonzero(raw[:-1] == 0xC3)
        wide = wide[_SECOND[raw[wide + 1]]]
        opens, closes = letter.copy(), letter  # first and last bytes of letters
        opens[wide], closes[wide + 1] = True, True
        start = ~space
        start[1:] &= space[:-1] | (closes[:-1] & mark[1:]) | (mark[:-1] & opens[1:])
        stop = ~space
        stop[:-1] &= space[1:] | start[1:]
        begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
        return self._of_ranges(joined, begin, end, bounds)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all ranges in turn."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + size, size)


def _release() -> None:
    _ENCODERS.clear()
    hashing.release()


def encoder(path: str) -> Encoder:
    holding("tokens", _release)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _cut(text: str, chars: int) -> list[str]:
    """The text in parts of about ``chars`` characters, cut at spaces."""
    parts, at = [], 0
    while len(text) - at > chars:
        end = text.find(" ", at + chars)
        if end < 0:
            break
        parts.append(text[at:end])
        at = end
    return [*parts, text[at:]]


def encoded(texts: list[str], path: str, end_id: int | None, chars: int = 1 << 20) -> list[np.ndarray]:
    """Ids of each text, then ``end_id`` if there is one.  Long texts are encoded part by part."""
    tail = np.array([] if end_id is None else [end_id], np.uint32)
    encode = encoder(path).encode
    if max(map(len, texts), default=0) <= chars:
        return [np.concatenate([ids, tail]) for ids in encode(texts)]
    return [np.concatenate([*(encode([p])[0] for p in _cut(t, chars)), tail]) for t in texts]


def by_size(batches: Iterator[pa.RecordBatch], text_at: int, chars: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``chars`` bytes of text; one row at least."""
    for b in batches:
        column = b.column(text_at)
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + chars, side="right")))
            yield b.slice(at, end - at)
            at = end
