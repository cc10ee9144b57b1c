"""URL rules judged by a bit-parallel wildcard automaton.

Every rule becomes a run of bits, one per position of its glob; all rules lie side by side in
64-bit words.  A character moves every rule at once: states shift to the next position where
its mask allows the character, and stay where a wildcard allows it (Shift-And).  A task reads
a batch of addresses in step, one character of each at a time, and lets go of an address once
no rule is alive in it, which for most is after the host.

The rules are an argument, not a table: their masks go to the tasks and are at most
``MASK_BYTES`` in all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK_BYTES = 64 << 20
_ONE = np.uint64(1)
_END = 0x110000  # no code point: stands between host and path
_FEW = 16  # addresses that are read one by one once so few are left
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """A host and the beginning of a path, with ``*`` for any run, ``?`` for any code point and
    ``\\`` before one that stands for itself.  In the host a wildcard does not pass a ``/``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path; both empty without ``://`` and for null."""
    after = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    after = F.coalesce(after, F.lit(""))
    return F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def _positions(rule: Rule) -> list[list]:
    """[code point, None for any; may stay here] per position after the first."""
    out = [[ord("."), False]]
    for text, host in ((rule.host, True), (rule.path, False)):
        escaped = False
        for char in text:
            if escaped or char not in "*?\\":
                out.append([ord(char), False])
                escaped = False
            elif char == "\\":
                escaped = True
            elif char == "?":
                out.append([None, False])
            else:
                out[-1][1] = True
        if host:
            out.append([_END, False])
    return out


class Automaton:
    """The packed masks of all rules, and the rule that each accepting bit stands for.

    Rules are laid out longest first, so that the lowest accepting bit of an address is its
    longest rule; of equal lengths the first given comes first.
    """

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
        laid = [_positions(rules[i]) for i in self.order]
        literals = {c for positions in laid for c, _ in positions if c is not None} | {_END}
        self.letters = np.array(sorted(literals), np.uint32)
        bits = sum(len(p) + 1 for p in laid)
        self.words = max(1, -(-bits // 64))
        if 2 * (len(self.letters) + 1) * self.words * 8 > MASK_BYTES:
            raise ValueError(f"the rules' masks take more than {MASK_BYTES} bytes")
        # a row per letter, and a last one for every other code point
        move = np.zeros((len(self.letters) + 1, self.words * 64), bool)
        stay = np.zeros_like(move)
        start, accept = np.zeros(self.words * 64, bool), np.zeros(self.words * 64, bool)
        self.rule_of = np.full(self.words * 64, -1, np.int32)
        host_only = np.arange(len(move)) != len(self.letters) - 1
        at = 0
        for rule, positions in zip(self.order, laid):
            start[at] = True
            stay[host_only, at] = True  # labels before the rule's host
            for char, stays in positions:
                at += 1
                if char is None:
                    move[:, at] = host_only
                else:
                    move[np.searchsorted(self.letters, char), at] = True
                if stays:
                    stay[:, at] = host_only
            accept[at] = True
            self.rule_of[at] = rule
            at += 1
        self.move, self.stay = _packed(move), _packed(stay)
        self.start, self.accept = _packed(start[None])[0], _packed(accept[None])[0]

    def classes(self, points: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.letters, points)
        known = self.letters[np.minimum(at, len(self.letters) - 1)] == points
        return np.where(known, at, len(self.letters)).astype(np.int64)

    def longest(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """The place of each address's longest rule, -1 for none."""
        # a dot ahead of the host stands for the end of the label before it
        ends = np.fromiter((len(h) + 1 for h in hosts), np.int64, len(hosts))
        lengths = ends + 1 + np.fromiter(map(len, paths), np.int64, len(paths))
        text = "".join([f".{h}\0{p}" for h, p in zip(hosts, paths)])
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
        offsets = np.cumsum(lengths) - lengths
        points[offsets + ends] = _END
        classes = self.classes(points)
        hits = np.zeros((len(hosts), self.words), np.uint64)
        alive, state = np.arange(len(hosts)), np.tile(self.start, (len(hosts), 1))
        step = 0
        while len(alive) > _FEW:
            seen = classes[offsets[alive] + step]
            moved = state << _ONE
            moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
            state = (moved & self.move[seen]) | (state & self.stay[seen])
            hits[alive] |= state & self.accept
            step += 1
            # a rule that has hit needs no further character
            left = (state & ~self.accept).any(axis=1) & (lengths[alive] > step)
            alive, state = alive[left], state[left]
        for i, own in zip(alive.tolist(), state):
            hits[i] |= self._rest(own, classes[offsets[i] + step : offsets[i] + lengths[i]].tolist())
        found = hits != 0
        word = found.argmax(axis=1)
        value = hits[np.arange(len(hits)), word]
        lowest = np.log2((value & (~value + _ONE)).astype(np.float64), where=value != 0, out=np.zeros(len(value)))
        return np.where(found.any(axis=1), self.rule_of[word * 64 + lowest.astype(np.int64)], -1)

    def _rest(self, state: np.ndarray, classes: list[int]) -> np.ndarray:
        """The accepting bits met on the rest of one address, all words as one integer."""
        whole = lambda words: int.from_bytes(words.tobytes(), "little")
        move, stay = [whole(m) for m in self.move], [whole(m) for m in self.stay]
        accept, now, hit = whole(self.accept), whole(state), 0
        for c in classes:
            now = ((now << 1) & move[c]) | (now & stay[c])
            hit |= now & accept
            now &= ~accept
            if not now:
                break
        return np.frombuffer(hit.to_bytes(self.words * 8, "little"), np.uint64)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def judged(
    pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url", held_chars: int = 1 << 22
) -> DataFrame:
    """``pages`` with host, path, rule and verdict of every row's address.

    A rule fits its host and all hosts below it if the path starts with the rule's path; the
    longest rule counts, of equal lengths the first given.  ``rule`` is its host and path as
    given, null if none fits, and then the verdict is ``default``.

    Null addresses and those without ``://`` have an empty host and path, which an ordinary
    rule never fits.  Every row is judged by itself: repeated rows stay, an empty table stays
    empty, an address may have any length.  Columns of ``pages`` named host, path, rule or
    verdict are replaced; all others are returned as they are.
    """
    rules = [Rule(*r) for r in rules]
    automaton = Automaton(rules)

    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hosts, paths in batches:
            hosts, paths = hosts.to_pylist(), paths.to_pylist()
            out, at, size = [], 0, 0
            for i, (host, path) in enumerate(zip(hosts, paths), 1):
                size += len(host) + len(path)
                if max(size, (i - at) * automaton.words) > held_chars or i == len(hosts):
                    out.append(automaton.longest(hosts[at:i], paths[at:i]))
                    at, size = i, 0
            rules_found = np.concatenate(out) if out else np.empty(0, np.int32)
            yield pa.array(rules_found, pa.int32(), mask=rules_found < 0)

    place = F.arrow_udf(find, "int")
    host, path = host_and_path(F.col(url))
    taken = {"host", "path", "rule", "verdict"}
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in taken]
    names = F.array(*[F.lit(r.name) for r in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array().cast("array<string>")
    parts = pages.select(*kept, host.alias("host"), path.alias("path"))
    placed = parts.withColumn("rule", place("host", "path"))
    return placed.select(
        *kept, "host", "path", F.get(names, F.col("rule")).alias("rule"),
        F.coalesce(F.get(verdicts, F.col("rule")), F.lit(default)).alias("verdict"),
    )
