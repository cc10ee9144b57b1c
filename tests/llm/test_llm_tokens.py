"""Token ids, packing, token files and piece search."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from concordat.llm import packing, token_files, tokens
from concordat.llm.queries import tokenizer
from concordat.llm.sentencepiece_search import model, with_pieces
from concordat.llm.tokens import encoded

PATH = tokenizer("word_bpe_49k.json")
TEXTS = [
    "", "  \n", "Hello, World.", "It's a.b c, d. ...", "İstanbul DON'T x<|endoftext|>y", "<|ENDOFTEXT|>", "a\x1cb\x85c\xa0d",
    "12 ab34.,", "É é ﬁ ² K ñandú", "日本語 text 😀!", "word " * 400, "z" * 3000, None,
]


def reference_ids(texts):
    found = Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [[*e.ids, 1] for e in found]


@pytest.mark.parametrize("chars", [40, 1 << 20])
def test_ids_are_the_library_s(chars):
    texts = [t or "" for t in TEXTS] * 2
    assert [x.tolist() for x in encoded(texts, PATH, 1, chars)] == reference_ids(texts)


def test_ids_around_marks_are_the_library_s():
    rng = random.Random(5)
    kinds = ["aszétßxreldmvÉÀ×÷ÿ", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", "'", "0129²½ \n\x1c\x85\xa0\u0338\u0301\u20e3日가İıſÅﬁ…–😀\x00\x7fΣ"]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    assert [x.tolist() for x in encoded(texts, PATH, 1)] == reference_ids(texts)


def asked_of(encoder, monkeypatch):
    """The words that the encoder asks the library for from now on."""
    asked, words = [], encoder._words
    monkeypatch.setattr(encoder, "_words", lambda w: asked.extend(w) or words(w))
    return asked


def test_a_word_is_asked_for_once_whatever_marks_follow(monkeypatch):
    encoder = tokens.Encoder(PATH)
    asked = asked_of(encoder, monkeypatch)
    encoder.encode(["café café, (café) café.&&& café... straße-café x/y é's"])
    assert sorted(asked) == sorted(["café", ",", "(", ")", ".&&&", "...", "straße", "-", "x", "/", "y", "é's"])


def test_words_that_come_again_stay_known(monkeypatch):
    monkeypatch.setattr(tokens, "_WORDS", 100)
    encoder = tokens.Encoder(PATH)
    asked = asked_of(encoder, monkeypatch)
    texts = ["often usual " + " ".join("w" + chr(97 + i) + chr(97 + j) + chr(97 + k) for j in range(6) for k in range(6)) for i in range(26)]
    for text in texts:
        assert [*encoder.encode([text])[0].tolist(), 1] == reference_ids([text])[0]
        assert len(encoder._keys) <= 100 + 38
    assert asked.count("often") == asked.count("usual") == 1


def test_many_words_that_come_again_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "_WORDS", 100)
    encoder = tokens.Encoder(PATH)
    text = " ".join("w" + chr(97 + i) + chr(97 + j) for i in range(26) for j in range(8))
    for _ in range(4):
        assert [*encoder.encode([text])[0].tolist(), 1] == reference_ids([text])[0]
        assert len(encoder._keys) <= 208


def test_patterns_hold_every_piece():
    rng = random.Random(3)
    for counts in ({}, {7: 1}, {2048: 3}, {1: 5000}, {rng.randrange(1, 2049): rng.randrange(1, 400) for _ in range(300)}):
        patterns = packing.pack_histogram(dict(counts), 2048)
        held = {}
        for times, pattern in patterns:
            assert sum(n * k for n, k in pattern) <= 2048
            for n, k in pattern:
                held[n] = held.get(n, 0) + times * k
        assert held == counts


@pytest.mark.parametrize("size", [16, 2048])
def test_packing(spark, corpus, size):
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)] + [(None, "no id"), (5, TEXTS[5])]
    got = packing.pack(corpus(*rows, extra=["start", "slice"]), PATH, size).collect()
    ids = {i: x for (i, _), x in zip(rows, reference_ids([t for _, t in rows]))}
    copies = {i: sum(j == i for j, _ in rows) for i, _ in rows}
    covered = {}
    for r in got:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
    assert covered == {i: copies[i] * len(x) for i, x in ids.items()}
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert set(filled) == set(range(len(filled))) and max(filled.values()) <= size
    assert packing.pack(corpus(), PATH, size).count() == 0


@pytest.mark.parametrize("limit", [10, 16])
def test_codes_are_limited_and_decode(limit):
    rng = np.random.default_rng(4)
    counts = np.where(rng.random(900) < 0.8, (1.5 ** rng.integers(0, 40, 900)).astype(np.int64), 0)
    lengths = token_files.code_lengths(counts, limit)
    assert lengths.max() <= limit and (lengths[counts > 0] > 0).all()
    assert np.isclose((0.5 ** lengths[lengths > 0].astype(float)).sum(), 1)
    codes, table = token_files.canonical_codes(lengths), token_files.decoding_table(lengths, limit)
    used = np.flatnonzero(counts)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = rng.choice(used, n).astype(np.uint32)
        marks, code = token_files.encode_block(ids, lengths, codes)
        assert (token_files.decode_block(code, marks, n, table, limit) == ids).all()


def test_one_symbol_and_lone_lengths():
    assert token_files.code_lengths(np.array([0, 0, 9]), 4).tolist() == [0, 0, 1]
    assert token_files.code_lengths(np.array([], np.int64), 4).tolist() == []
    # without the limit the rarest of these would take seven bits
    assert token_files.code_lengths(2 ** np.arange(8), 4).max() == 4


@pytest.mark.parametrize("options", [{}, {"block_tokens": 50, "file_bytes": 200, "limit": 4}])
def test_token_files(spark, corpus, options):
    rows = [(100 - i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "no id")]
    got = {r["doc_id"]: r for r in token_files.through_files(corpus(*rows, extra=["part", "nth"]), PATH, **options).collect()}
    assert len(got) == len(rows)
    at = 0
    for (i, _), ids in sorted(zip(rows, reference_ids([t for _, t in rows])), key=lambda x: (x[0][0] is not None, x[0][0] or 0)):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.through_files(corpus(), PATH).count() == 0


def test_ids_are_counted_as_they_are_written(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "drop", lambda *_: None)
    token_files.write_tokens(corpus(*enumerate(TEXTS), (None, "no id")), PATH, str(tmp_path))
    wanted = {}
    for ids in reference_ids([*TEXTS, "no id"]):
        for i in ids:
            wanted[i] = wanted.get(i, 0) + 1
    rows = spark.read.parquet(f"{tmp_path}/ids").where("nth IS NULL").collect()
    found = {}
    for r in rows:
        for i, n in r["counts"].items():
            found[i] = found.get(i, 0) + n
    assert found == wanted


def best_score(m, text):
    """The best sum of scores by plain dynamic programming over all pieces."""
    score = {p: s for p, s in zip(m.pieces, m.scores)}
    special = {i for i in range(len(m.pieces)) if m._library.is_byte(i) or m._library.is_control(i) or m._library.is_unknown(i)}
    plain = {p for i, p in enumerate(m.pieces) if i not in special}
    best = [0.0] + [float("-inf")] * len(text)
    for e in range(1, len(text) + 1):
        best[e] = best[e - 1] + m._least
        for s in range(max(0, e - 24), e):
            if text[s:e] in plain:
                best[e] = max(best[e], best[s] + score[text[s:e]])
    return best[-1]


def test_piece_search_finds_the_best_and_round_trips():
    m = model(tokenizer("piece_bpe_32k.model"))
    texts = [t for t in TEXTS if t and len(t) < 500] + ["a\x00b", " lead and trail ", "x\n\ny\t"]
    for text, ids in zip(texts, m.encode(texts)):
        assert m.decode(ids.tolist()) == text
        spelled = m.normalized(text)
        unknown = sum(c not in m.pieces for c in spelled)
        got = sum(m.scores[i] for i in ids if i not in m._byte_of) + unknown * m._least
        assert np.isclose(got, best_score(m, spelled))
        assert ids.tolist() == m.best(spelled)  # word by word or at once


def test_pieces_of_a_table(spark, corpus):
    got = with_pieces(corpus((1, "some text"), (2, None), (2, ""), (None, "x"), extra=["ids"]), tokenizer("piece_bpe_32k.model")).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in got) == [("1", "some text"), ("2", ""), ("2", ""), ("None", "x")]
