"""The memo of pieces against the library itself."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from trackweave.llm import tokens as T

PARTS = ["a", "b", " ", " ", " ", "\n", "é", "1", "'s", "'", "ß", "汉", "😀", ".", ",", "...", "%%%", "_", "ª", "µ", "z.", "é!", "×,", "don't", "x y", "<|endoftext|>", "\x01", "\xa0", "​", " ", "　", "\t", "\x00", "﻿", "İ", "sevenbytes", "wort" * 6, "w" * 23]


@pytest.mark.parametrize("memo, window", [(0, 40), (50, 1 << 20), (400_000, 300)])
def test_encoder_equals_the_library(monkeypatch, memo, window):
    monkeypatch.setattr(T, "MEMO", memo)
    monkeypatch.setattr(T, "WINDOW", window)
    monkeypatch.setattr(T, "WORD", 60)
    monkeypatch.setattr(T, "PART", 40)
    enc, rng = T.Encoder(T.vocabulary_path()), random.Random(memo)
    fresh = Tokenizer.from_file(T.vocabulary_path())
    for k in range(400):
        texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 90 if k % 4 == 0 else 9))) for _ in range(rng.randint(1, 6))]
        ids, counts = enc.encode(texts)
        got = np.split(ids, np.cumsum(counts)[:-1])
        want = [e.ids for e in fresh.encode_batch(texts, add_special_tokens=False)]
        assert [g.tolist() for g in got] == want
        ids, counts = enc.encode(pa.array([None, *texts, ""]).slice(0, len(texts) + 1), 70000 if k % 2 else 0)
        assert T.id_lists(ids, counts).to_pylist() == [np.array([*w, 70000 if k % 2 else 0], ids.dtype).tobytes() for w in [[], *want]]
        assert memo > 50 or len(enc.memo) < 500


def test_plain_long_texts_by_windows(monkeypatch):
    monkeypatch.setattr(T, "WINDOW", 64)
    enc, fresh, rng = T.Encoder(T.vocabulary_path()), Tokenizer.from_file(T.vocabulary_path()), random.Random(5)
    for _ in range(60):
        words = ["".join(rng.choices("abcé,.1", k=rng.randint(1, 30))) for _ in range(rng.randint(1, 200))]
        text = "".join(w + rng.choice(" \n") for w in words)
        assert not enc._odd(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])).any()
        assert enc.encode([text])[0].tolist() == fresh.encode(text, add_special_tokens=False).ids


def test_memo_keeps_what_comes_again():
    memo = T.Memo(np.uint16)
    keys = np.arange(1, 3001, dtype=np.uint64)[:, None] * np.array([1, 0, 7], np.uint64)
    memo.add(keys, np.arange(3000, dtype=np.uint16), np.ones(3000, np.int64))
    assert (memo.find(keys) == np.arange(3000)).all() and (memo.find(keys + np.uint64(5000)) == -1).all()
    memo.hit[:10] = True
    memo.trim(2999)
    assert len(memo) == 10 and (memo.find(keys[:10]) >= 0).all() and (memo.find(keys[10:]) == -1).all()
    assert memo.bank[memo.at[memo.find(keys[7:8])]].tolist() == [7]


def test_added_tokens_as_by_default():
    fresh, enc = Tokenizer.from_file(T.vocabulary_path()), T.Encoder(T.vocabulary_path())
    texts = ["foo <|endoftext|> bar", "<|endoftext|>", "a<|endoftext|>b\nc", "plain words", "<|endoftext|><|endoftext|>, x", "< |endoftext|>"]
    ids, counts = enc.encode(texts)
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert [g.tolist() for g in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert want[0] == [21943, 220, 50256, 2318]
