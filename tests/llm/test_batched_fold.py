"""Words folded together get the ids that each gets alone."""

import random

import numpy as np

from rankloom.llm import byte_bpe

NAME = "byte_bpe_multi_50k.tiktoken"


def test_words_folded_together_equal_words_folded_alone():
    ranks = byte_bpe.read_ranks(byte_bpe.public_tokenizers().path(NAME))
    draw = random.Random(5)
    words = ["a", " ", "aaaa", "aaaaaaa", "abababab", "\U0001f600\U0001f600", "the", " und", "x" * 64]
    words += ["".join(draw.choice("abcdeint é世界ß0") for _ in range(draw.randint(1, 40))) for _ in range(3000)]
    got = byte_bpe.Fold(ranks).words([w.encode() for w in words])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [byte_bpe.folded(w.encode(), ranks) for w in words]


def test_texts_of_a_slice_equal_single_texts():
    texts = ["", "one two  three\n\n four's", "y" * 500, "\x00́ zażółć gęślą jaźń " * 3, "one two"]
    got = byte_bpe.encode_texts(texts, byte_bpe.TOKENIZERS, NAME)
    assert [x.tolist() for x in got] == [byte_bpe.encode_text(t, byte_bpe.TOKENIZERS, NAME).tolist() for t in texts]
    assert [byte_bpe.decode_ids(x, byte_bpe.TOKENIZERS, NAME).decode() for x in got] == texts


def test_a_full_memo_starts_anew(monkeypatch):
    texts = ["alpha beta gamma delta", "epsilon zeta eta theta"]
    want = [byte_bpe.encode_text(t, byte_bpe.TOKENIZERS, NAME).tolist() for t in texts]
    monkeypatch.setattr(byte_bpe, "MEMO_WORDS", 2)
    assert [x.tolist() for x in byte_bpe.encode_texts(texts, byte_bpe.TOKENIZERS, NAME)] == want
