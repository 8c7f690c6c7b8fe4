"""The encoder of token ids against the tokenizers library on texts of blanks, marks and special tokens."""

import random

import numpy as np
import pytest

pytest.importorskip("intervalia.llm")

from intervalia.llm import queries, token_ids  # noqa: E402

BITS = ["foo", "Bar", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "é", "ñandú", "1", "1999", "'s", "don't", "...", ",", "!?", "<|endoftext|>", "\x85", "\xa0", "　", "\x1c", "a", "漢", "😀", "​", "-", "_", "\r\n", "\x00", "x" * 30, ".\nThe", "word.\nWord,"]


def test_same_as_the_library(monkeypatch):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    r = random.Random(1)
    texts = ["", " ", "\n", *BITS, *["".join(r.choice(BITS) for _ in range(r.randint(0, 25))) for _ in range(6000)]]
    coder = token_ids.Encoder(path)
    want = [np.asarray(e.ids, "<u4").tobytes() for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert coder.plain
    # with a memory that is dropped again and again, and with one that is not
    for remembered in (50, token_ids.REMEMBERED):
        monkeypatch.setattr(token_ids, "REMEMBERED", remembered)
        coder = token_ids.Encoder(path)
        for _ in range(2):
            assert [x for k in range(0, len(texts), 64) for x in coder.encode(texts[k : k + 64])] == want
