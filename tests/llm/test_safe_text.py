"""The fast path of the encoder, character by character, against the library."""

import numpy as np
import pytest

from filescope.llm import bpe, token_store

SAFE = [chr(i) for i in range(0x3000) if bpe.SAFE.fullmatch(chr(i))]


@pytest.mark.parametrize("path", [bpe.word_bpe(), token_store.byte_bpe()])
def test_every_safe_character(path):
    c = bpe.Codec(path)
    assert len(SAFE) > 300
    for ch in SAFE:
        for text in (ch, f"a{ch}b", f" {ch}", f"{ch}{ch}'s {ch}9{ch}", f"\n {ch}  {ch}"):
            assert c.ordinary(text) is not None
            assert c.encode(text) == np.array(c.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("text", [" ", "é", "²", "İ", "日", " ", "\x1c", "<|endoftext|>"])
def test_other_text_goes_to_the_library(text):
    assert bpe.Codec(bpe.word_bpe()).ordinary(f"a {text} b") is None
