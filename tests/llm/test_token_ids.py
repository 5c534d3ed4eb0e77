"""Ids of the packing operator against the tokenizer itself, over all characters it handles on its own."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sonaria.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DIRECT = Tokenizer.from_file(VOCABULARY)
OWN = packing.WordIds(VOCABULARY)


def same(text: str) -> bool:
    found = np.frombuffer(OWN.encode(text), dtype="<u4").tolist()
    return found == DIRECT.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("around", ["{}", "a{}b", "{0}{0}", " {} ", "1{}'s", "\n{}é", "!{}?"])
def test_every_character_below_0x180(around):
    wrong = [hex(c) for c in range(0x180) if not same(around.format(chr(c)))]
    assert not wrong


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x17F), max_size=30))
def test_texts_of_such_characters(text):
    assert same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_any_text(text):
    assert same(text)
