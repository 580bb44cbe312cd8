"""Word-by-word ids equal the tokeniser's ids of the whole text."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm.common import tokenizer_path
from quarry.llm.wordtokens import WordTokens


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return WordTokens(cache_words=5_000), lambda s: np.array(t.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_documents(both):
    fast, slow = both
    for path in glob.glob("/root/testdata/sf0.01/documents.parquet"):
        for text in pq.read_table(path, columns=["text"])["text"].to_pylist()[:400]:
            assert fast.encode(text or "") == slow(text or "")


@pytest.mark.parametrize("text", ["", " ", "it's, we'll.", "Ärger été. ΣΑΣ. İstanbul", "a\x1cb\x85c d e", "<|endoftext|> x", "x" * 5000, "ab,c.d..", "日本語。 １２３ ²", "I'M 'S."])
def test_cases(both, text):
    assert both[0].encode(text) == both[1](text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text(both, text):
    assert both[0].encode(text) == both[1](text)
