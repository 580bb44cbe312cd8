"""Token ids of whole texts by the public word-level BPE vocabulary, one white-space word at a time.

The vocabulary's pre-tokeniser never joins characters across white space and its normaliser works within
words, so a text's ids are its words' ids in order. Words repeat; each is encoded once per worker and kept
in a bounded cache. Texts for which Python's and the tokeniser's idea of white space differ, or that hold
a special token's string, are encoded whole. tests/llm compares both ways.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

from quarry.llm.common import tokenizer_path

#: Characters that only one side takes as white space, and the opening of special strings.
ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]|<\\|")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


LETTER_OF = byte_letters()
#: Letters whose lower case depends on their neighbours or is more than one letter.
SPECIAL = re.compile("[\u0130\u03a3]")


class WordTokens:
    def __init__(self, name: str = "word_bpe_49k.json", cache_words: int = 1_500_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.cache: dict[str, bytes] = {}  # words met lately
        self.older: dict[str, bytes] = {}  # the generation before
        self.cache_words = cache_words

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, w: str) -> bytes:
        """Ids of one white-space word. Letters alone are one pre-token and go straight to the merges."""
        if w.isalpha() and not SPECIAL.search(w):
            if w.isascii():
                w = w.lower()
            else:
                w = "".join([LETTER_OF[b] for b in unicodedata.normalize("NFC", w).lower().encode()])
            return array("I", [t.id for t in self.model.tokenize(w)]).tobytes()
        return self.whole(w)

    def _part(self, w: str) -> bytes:
        found = self.cache.get(w)
        if found is None:
            found = self.cache[w] = self.older.get(w) or self.word(w)
        return found

    def _learn(self, words: set[str]) -> None:
        cache, older = self.cache, self.older
        for w in words:
            found = older.get(w)
            if found is None:
                stem = w[:-1]
                found = self._part(stem) + self._part(w[-1]) if w[-1] in ".," and stem.isalpha() else self.word(w)
            cache[w] = found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if ODD.search(text):
            return self.whole(text)
        if text.isascii():
            text = text.lower()
        words = text.split()
        ids = list(map(self.cache.get, words))
        if None in ids:
            if len(words) > self.cache_words:
                return self.whole(text)
            new = {w for w, x in zip(words, ids, strict=True) if x is None}
            if len(self.cache) + len(new) > self.cache_words:
                # words that are met again come back from the older generation
                self.older, self.cache = self.cache, {}
                new = set(words)
            self._learn(new)
            ids = [self.cache[w] for w in words]
        return b"".join(ids)


_loaded: dict[tuple[str, int], WordTokens] = {}


def tokens(name: str = "word_bpe_49k.json", cache_words: int = 1_500_000) -> WordTokens:
    """The worker's own instance. About 200 bytes a cached word, in two generations at most."""
    if (name, cache_words) not in _loaded:
        _loaded[name, cache_words] = WordTokens(name, cache_words)
    return _loaded[name, cache_words]
