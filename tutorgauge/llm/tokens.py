"""Token ids of whole texts by a public tokenizer file, with a bounded memory of words already encoded."""

from __future__ import annotations

import re
import sys
import types
from array import array
from itertools import accumulate

import numpy as np
from tokenizers import Tokenizer

KNOWN = 1_000_000  # words, and stretches, a worker remembers
# The word pattern of byte-level BPE files, for the plain characters below.
_LETTERS, _DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+"
# Characters on whose class every Unicode version agrees: Latin letters, ASCII, general punctuation.
_PLAIN = r"[\t\n\r -~¡-ɏ‐-‧‰-⁞€]*"


def worker_encoder(path: str, spans: bool = False) -> WordEncoder:
    """The encoder this Python worker keeps from task to task: functions travel by value, but a module of its own stays."""
    held = sys.modules.setdefault("_tutorgauge_tokens", types.ModuleType("_tutorgauge_tokens")).__dict__
    if held.get("made_for") != (path, spans):
        held.update(made_for=(path, spans), encoder=WordEncoder(path, spans))
    return held["encoder"]


class Stretches(dict):
    """Packed tokens of stretches by their text; one not met before is encoded. White space beside white space is no stretch."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, stretch: str) -> bytes:
        if stretch in ("", "\x01"):
            raise KeyError(stretch)
        if len(self) >= KNOWN:
            self.clear()
        found = self[stretch] = self.encode("\n" + stretch[1:] if stretch[0] == "\x01" else " " + stretch)
        return found


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level files: printable Latin-1 as it is, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordEncoder:
    """Encodes texts as the tokenizer file does, special-token strings in a text being ordinary text.

    Byte-level BPE never merges across the words of its pattern, so a word has the same ids wherever it stands and is
    encoded once; a stretch from one space or line break to the next is looked up as one. Texts with characters outside
    the plain set are encoded whole, as is a file of another kind. With ``spans`` the places of tokens are kept
    instead of their ids.
    """

    def __init__(self, path: str, spans: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spans, self.words, self.stretches = spans, {}, Stretches(self._by_words)
        self.find = re.compile(PATTERN).findall
        self.plain = re.compile(_PLAIN).fullmatch
        self.letters = byte_letters()
        kind = str(self.tokenizer.pre_tokenizer)
        self.by_word = self.tokenizer.normalizer is None and kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind

    def _whole(self, text: str) -> bytes:
        encoding = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(encoding.offsets if self.spans else encoding.ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if self.spans and not word.isascii():
                found = self._whole(word)
            else:
                tokens = self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
                if self.spans:
                    ends = list(accumulate(len(t.value) for t in tokens))
                    found = array("I", [x for span in zip([0, *ends], ends) for x in span]).tobytes()
                else:
                    found = array("I", [t.id for t in tokens]).tobytes()
            if len(self.words) >= KNOWN:
                self.words.clear()
            self.words[word] = found
        return found

    def _joined(self, parts: list[bytes], lengths: list[int]) -> bytes:
        """Ids one after the other, or spans moved to where their part starts."""
        packed = b"".join(parts)
        if not self.spans:
            return packed
        ends = np.cumsum(np.array(lengths, np.int64))
        moves = np.repeat(ends - lengths, np.fromiter(map(len, parts), np.int64, len(parts)) // 4)
        return (np.frombuffer(packed, "<u4") + moves).astype("<u4").tobytes()

    def _by_words(self, text: str) -> bytes:
        words = self.find(text)
        if len(words) == 1:
            return self._word(words[0])
        parts = list(map(self._word, words))
        if not self.spans or len(words) > 8:
            return self._joined(parts, list(map(len, words)) if self.spans else [])
        at, places = 0, array("I")
        for word, part in zip(words, parts):
            places.extend([x + at for x in memoryview(part).cast("I")])
            at += len(word)
        return places.tobytes()

    def _packed(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_word or not self.plain(text):
            return self._whole(text)
        # a mark tells a stretch that follows a line break from one that follows a space
        first, *rest = text.replace("\n", " \x01").split(" ")
        if not first or "\t" in text or "\r" in text:
            return self._by_words(text)
        try:
            parts = list(map(self.stretches.__getitem__, rest))
        except KeyError:  # white space next to white space is read together
            return self._by_words(text)
        lengths = [len(first), *(len(x) + (x[0] != "\x01") for x in rest)] if self.spans else []
        return self._joined([self._by_words(first), *parts], lengths)

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return self._packed(text)

    def offsets(self, text: str) -> np.ndarray:
        """Start and end of every token, in characters of the text."""
        return np.frombuffer(self._packed(text), "<u4").reshape(-1, 2).astype(np.int64)
