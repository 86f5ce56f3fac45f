"""Token ids of whole texts by the tokenizers library."""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core per task

#: Words kept per Python worker; beyond it the half that came first stays, which holds the frequent ones.
CACHE_WORDS = 400_000


class _Known(dict):
    """Asks for a value once, when it is first looked up."""

    def __init__(self, ask: Callable[[bytes], bytes]):
        super().__init__()
        self.ask = ask

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = self.ask(word)
        return found

    def forget(self, keep: int) -> None:
        """Only the ``keep`` entries that came first stay."""
        first = list(islice(self.items(), keep))
        self.clear()
        self.update(first)


class TextEncoder:
    """Encodes whole texts into little-endian unsigned 32-bit ids.

    Where the tokenizer splits at white space and drops it, a text's ids are
    those of its white-space separated parts in order: no pattern, normal form or
    special string spans white space. Such parts repeat a lot, so the library
    encodes each new part once and a bounded table keeps the ids. A part of
    plain letters goes to the library's BPE model at once, without the steps that
    would not change it, and the punctuation behind it is looked up by itself.
    Other tokenizers get whole texts. Special strings inside a text are handled
    as the library does by default. Null is the empty text and has no ids.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_part = _drops_white_space(spec)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.cache_words = cache_words
        self.known = _Known(self._part)

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text as bytes, four per id."""
        if not self.by_part:
            return self._encode_whole([t or "" for t in texts])
        # lower case comes anyway, and must not turn a text into a special string
        out = []
        for text in texts:
            out.append(b"".join(map(self.known.__getitem__, _parts(text or ""))))
            if len(self.known) > self.cache_words:
                self.known.forget(self.cache_words // 2)
        return out

    def _part(self, word: bytes) -> bytes:
        core = word.rstrip(b".,;:!?")
        if not core or not _PLAIN.fullmatch(core):
            return self._encode_whole([word.decode("utf-8", "surrogatepass")])[0]
        if len(core) == len(word):
            return self._letters(core)
        return self.known[core] + self.known[word[len(core) :]]

    def _letters(self, word: bytes) -> bytes:
        tokens = self.model.tokenize(word.decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def _encode_whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]


#: lower-case letters of ASCII and Latin-1 in UTF-8: no normal form or lower casing changes them
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _parts(text: str) -> list[bytes]:
    """The parts between ASCII white space, with A-Z in lower case unless the text may hold a special string."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw.split() if b"<|" in raw else raw.lower().split()


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


#: fixed values: the steps of a tokenizer that never looks across white space
_SQUEEZE = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _drops_white_space(spec: dict) -> bool:
    """Whether the ids of a text are those of its parts between white space."""
    pre = spec.get("pre_tokenizer") or {}
    first = pre["pretokenizers"][0] if pre.get("type") == "Sequence" else pre
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    added = spec.get("added_tokens", [])
    return (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and first.get("pattern", {}).get("Regex") == _WORDS
        and all(s["type"] in ("NFC", "Lowercase") or s == _SQUEEZE for s in steps)
        and not any(c.isspace() for t in added for c in t["content"])
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
    )


@lru_cache(maxsize=4)
def encoder(path: str, cache_words: int = CACHE_WORDS) -> TextEncoder:
    """One encoder per file and Python worker."""
    return TextEncoder(path, cache_words)


def word_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def byte_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")
