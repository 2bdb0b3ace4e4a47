"""Exact token ids of the public byte-level BPE, by way of a cache of space-led chunks."""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

#: Special token of the vocabulary, read as one id wherever it stands in a text.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: A blank with white space on both sides, or at the very end after white space: the pattern joins such runs.
_JOINED = re.compile(r"\s \s|\s \Z")
_CACHE = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Chunks(dict):
    """chunk -> little-endian unsigned 32-bit ids of " " + chunk; emptied when it is full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= _CACHE:
            self.clear()
        out = array("I", self.encode(" " + chunk)).tobytes()
        if len(chunk) < 64:
            self[chunk] = out
        return out


class Encoder:
    """Whole texts to ids. The pattern never lets a piece run from a non-blank into a blank, so a text can
    be cut before each blank and the chunks encoded alone; only blanks inside longer white space must stay together."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.chunks = _Chunks(self.plain)

    def _part(self, text: str) -> bytes:
        if not text:
            return b""
        if _JOINED.search(text):
            return array("I", self.plain(text)).tobytes()
        first, *rest = text.split(" ")
        head = array("I", self.plain(first)).tobytes() if first else b""
        return head + b"".join(map(self.chunks.__getitem__, rest))

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit values; none for a null or empty text."""
        if not text:
            return b""
        if SPECIAL not in text:
            return self._part(text)
        return array("I", [SPECIAL_ID]).tobytes().join(map(self._part, text.split(SPECIAL)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)
