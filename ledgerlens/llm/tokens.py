"""Byte-level BPE ids of whole texts with the public 50k vocabulary.

The ids are those of the ``tokenizers`` file ``byte_bpe_50k.json`` (a test
compares them).  A single space or line feed between two other characters
always separates pre-tokens, so such texts are encoded word by word through a
bounded cache of words; any other text is encoded in one piece.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
CACHE_WORDS = 1_000_000
_UNEVEN = re.compile(r"\s\s|[^\S \n]")
_SPECIAL = "<|endoftext|>"


class _Words(dict):
    """Word -> its ids as little-endian uint32 bytes; emptied when full."""

    def __init__(self, encode: Callable[[str], bytes], lead: str):
        super().__init__()
        self._encode, self._lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = self._encode(self._lead + word)
        return found


def encoder(path: str | None = None) -> Callable[[str | None], bytes]:
    """A function text -> ids as little-endian uint32 bytes (null: empty).

    ``path`` names the vocabulary file (``tokenizers`` format); the ranks file
    of the same vocabulary stands beside it.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    ranks_file = path.removesuffix(".json") + ".tiktoken"
    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special: list[Tokenizer] = []

    def encode(text: str) -> bytes:
        found = plain.encode_ordinary(text)
        return struct.pack(f"<{len(found)}I", *found)

    spaced, bare = _Words(encode, " "), _Words(encode, "")
    newline = encode("\n")

    def ids(text: str | None) -> bytes:
        if not text:
            return b""
        if _SPECIAL in text:                     # the file's special token: its own id
            if not special:
                special.append(Tokenizer.from_file(path))
            found = special[0].encode(text, add_special_tokens=False).ids
            return b"".join(i.to_bytes(4, "little") for i in found)
        if _UNEVEN.search(text):
            return encode(text)
        parts: list[bytes] = []
        for n, line in enumerate(text.split("\n")):
            if n:
                parts.append(newline)
            first, *words = line.split(" ")
            if first:
                parts.append(bare[first])
            parts += map(spaced.__getitem__, words)
        return b"".join(parts)

    return ids
