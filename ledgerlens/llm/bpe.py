"""Byte-level BPE ids of many texts, with the merges of each distinct piece done once.

The pre-tokeniser's pieces do not depend on their neighbours once cut, so the ids
of a text are the ids of its pieces end to end.  Pieces are looked up in a
bounded dictionary; only new ones are merged.  Texts that hold a special token's
string go to the `tokenizers` library whole, which gives that token its own id.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import public_tokenizers

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CACHED_PIECES = 400_000

#: The pre-tokeniser's pattern for texts of code points below 256, where the
#: standard library's faster engine can say letters, digits and spaces by range.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = "\t-\r \u0085 "
NARROW = (f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
          f"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")


class Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, ranks_path: str, limit: int):
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.merge = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                       special_tokens={})._core_bpe.encode_single_piece
        self.limit = limit

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = self[piece] = np.array(self.merge(piece.encode()), dtype="<u4").tobytes()
        return ids


class Encoder:
    def __init__(self, vocabulary: str = VOCABULARY, ranks: str = RANKS, cached: int = CACHED_PIECES):
        import regex
        from tokenizers import Tokenizer
        self.pieces = Pieces(ranks, cached)
        self.whole = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.narrow, self.wide = re.compile(NARROW).findall, regex.compile(public_tokenizers.PATTERN).findall

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit bytes."""
        for token in self.special:
            if token in text:
                return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        try:
            text.encode("latin-1")
            cut = self.narrow(text)
        except UnicodeEncodeError:
            cut = self.wide(text)
        return b"".join(map(self.pieces.__getitem__, cut))
