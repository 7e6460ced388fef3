"""Public byte-level tokenizers, loaded once in each Python worker."""

from __future__ import annotations

import base64
from functools import lru_cache

import regex

#: Pieces whose ids a worker remembers; characters from which on a text is split here, as the library fails on white space of some hundred thousand.
REMEMBERED, LONG = 200_000, 100_000


def default_path() -> str:
    """The rank file of byte_bpe_50k; every caller takes another path as a parameter."""
    return "/opt/tokenizers/byte_bpe_50k.tiktoken"


#: Fixed value: the pattern that splits a text into the pieces within which the tokenizer merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Pieces:
    """Splits texts into pieces and encodes single pieces, remembering their ids."""

    def __init__(self, path: str):
        self.core, self.pattern, self.known = encoding(path)._core_bpe, regex.compile(PATTERN), {}
        self.ordinary = encoding(path).encode_ordinary

    def flat(self, text: str) -> list[int]:
        """Ids of a whole text."""
        if len(text) < LONG:
            return self.ordinary(text)
        return [i for piece in self.pattern.findall(text) for i in self.ids(piece)]

    def ids(self, piece: str) -> list[int]:
        found = self.known.get(piece)
        if found is None:
            found = self.core.encode_single_piece(piece.encode())
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = found
        return found


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)
