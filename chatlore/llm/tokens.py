"""Token ids of whole texts from a word-end BPE vocabulary file (``tokenizers`` JSON).

The vocabulary drops white space and never joins across it, so a text's ids are the ids of its
space-separated chunks in order.  Chunks are looked up in a bounded memo; on a miss, plain chunks
(printable Latin-1) run through ``tiktoken``'s merge loop over the same vocabulary (word end = one
byte that UTF-8 lacks), everything else, special-token strings included, through ``tokenizers``.
The results are those of ``tokenizers`` (tested).
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np

VOCABULARY = "word_bpe_49k.json"
MEMO_CHUNKS = 120_000        # memo entries per worker; speed only
MEMO_CHARS = 40              # longer chunks aren't kept
PLAIN_CHARS = 400            # longer chunks go to ``tokenizers``
_END = b"\xff"
_PLAIN = re.compile(r"[\t\n\r!-~\xa1-\xac\xae-\xff]*")
# Fixed value: the vocabulary's split into pieces.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The visible letter that stands for each byte in byte-level vocabularies."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokens(dict):
    """Chunk -> its ids as little-endian 16-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = _byte_letters()
        ranks = {}
        for token, i in vocabulary.items():
            ends = token.endswith("</w>")
            body = bytes(letters[c] for c in (token[:-4] if ends else token))
            ranks[body + _END * ends] = i
        self._merge = tiktoken.Encoding("word-end", pat_str=r"\S+", mergeable_ranks=ranks,
                                        special_tokens={})._core_bpe.encode_single_piece
        self._pieces = regex.compile(_PIECES).findall

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) <= PLAIN_CHARS and _PLAIN.fullmatch(chunk):
            low = chunk.lower()
            if low.isascii() and low.isalpha():
                ids = self._merge(low.encode() + _END)
            else:
                ids = []
                for piece in self._pieces(low):
                    ids += self._merge(piece.encode() + _END)
        else:
            ids = self._whole.encode(chunk, add_special_tokens=False).ids
        found = array("H", ids).tobytes()
        if len(chunk) <= MEMO_CHARS and len(self) < MEMO_CHUNKS:
            self[chunk] = found
        return found

    def of(self, text: str | None) -> np.ndarray:
        """Ids of a whole text (none for null)."""
        if not text:
            return np.empty(0, np.uint16)
        if "<|" in text:  # may hold a special token's string, which can span chunks
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, np.uint16)
        return np.frombuffer(b"".join(map(self.__getitem__, text.split(" "))), np.uint16)


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    """One per worker process and vocabulary."""
    return Tokens(path)
