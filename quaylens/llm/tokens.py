"""Token ids of whole texts for a byte-level BPE vocabulary file of the `tokenizers` library.

The ids are those that `tokenizers` gives for the file with add_special_tokens=False. They are made with `tiktoken`, which
reads the same file here and takes a sixth of the time; every worker holds its first texts against `tokenizers` itself,
and the tests do so on more. A text that `tiktoken` can't cut (its pattern gives up on very long runs of white space) is
encoded by the exact encoder of `bpe`, whose time grows with the length alone.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

#: A fixed value: the pattern that cuts a text for a byte-level BPE vocabulary of this family.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBES = 4


def byte_of_char() -> dict[str, int]:
    """The characters that stand for the 256 bytes in such a file: visible ones for themselves, the rest, in order, from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """The tokens as bytes with their ids, which rank the merges, and the added tokens."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    to_byte = byte_of_char()
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    ordinary = {bytes(to_byte[c] for c in token): k for token, k in file["model"]["vocab"].items() if token not in added}
    return ordinary, added


class Encoder:
    def __init__(self, path: str) -> None:
        import tiktoken

        self.path, self.probed = path, 0
        ranks, added = read_vocabulary(path)
        self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=PIECE_PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def ids(self, text: str) -> np.ndarray:
        """The ids of one text, as little-endian unsigned 32-bit integers."""
        try:
            out = self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False)
        except ValueError:
            return exact_ids(self.path, text)
        if self.probed < PROBES and text:
            self.probed += 1
            if not np.array_equal(out, library_ids(self.path, text)):
                raise ValueError(f"the ids of a text differ from those of the tokenizers library for {self.path}")
            if self.probed == PROBES:
                _library.cache_clear()  # the worker lives on; it needs the library no more
        return out


def exact_ids(path: str, text: str) -> np.ndarray:
    from quaylens.llm.bpe import merges

    return np.frombuffer(merges(path).encode(text), dtype="<u4")


def library_ids(path: str, text: str) -> np.ndarray:
    return np.array(_library(path).encode(text, add_special_tokens=False).ids, dtype="<u4")


@lru_cache(maxsize=1)
def _library(path: str):  # noqa: ANN202
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    return Encoder(path)


def default_vocabulary() -> str:
    """The path of the public byte-level vocabulary, which the operators take as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
