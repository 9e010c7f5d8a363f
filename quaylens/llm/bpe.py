"""Byte-level BPE encoding by backtracking over longest matches, and decoding by an offset table.

The vocabulary file gives the merges. An Aho-Corasick automaton over all tokens finds, for each place of a piece of text,
the longest token that starts there. A token may follow another if merging their bytes together would give just these two;
that is looked up in a pair table (worked out from the merges when first met, by undoing them from the last). The encoder
takes the longest token that may follow, a shorter one if it must, and steps back if none fits; a place that led nowhere
isn't tried again, so the work grows with the length of the piece. The result is what the merges in order give.

Decoding joins the tokens' bytes through one table of all bytes and an offset per token, in numpy.

Cases: a null or empty text has no ids and decodes to the empty text. Strings of added tokens in a text become their id.
Rows are encoded one by one, so repeated rows and ties need nothing. Texts of any length are encoded whole. `encode` reads
doc_id and text only, `decode` keeps other columns (its own replaces one named decoded). An empty table gives an empty one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylens.llm.common import text_blocks, texts_of
from quaylens.llm.tokens import PIECE_PATTERN, byte_of_char, default_vocabulary

#: Pieces that a worker remembers, and the longest that it does
CACHE_PIECES, CACHE_CHARS = 500_000, 64


class _Known(dict):
    """The ids of pieces met before; encodes the others and keeps those that aren't long."""

    def __init__(self, tables: Merges) -> None:
        self.tables = tables

    def __missing__(self, piece: str) -> bytes:
        ids = self.tables.encode_piece(piece)
        if len(piece) <= CACHE_CHARS:
            self[piece] = ids
        return ids


class Merges:
    """The tables of one vocabulary file. Tokens are numbered in the order in which merging makes them, bytes first."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        to_byte = byte_of_char()
        as_bytes = lambda token: bytes(to_byte[c] for c in token)
        vocabulary, self.added = file["model"]["vocab"], {t["content"]: t["id"] for t in file["added_tokens"]}
        texts = [bytes([b]) for b in range(256)]
        number = {t: i for i, t in enumerate(texts)}
        chars = {b: c for c, b in to_byte.items()}
        self.ids = [vocabulary[chars[b]] for b in range(256)]
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for merge in file["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = as_bytes(left), as_bytes(right)
            pair = (number[a], number[b])
            if a + b not in number:
                number[a + b] = len(texts)
                texts.append(a + b)
                self.halves.append(pair)
                self.ids.append(vocabulary[left + right])
            self.merged.setdefault(pair, number[a + b])
        self.widths = [len(t) for t in texts]
        self.shorter = [next((number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in number), -1) for t in texts]
        self.automaton = ahocorasick.Automaton()
        for t, i in number.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.follows: dict[tuple[int, int], bool] = {}
        self.pieces = regex.compile(PIECE_PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        size = max([*vocabulary.values(), *self.added.values()]) + 1
        table: list[bytes] = [b""] * size
        for token, k in vocabulary.items():
            table[k] = as_bytes(token) if all(c in to_byte for c in token) else token.encode()
        for token, k in self.added.items():
            table[k] = token.encode()
        self.bytes = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.offsets = np.r_[0, np.cumsum([len(t) for t in table])].astype(np.int64)
        self.packed = [k.to_bytes(4, "little") for k in self.ids]
        self.known = _Known(self)

    def may_follow(self, a: int, b: int) -> bool:
        """True if the bytes of tokens a and b together are encoded as a, b."""
        answer = self.follows.get((a, b))
        if answer is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            answer = self.follows[a, b] = self._may_follow(a, b)
        return answer

    def _may_follow(self, a: int, b: int) -> bool:
        # Undo merges from the last made. A merge over the border, made before the one undone last, would have come first.
        before = len(self.halves)
        while True:
            over = self.merged.get((a, b))
            if over is not None and over < before:
                return False
            if a > b:
                undo_left, whole = True, a < 256
            else:
                undo_left, whole = False, b < 256
            if whole:  # that side is a byte; only the other can be undone
                undo_left = not undo_left
                if (a if undo_left else b) < 256:
                    return True
            if undo_left:
                before, a = a, self.halves[a][1]
            else:
                before, b = b + 1, self.halves[b][0]

    def encode_piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace")
        size, widths, follows = len(raw), self.widths, self.follows
        longest = [-1] * size
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            longest[end + 1 - widths[token]] = token  # later ends are longer
        out: list[int] = []
        dead: set[int] = set()
        place, token, last = 0, longest[0], -1
        while True:
            end = place + widths[token]
            if end not in dead:
                fits = last < 0 or follows.get((last, token))
                if fits is None:
                    fits = self.may_follow(last, token)
                if fits:
                    out.append(token)
                    if end == size:
                        return b"".join([self.packed[t] for t in out])
                    place, last, token = end, token, longest[end]
                    continue
            token = self.shorter[token]
            while token < 0:
                dead.add(place)
                last = out.pop()
                place -= widths[last]
                token = self.shorter[last]
                last = out[-1] if out else -1

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if len(self.known) >= CACHE_PIECES:
            self.known.clear()
        if self.special is None or not any(a in text for a in self.added):
            return b"".join(map(self.known.__getitem__, self.pieces.findall(text)))
        out: list[bytes] = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append(self.added[part].to_bytes(4, "little"))
            else:
                out += map(self.known.__getitem__, self.pieces.findall(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, dtype="<u4")
        if not len(numbers):
            return ""
        starts = self.offsets[numbers]
        widths = self.offsets[numbers + np.uint32(1)] - starts
        ends = np.cumsum(widths)
        at = np.arange(int(ends[-1])) + np.repeat(starts - (ends - widths), widths)
        return self.bytes[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """One set of tables per worker and vocabulary file."""
    return Merges(path)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) and n_tokens of every text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(path)
        for block in text_blocks(batches):
            ids = [m.encode(t) for t in texts_of(block)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["doc_id", "ids", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """`encoded` with the text of its ids in the column `decoded`. Ids outside the vocabulary raise an error."""
    path = vocabulary or default_vocabulary()
    schema = encoded.select(*[c for c in encoded.columns if c != "decoded"]).withColumn("decoded", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                block = batch.slice(i, 256)
                texts = [m.decode(x or b"") for x in block.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(texts, pa.string())], names=[*block.schema.names, "decoded"])

    return encoded.select(*[c for c in encoded.columns if c != "decoded"]).mapInArrow(run, schema)
