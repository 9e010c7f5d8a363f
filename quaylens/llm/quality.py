"""Quality rules about repetition, measured over whole texts.

Words are runs of characters other than space and U+0009 to U+000D. Every block of texts becomes one array of word
numbers; a rolling hash over it gives, for each n, a 64-bit value per window of n words (mixed with the text's number, so
windows of two texts never meet). A window whose value occurs twice in its text is repeated, and its characters count once.

Cases: a null or empty text has no words and fails the base rule. Texts of any length are measured whole. Repeated rows are
measured row by row. There is no order, so ties don't arise. `keep_good` keeps all columns of its rows, whatever their names;
`assess` reads doc_id and text only. An empty table gives an empty one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylens.llm.common import text_blocks, texts_of

SYMBOLS = "#*$%&|<>"
_GAPS = " \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Rules:
    """Shares of a text's word characters (or of its lines) above which it is rejected."""

    least_words: int = 50
    repeat_words_percent: int = 50
    #: n -> percent of the word characters inside windows of n words that occur twice or more
    window_percent: tuple[tuple[int, int], ...] = ((5, 32), (7, 30), (10, 28))
    dup_line_percent: int = 30
    dup_line_char_percent: int = 30
    symbol_percent: int = 10


_B, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def measure(texts: list[str], windows: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The counts of each text: words, characters, symbols, repeated lines, and for each n what repeated windows cover."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    split = [t.encode("utf-8", "replace").split() for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(sizes.sum()))
    widths = np.fromiter((len(w.decode("utf-8")) for w in number), dtype=np.int64, count=len(number))
    chars = widths[ids] if len(ids) else ids
    text = np.repeat(np.arange(len(texts)), sizes)
    per_text = lambda weights: np.bincount(text, weights=weights, minlength=len(texts)).astype(np.int64)

    lines = [[x for x in t.split("\n") if x.strip(_GAPS)] for t in texts]
    out = {
        "n_words": sizes,
        "word_chars": per_text(chars),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], dtype=np.int64),
        "n_lines": np.array([len(x) for x in lines], dtype=np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
        "line_chars": np.array([sum(map(len, x)) for x in lines], dtype=np.int64),
        "dup_line_chars": np.array([sum(map(len, x)) - sum(map(len, set(x))) if len(set(x)) < len(x) else 0 for x in lines], dtype=np.int64),
    }
    value = _mix(ids.astype(np.uint64) + _B)
    salt = _mix(text.astype(np.uint64) * _M2 + _M1)
    rolling = np.zeros(len(ids), dtype=np.uint64)
    for n in range(1, max(windows) + 1):
        rolling = rolling[: len(ids) - n + 1] * _B + value[n - 1 :] if len(ids) >= n else rolling[:0]
        if n not in windows:
            continue
        covered = np.zeros(len(ids), dtype=bool)
        if len(rolling):
            inside = text[: len(rolling)] == text[n - 1 :]
            key = _mix(rolling + salt[: len(rolling)])
            order = np.sort(key[inside])
            twice = np.unique(order[1:][order[1:] == order[:-1]])
            if len(twice):
                at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
                repeated = (twice[at] == key) & inside
                for j in range(n):
                    covered[j : j + len(repeated)] |= repeated
        out[f"words_{n}"] = per_text(covered)
        out[f"chars_{n}"] = per_text(chars * covered)
    return out


def assess(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """doc_id and text's measures with base_failed and kept. Further columns: n_lines, dup_line_chars, line_chars and chars_n of each window length n."""
    r = rules or Rules()
    windows = tuple(sorted({3, *(n for n, _ in r.window_percent)}))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "words_3", "n_lines", "line_chars", "dup_line_chars", *(f"chars_{n}" for n in windows if n != 3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            got = measure(texts_of(block), windows)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *(pa.array(got[n], pa.int64()) for n in names)], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names)).withColumnRenamed("words_3", "n_repeat_words")
    base = (F.col("n_words") < r.least_words) | (100 * F.col("n_repeat_words") > r.repeat_words_percent * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("kept", ~base & verdict(r))


def verdict(r: Rules):  # noqa: ANN201
    """The method's own verdict, true for texts to keep."""
    fine = (100 * F.col("n_dup_lines") <= r.dup_line_percent * F.col("n_lines")) & (100 * F.col("dup_line_chars") <= r.dup_line_char_percent * F.col("line_chars"))
    fine &= 100 * F.col("n_symbols") <= r.symbol_percent * F.col("word_chars")
    for n, percent in r.window_percent:
        fine &= 100 * F.col(f"chars_{n}") <= percent * F.col("word_chars")
    return fine


def keep_good(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The rows of `docs` that pass, whole and with their own columns."""
    r = rules or Rules()
    windows = tuple(sorted({3, *(n for n, _ in r.window_percent)}))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            m = measure(texts_of(block), windows)
            ok = (m["n_words"] >= r.least_words) & (100 * m["words_3"] <= r.repeat_words_percent * m["n_words"])
            ok &= (100 * m["n_dup_lines"] <= r.dup_line_percent * m["n_lines"]) & (100 * m["dup_line_chars"] <= r.dup_line_char_percent * m["line_chars"])
            ok &= 100 * m["n_symbols"] <= r.symbol_percent * m["word_chars"]
            for n, percent in r.window_percent:
                ok &= 100 * m[f"chars_{n}"] <= percent * m["word_chars"]
            yield block.filter(pa.array(ok))

    return docs.mapInArrow(run, schema)
