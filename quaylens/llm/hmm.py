"""A hidden Markov language model over words.

A state emits a word's class, and the class gives the word by its count. A class is the hash of a word's ending together with
one of the whole word, so it follows from the word alone: one rule for all words, frequent or rare, at every size of the
corpus. There are so many classes (Settings) that a frequent word hardly shares its own with another such word; rare words
share theirs with words of the same ending. So the model gives every sequence of words a probability:

    P(text) = P_hmm(classes of its words, end) * product over words of (c + 0.5) / (mass of the class)

where a class's mass is the sum of c + 0.5 over its words and 0.5 for all words never seen. The model's size is fixed, and
so is what tasks hold of it; what is known of words is counts, in a table that grows with the corpus.

Training is Baum-Welch from random parameters. Every training text counts in every round: tasks add up expected emissions,
transitions and starts, which are summed over the corpus by class. Rounds end when the corpus's likelihood gains no more
than `least_gain` a token, less than the round before, and at the latest after `corpus_rounds`. Neither training nor scoring
cuts a text: the scaled recursions run over the whole text, all texts of a block in step. Training holds about `window` tokens
of them at a time and carries what leads from one window to the next.

Words are counted over all training texts. At most `listed` of the most frequent words are broadcast with their counts; the
rest meets its counts in a join, with the same result.

Cases: a null or empty text is the end token alone. Repeated rows are scored (and, in training folds, counted) row by row.
Without training texts every token has probability 1 under the base model, and the classes are equally likely. Ties in
counts stay on the same side of every cut. Extra columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylens.llm.common import DROP_SHUFFLES, block_words, crc_fold, materialise, session_settings, text_blocks

END = b"\n"  # no word holds a newline


@dataclass(frozen=True)
class Settings:
    states: int = 8
    #: hashes of endings, and of whole words beside each ending: with the end, symbols of 16 bits
    endings: int = 255
    parts: int = 257
    #: words broadcast with their counts at most
    listed: int = 262_144
    #: rounds over the corpus at most, and the gain of log10 likelihood a token that is worth another
    corpus_rounds: int = 14
    least_gain: float = 1e-4
    #: tokens whose forward steps are held at a time, and bytes of symbols in a block of texts that go in step
    window: int = 2 << 20
    block: int = 16 << 20
    #: pseudo-counts that draw a class to the shares of the states in the corpus
    prior: float = 5.0
    seed: int = 7


@dataclass(frozen=True)
class Words:
    """What tasks need to turn words into symbols: symbol 0 is the end, then come the classes, those of the largest mass first, so that what is read most lies close together."""

    words: tuple[bytes, ...]
    counts: np.ndarray
    endings: int
    parts: int
    symbol_of_class: np.ndarray
    masses: np.ndarray  # by symbol, from symbol 1 on
    total: int
    distinct: int
    ends: int

    @property
    def size(self) -> int:
        return 1 + self.endings * self.parts

    @property
    def kind(self) -> str:
        """The narrowest type that holds every symbol."""
        return "<u2" if self.size <= 1 << 16 else "<u4"


@dataclass
class Model:
    start: np.ndarray
    share: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # symbols x states


def class_of(word: bytes, endings: int, parts: int) -> int:
    return zlib.crc32(word[-3:]) % endings * parts + zlib.crc32(word) % parts


def count_words(docs: DataFrame, endings: int, parts: int) -> DataFrame:
    """word, its class (as `class_of` gives it), c over all rows of `docs`; the end is counted once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            names = list(held)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        for block in text_blocks(batches, max_bytes=8 << 20):
            words, _ = block_words(block)
            counts = words.value_counts()
            for word, n in zip(counts.field("values").to_pylist(), counts.field("counts").to_pylist(), strict=True):
                held[word] += n
            held[END] += block.num_rows
            if len(held) > 600_000:
                yield rows()
                held.clear()
        if held:
            yield rows()

    counts = docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return counts.withColumn("class", (F.crc32(F.substring("word", -3, 3)) % endings * parts + F.crc32("word") % parts).cast("int"))


_LEVEL = "cast(floor(log2(c) * 8) as int)"


def learn_words(counts: DataFrame, s: Settings) -> tuple[Words, int]:
    """The listed words, and the count from which on words are listed."""
    total, distinct, top, ends = counts.agg(F.sum("c"), F.count("*"), F.max("c"), F.max(F.when(F.col("word") == F.lit(END), F.col("c")))).first()
    proper = counts.where(F.col("word") != F.lit(END))
    levels = proper.groupBy(F.expr(_LEVEL).alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("level")).collect()  # a few hundred rows
    held, low = 0, (top or 0) + 1
    for level in levels:
        held += level.n
        if held > s.listed:
            break
        low = level.c
    rows = proper.where(F.col("c") >= low).select("word", "c").toArrow()  # at most `listed` rows
    words, numbers = rows.column("word").to_pylist(), rows.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-int(numbers[i]), words[i]))
    masses = np.full(s.endings * s.parts, 0.5)
    summed = proper.groupBy("class").agg(F.sum(F.col("c") + 0.5).alias("mass")).toArrow()  # a row for each class
    masses[summed.column("class").to_numpy()] += summed.column("mass").to_numpy()
    heavy = np.argsort(-masses, kind="stable")
    symbol_of_class = np.empty(len(masses), np.int64)
    symbol_of_class[heavy] = np.arange(1, len(masses) + 1)
    return Words(tuple(words[i] for i in order), numbers[order].astype(np.int64), s.endings, s.parts, symbol_of_class, masses[heavy], total or 0, distinct or 0, ends or 0), low


def encode(docs: DataFrame, words: Words) -> DataFrame:
    """row, doc_id, held_out, n_tokens, n_known, base_score, score (both without unlisted words and the model), symbols (of 16 bits if that holds them, else 32), rare (unlisted words with their numbers)."""
    handle = docs.sparkSession.sparkContext.broadcast(words)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = handle.value
        listed, symbol_of, log_c = _tables(w)
        log_all, log_mass = np.log10(w.total + 0.5 * (w.distinct + 1)), np.log10(w.masses)

        def per_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
            sums = np.r_[0.0, np.cumsum(values)]
            return sums[edges[1:]] - sums[edges[:-1]]

        for block in text_blocks(batches, max_bytes=8 << 20):
            words, edges = block_words(block)
            n, size = block.num_rows, np.diff(edges)
            at = pc.fill_null(pc.index_in(words, value_set=listed), -1).to_numpy()
            unlisted = at < 0
            others = words.filter(pa.array(unlisted)).dictionary_encode()
            codes, names = others.indices.to_numpy(), others.dictionary
            symbol = symbol_of[at] if len(symbol_of) else np.zeros(len(at), np.int64)
            if len(names):
                symbol[unlisted] = w.symbol_of_class[[class_of(x, w.endings, w.parts) for x in names.to_pylist()]][codes]
            logs = np.where(unlisted, 0.0, log_c[at] if len(log_c) else 0.0)
            owner = np.repeat(np.arange(n), size)
            base = per_text(logs, edges) + np.log10(w.ends + 0.5) - (size + 1) * log_all
            shares = logs - log_mass[symbol - 1]
            known = np.round(per_text(~unlisted, edges)).astype(np.int64) + (w.ends > 0)
            # each text's symbols with the end behind them
            ended = np.zeros(len(symbol) + n, dtype=w.kind)
            ended[np.arange(len(symbol)) + owner] = symbol
            bounds = ((edges + np.arange(n + 1)) * ended.itemsize).astype(np.int32)
            symbols = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(ended.tobytes())])
            # each text's unlisted words with their numbers
            pairs, times = np.unique(owner[unlisted] * max(1, len(names)) + codes, return_counts=True)
            texts, word = np.divmod(pairs, max(1, len(names)))
            rare = pa.StructArray.from_arrays([names.take(pa.array(word)), pa.array(times.astype(np.int64))], names=["word", "n"])
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(texts, np.arange(n + 1)).astype(np.int32)), rare)
            made = [pa.array(size + 1), pa.array(known), pa.array(base), pa.array(per_text(shares, edges)), symbols, rare]
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in ("row", "doc_id", "held_out")), *made], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "symbols", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    return rows.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, symbols binary, rare array<struct<word: binary, n: long>>")


_held: dict[str, tuple] = {}


def _tables(words: Words) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A worker's look-up tables for the words that were broadcast; one set at a time."""
    if _held.get("key") != (words.total, words.distinct, words.words[:50]):
        _held.clear()
        symbol = words.symbol_of_class[np.array([class_of(w, words.endings, words.parts) for w in words.words], np.int64)]
        _held.update(key=(words.total, words.distinct, words.words[:50]), tables=(pa.array(words.words, pa.binary()), symbol, np.log10(words.counts + 0.5)))
    return _held["tables"]


def alike(sequences: list[np.ndarray], tokens: int) -> Iterator[list[np.ndarray]]:
    """The sequences in parts of like length, longest first, each of at most so many tokens (or of one sequence)."""
    part, held = [], 0
    for s in sorted(sequences, key=lambda s: -len(s)):
        if part and held + len(s) > tokens:
            yield part
            part, held = [], 0
        part.append(s)
        held += len(s)
    if part:
        yield part


def expected_counts(sequences: list[np.ndarray], m: Model, window: int, into: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """Adds the sequences' expected starts, transitions and emissions to `into`; returns their log10 likelihood. Exact for any `window`, about how many tokens are held at a time."""
    start, step, emit = into
    sequences = sorted(sequences, key=lambda s: -len(s))
    n, k, longest = len(sequences), len(m.start), len(sequences[0])
    sizes = np.array([len(s) for s in sequences])
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # sequences longer than t
    at = np.r_[0, np.cumsum(active)]  # step t is at[t]:at[t + 1], one place for each sequence longer than t
    symbols = np.zeros(at[-1], dtype=np.int32)
    for j, s in enumerate(sequences):
        symbols[at[: len(s)] + j] = s
    active, at = active.tolist(), at.tolist()
    emission, moves = m.emit.astype(np.float32), m.step.astype(np.float32)
    back, ones = np.ascontiguousarray(moves.T), np.ones(k, dtype=np.float32)
    begin = np.tile(m.start.astype(np.float32), (n, 1))

    def forward(low: int, high: int, a: np.ndarray, alpha: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Runs steps low to high from `a`, the step before low; alpha holds the emissions and then the steps. Returns the last step."""
        first = at[low]
        moved = np.empty((active[low], k), dtype=np.float32)
        for t in range(low, high):
            c, i, j = active[t], at[t] - first, at[t + 1] - first
            now, s = alpha[i:j], scale[i:j]
            now *= np.matmul(a[:c], moves, out=moved[:c]) if t else begin
            np.matmul(now, ones, out=s)
            now /= s[:, None]
            a = now
        return a

    lows = [0]  # the first step of each window
    for t in range(1, longest):
        if at[t + 1] - at[lows[-1]] > window:
            lows.append(t)
    highs = [*lows[1:], longest]
    entries = [begin]  # the step before each window
    for low, high in zip(lows[:-1], highs, strict=False):
        part = slice(at[low], at[high])
        entries.append(forward(low, high, entries[-1], emission.take(symbols[part], axis=0), np.empty(part.stop - part.start, np.float32)).copy())
    total, counted = 0.0, np.zeros((k, k))
    beta = np.ones((n, k), dtype=np.float32)
    for low, high, entry in zip(reversed(lows), reversed(highs), reversed(entries), strict=True):
        first, part = at[low], slice(at[low], at[high])
        later = emission.take(symbols[part], axis=0)
        alpha, scale = later.copy(), np.empty(len(later), dtype=np.float32)
        forward(low, high, entry, alpha, scale)
        total += float(np.log10(scale).sum(dtype=np.float64))
        later /= scale[:, None]
        for t in range(high - 1, low - 1, -1):  # later: what follows a step and its own emission, given the state
            c, here = active[t], later[at[t] - first : at[t + 1] - first]
            here *= beta[:c]
            np.matmul(here, back, out=beta[:c])
        # for all tokens of the window: the step before, the moves, and the states' probabilities given the whole texts, which
        # take the place of `later`; in parts that stay in a processor's cache
        t = low
        while t < high:
            upto = t + 1
            while t > low and upto < high and at[upto + 1] - at[t] <= 1 << 14:
                upto += 1
            here = later[at[t] - first : at[upto] - first]
            if t == low:
                before = entry[: active[t]]
            else:
                before = np.concatenate([alpha[at[x - 1] - first : at[x - 1] - first + active[x]] for x in range(t, upto)])
            given = before @ moves if t else begin.copy()
            given *= here
            mass = (given @ ones)[:, None]
            if t:
                here /= mass
                counted += before.T @ here
            np.divide(given, mass, out=here)
            if not t:
                start += here.sum(axis=0)
            t = upto
        flat = symbols[part]
        for x in range(k):
            emit[:, x] += np.bincount(flat, weights=later[:, x], minlength=len(emit))
    step += counted * m.step
    return total


def maximise(start: np.ndarray, step: np.ndarray, emit: np.ndarray, common: np.ndarray, prior: float) -> Model:
    """Parameters from expected counts. A class's shares of the states are drawn to those of the corpus by `prior` pseudo-counts, so that a class of few tokens tells little of the state, however large the corpus."""
    share = emit.sum(axis=0) + 1e-3
    share /= share.sum()
    given = (emit + prior * share) / (emit.sum(axis=1, keepdims=True) + prior) * common[:, None]
    return Model((start + 1) / (start + 1).sum(), share, (step + 0.1) / (step + 0.1).sum(axis=1, keepdims=True), given / given.sum(axis=0))


def train(encoded: DataFrame, words: Words, s: Settings) -> Model:
    """Baum-Welch on the rows of `encoded` that aren't held out."""
    rows, k, size = encoded.where("not held_out"), s.states, words.size
    common = np.r_[words.ends, words.masses].astype(float) + 1e-3
    common /= common.sum()
    zeros = lambda: (np.zeros(k), np.zeros((k, k)), np.zeros((size, k)))
    rng = np.random.default_rng(s.seed)
    emit = common[:, None] * rng.uniform(0.5, 1.5, (size, k))
    model = Model(np.full(k, 1 / k), np.full(k, 1 / k), np.full((k, k), 0.1 / k) + 0.9 * np.eye(k), emit / emit.sum(axis=0))
    n = rows.count()
    if not n:
        return Model(model.start, model.share, model.step / model.step.sum(axis=1, keepdims=True), np.tile(common[:, None], (1, k)))
    spark, reached, gain, kind_of_symbol = encoded.sparkSession, -np.inf, np.inf, words.kind
    for _ in range(s.corpus_rounds):
        handle = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            got, likelihood = zeros(), np.zeros((1, k))
            for block in text_blocks(batches, "symbols", s.block):
                for part in alike([np.frombuffer(x, kind_of_symbol) for x in block.column("symbols").to_pylist()], s.window):
                    likelihood[0, 0] += expected_counts(part, handle.value, s.window, got)
            start, step, emit = got
            used = np.flatnonzero(emit.any(axis=1))
            symbol = np.r_[-1, -2 - np.arange(k), -2 - k, used].astype(np.int32)
            values = np.vstack([start, step, likelihood, emit[used]]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(symbol), *(pa.array(values[:, j]) for j in range(k))], names=["symbol", *(f"s{j}" for j in range(k))])

        with session_settings(spark, DROP_SHUFFLES):
            summed = rows.select("symbols").mapInArrow(expect, "symbol int, " + ", ".join(f"s{j} float" for j in range(k)))
            # a task has one row for each symbol, so the rows go to their partition once, unaggregated
            summed = summed.repartition("symbol").groupBy("symbol").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]).toArrow()  # a row for each symbol
        handle.unpersist()
        symbol = summed.column("symbol").to_numpy()
        values = np.column_stack([summed.column(f"s{j}").to_numpy() for j in range(k)])
        start, step, emit = zeros()
        emit[symbol[symbol >= 0]] = values[symbol >= 0]
        moved = (symbol < -1) & (symbol > -2 - k)
        step[-2 - symbol[moved]] = values[moved]
        start[:] = values[symbol == -1].sum(axis=0)
        model = maximise(start, step, emit, common, s.prior)
        now = values[symbol == -2 - k, 0].sum() / words.total
        last, gain, reached = gain, now - reached, now
        if gain < min(last, s.least_gain):
            break
    return model


def log10_likelihoods(sequences: list[np.ndarray], m: Model) -> np.ndarray:
    """The exact log10 probability of each whole sequence, by the scaled forward recursion."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    sizes = np.array([len(sequences[i]) for i in order])
    out = np.zeros(len(order))
    if not len(order):
        return out
    # texts of like length go in step; a group's longest has at most twice its shortest's length
    begin = 0
    while begin < len(order):
        end = int(np.searchsorted(-sizes, -(sizes[begin] // 2), side="right"))
        end = max(end, begin + 1)
        group = order[begin:end]
        longest = int(sizes[begin])
        symbols = np.zeros((longest, len(group)), dtype=sequences[0].dtype)
        for j, i in enumerate(group):
            symbols[: len(sequences[i]), j] = sequences[i]
        active = np.searchsorted(-sizes[begin:end], -np.arange(longest), side="left")
        total = np.zeros(len(group))
        a = m.start * m.emit[symbols[0]]
        for t in range(longest):
            c = int(active[t])
            if t:
                a = (a[:c] @ m.step) * m.emit[symbols[t, :c]]
            scale = a.sum(axis=1)
            total[:c] += np.log10(scale)
            a = a / scale[:, None]
        out[group] = total
        begin = end
    return out


def score(docs: DataFrame, settings: Settings | None = None, folds: int = 5, fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row. Rows whose crc32(doc_id) modulo `folds` is `fold` are held out."""
    s = settings or Settings()
    docs = docs.select("doc_id", "text", (crc_fold(F.col("doc_id"), folds) == fold).alias("held_out"))
    counts = materialise(count_words(docs.where("not held_out"), s.endings, s.parts), "word-counts")
    words, low = learn_words(counts, s)
    encoded = materialise(encode(docs, words), "symbols")
    model = train(encoded, words, s)
    handle, kind_of_symbol = docs.sparkSession.sparkContext.broadcast(model), words.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "symbols", s.block):
            found = log10_likelihoods([np.frombuffer(x, kind_of_symbol) for x in block.column("symbols").to_pylist()], handle.value)
            columns = [block.column(c) for c in ("row", "doc_id", "held_out", "n_tokens", "n_known", "base_score")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(block.column("score").to_numpy() + found)], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "symbols").mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    met = rare.join(counts.where(F.col("c") < low).select("word", "c"), "word", "left")
    rest = met.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("met"))
    out = scored.join(rest, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"), (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))
