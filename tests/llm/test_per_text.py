"""Operators that look at one text at a time: toxicity, quality, BPE, order, packing."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quaylens.llm import bpe, packing, quality, tokens, toxicity, training_order

GAP = re.compile(r"[^\x20\x09-\x0D]+")


# toxicity


def test_toxicity_on_held_out_labels(spark):  # noqa: ANN001
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    model = toxicity.fit(docs, labels, toxicity.Settings(toxic_rows=400, other_rows=800))
    got = toxicity.score(docs.select("doc_id", "text"), model).join(held, "doc_id").groupBy("toxic", (F.col("score") >= 0.5).alias("said")).count().collect()
    n = {(r.toxic, r.said): r["count"] for r in got}
    assert n.get((1, True), 0) >= 0.75 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.01 * n[0, False]


def test_swapped_terms_lower_the_cost_of_neutral_mentions(spark):  # noqa: ANN001
    texts = [(i, "those muslim people are awful scum", 1) for i in range(0, 120, 2)] + [(i, "those people like the garden", 0) for i in range(1, 120, 2)]
    texts += [(200 + i, "a christian walked in the garden", 0) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    neutral = spark.createDataFrame([(1, "a muslim walked home")], "doc_id long, text string")
    said = {}
    for weight in (0.0, 50.0):
        model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"), toxicity.Settings(counterfactual=weight))
        said[weight] = toxicity.score(neutral, model).first().score
        assert toxicity.score(df.where("toxic = 1"), model).agg(F.min("score")).first()[0] > 0.5
    assert said[50.0] < 0.5 * said[0.0]


def test_toxic_terms_count_in_words_of_any_length_and_between_any_spaces(spark):  # noqa: ANN001
    texts = [(i, f"you are awful scum {i}", 1) for i in range(0, 120, 2)] + [(i, f"people like the garden {i}", 0) for i in range(1, 120, 2)]
    df = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    gap = "the garden is green and people like it " * 3
    hidden = [(gap + "awful scum").replace(" ", c) for c in ("\u00a0", "\u2014", "\uff0c", "\u3000", "\u200b", "")]
    said = {r.text: r.score for r in toxicity.score(spark.createDataFrame([(t,) for t in hidden], "text string"), model).collect()}
    assert all(said[t] > 0.5 for t in hidden[:-1])
    assert said[hidden[-1]] > 5 / (1 + np.exp(-model.bias))  # one long word: its pieces count, though not the ends of the terms
    assert toxicity.words_of("d\u00e9j\u00e0\u2019vu \u6f22\u5b57\u3002") == {"d\u00e9j\u00e0".encode(), b"vu", "\u6f22\u5b57".encode()}
    assert toxicity.features(b"a" * 63 + b"scum") >= {"scum$", "cum$"}


def test_toxicity_bears_odd_rows(odd, none, labels):  # noqa: ANN001
    model = toxicity.fit(odd.where("doc_id is not null"), labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == 18 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, model).count() == 0
    kept = toxicity.reject_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == 18
    assert toxicity.fit(odd, labels.limit(0)).weights == {}


def test_weights_against_a_numeric_gradient():
    rng = np.random.default_rng(4)
    rows = [rng.integers(0, 6, int(rng.integers(0, 5))) for _ in range(40)]
    toxic = (rng.random(40) < 0.4).astype(float)
    pairs = [(np.array([0, 1]), np.array([2]), 3.0), (np.array([4]), np.array([], dtype=np.int64), 1.0)]
    s = toxicity.Settings(steps=4000)

    def loss(bias, w):  # noqa: ANN001, ANN202
        total = 0.0
        for r, y in zip(rows, toxic, strict=True):
            p = 1 / (1 + np.exp(-(bias + sum(w[i] for i in r))))
            total -= np.log(p if y else 1 - p) / len(rows)
        total += s.ridge * (w**2).sum()
        return total + s.counterfactual * sum(n * (w[a].sum() - w[b].sum()) ** 2 for a, b, n in pairs) / sum(n for *_, n in pairs)

    bias, w = toxicity.fit_weights(rows, toxic, 6, pairs, s)
    step = 1e-5
    assert abs(loss(bias + step, w) - loss(bias - step, w)) / (2 * step) < 2e-3
    for i in range(6):
        up, down = w.copy(), w.copy()
        up[i] += step
        down[i] -= step
        slope = (loss(bias, up) - loss(bias, down)) / (2 * step)
        assert abs(slope) < 2e-3 if w[i] > 1e-3 else slope > -2e-3


def test_scores_against_plain_python(documents, odd):  # noqa: ANN001
    model = toxicity.Model(-1.5, {"=alpha1": 0.7, "^alp": 0.2, "eta": 9.0, "beta": 0.4, "=x": 1.0})
    for df in (documents, odd):
        for r in toxicity.score(df, model).collect():
            z = model.bias
            for word in {w.decode() for w in toxicity.words_of(r.text or "")}:
                marked = f"^{word}$"
                z += sum(v for f, v in model.weights.items() if f == "=" + word or (len(f) in (4, 5) and f[0] != "=" and f in marked))
            assert abs(r.score - 1 / (1 + np.exp(-max(-30, min(30, z))))) < 1e-9


@pytest.mark.parametrize(("first", "second"), [("muslim", "christian"), ("juif", "musulman"), ("frauen", "männer"), ("refugiado", "extranjero")])
def test_terms_of_four_languages_are_swapped(first, second):  # noqa: ANN001
    assert toxicity.swaps(f"x {first} y. z", toxicity.IDENTITY_GROUPS)[first, second] == 1


# quality


def counted(text):  # noqa: ANN001, ANN201
    text = text or ""
    words = GAP.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(words) < 2000 else None
    inside = set() if twice is None else {i + j for i, w in enumerate(windows) if w in twice for j in range(3)}
    lines = [x for x in text.split("\n") if GAP.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), (None if twice is None else len(inside))


def test_quality_counts(odd, documents):  # noqa: ANN001
    for df in (odd.where("length(text) < 5000 or text is null"), documents.where("length(text) < 4000")):
        texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())
        got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.assess(df).collect())
        assert got == sorted(counted(t) for *_, t in texts)


def test_quality_filter_keeps_what_assess_keeps(odd, documents, none):  # noqa: ANN001
    for df in (odd, documents):
        kept = quality.keep_good(df)
        assert kept.columns == df.columns
        assert kept.count() == quality.assess(df).where("kept").count()
    assert quality.keep_good(none).count() == 0


# BPE


def test_bpe_equals_the_library(documents, odd, none):  # noqa: ANN001
    path = tokens.default_vocabulary()
    for df in (documents, odd):
        texts = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()): r.text or "" for r in df.collect()}
        for r in bpe.decode(bpe.encode(df)).collect():
            text = texts[r.doc_id, hashlib.sha256(r.decoded.encode()).hexdigest()]  # the decoded text is the text
            assert r.ids == tokens.library_ids(path, text).tobytes() and r.n_tokens == len(r.ids) // 4
    assert bpe.encode(none).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|> <|endoftext|>\n", "  two", "end  ", "it's they'LL 12 3", "a" * 5000, "\n\n \t x", "\U0001f600‍\U0001f600"])
def test_bpe_on_hard_texts(text):  # noqa: ANN001
    path = tokens.default_vocabulary()
    ids = bpe.merges(path).encode(text)
    assert ids == tokens.library_ids(path, text).tobytes() == tokens.encoder(path).ids(text).tobytes()
    assert bpe.merges(path).decode(ids) == text


# training order


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_permutation(size):  # noqa: ANN001
    a, b = (training_order.feistel(np.arange(size), size, key) for key in (1, 2))
    assert sorted(a) == sorted(b) == list(range(size))
    assert size < 50 or not np.array_equal(a, b)


def plain_feistel(n, size, key):  # noqa: ANN001, ANN201
    """The permutation of one number in plain integers."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    keys = np.random.Generator(np.random.Philox(key)).integers(0, 2**63, training_order.ROUNDS).tolist()
    while True:
        left, right = n >> half, n & ((1 << half) - 1)
        for k in keys:
            y = ((right ^ k) * 0x9E3779B97F4A7C15) % 2**64
            y = ((y ^ (y >> 29)) * 0xBF58476D1CE4E5B9) % 2**64
            left, right = right, left ^ ((y >> 32) & ((1 << half) - 1))
        n = (left << half) | right
        if n < size:
            return n


def test_feistel_against_plain_integers():
    for size in (1, 7, 1000):
        assert training_order.feistel(np.arange(size), size, 9).tolist() == [plain_feistel(n, size, 9) for n in range(size)]


def test_slots_and_shards_against_plain_python(spark, odd, none):  # noqa: ANN001
    path, length, per_shard = tokens.default_vocabulary(), 64, 5
    end = training_order.END_ID
    for df in (odd, none):
        cut = training_order.sequences(df, path, length).collect()
        folder, manifest = training_order.write(df, key=3, length=length, shard_sequences=per_shard)
        got = training_order.read_back(folder, manifest, length=length, shard_sequences=per_shard).collect()
        first, total = {}, 0
        for task in sorted({r.task for r in cut}):
            first[task] = total
            total += sum(r.task == task for r in cut)
        assert manifest.count() == total and all(r.read_crc32 == r.ids_crc32 for r in got)
        slots = {plain_feistel(first[r.task] + r.number, total, 3): r for r in cut}
        assert sorted(slots) == list(range(total))
        assert {(p.doc_id, p.start, p.length, s, p.offset) for s, r in slots.items() for p in r.pieces} == {(r.doc_id, r.start, r.length, r.slot, r.offset) for r in got}
        assert all((r.shard, r.position) == divmod(r.slot, per_shard) for r in got)
        # the ids of every document, put together from the shards alone
        ids = {r.slot: np.frombuffer(r.ids, "<u2") for r in training_order.read(spark, folder, total, 0, length=length, shard_sequences=per_shard).collect()}
        assert all(ids[s].tobytes() == zstandard.decompress(r.packed) for s, r in slots.items())
        if not total:
            continue
        late = training_order.read(spark, folder, total, total - 7, length=length, shard_sequences=per_shard).collect()
        assert sorted(r.slot for r in late) == list(range(total - 7, total)) and all(r.ids == ids[r.slot].tobytes() for r in late)
        whole = {}
        for r in sorted(got, key=lambda r: r.start):
            if r.doc_id == 6:
                whole.setdefault(r.doc_id, []).append(ids[r.slot][r.offset : r.offset + r.length])
        text = next(r.text for r in odd.collect() if r.doc_id == 6)
        assert np.concatenate(whole[6]).tolist() == [*tokens.library_ids(path, text), end]
        assert sum(r.length for r in got) == sum(len(tokens.library_ids(path, r.text or "")) + 1 for r in odd.collect())


HARD = {"spaces": " " * 1_000_000, "letters": "a" * 1_000_000, "newlines": "\n" * 300_000 + "x", "mixed": "ab \n\t" * 100_000 + " " * 200_000}


@pytest.mark.parametrize("name", HARD)
def test_ids_of_very_long_runs(name):  # noqa: ANN001
    path = tokens.default_vocabulary()
    assert np.array_equal(tokens.encoder(path).ids(HARD[name]), tokens.library_ids(path, HARD[name]))


def test_very_long_runs_are_packed_and_ordered(spark):  # noqa: ANN001
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD.values())], "doc_id long, text string")
    out = packing.pack(df).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert len(out) == len(HARD) and all(r.n == r.m for r in out)
    folder, manifest = training_order.write(df)
    assert all(r.read_crc32 == r.ids_crc32 for r in training_order.read_back(folder, manifest).collect())


# packing


def test_patterns_cover_the_demand_with_little_waste():
    rng = np.random.default_rng(5)
    demand = np.bincount(rng.integers(0, 64, 3000), minlength=64)
    patterns = packing.solve(demand, 64)
    held = np.zeros(64, dtype=int)
    for p, n in patterns.items():
        assert sum(k + 1 for k in p) <= 64
        for k in p:
            held[k] += n
    assert np.array_equal(held, demand)
    assert sum(patterns.values()) <= 1.02 * (demand * np.arange(1, 65)).sum() / 64 + 2
    assert not packing.solve(np.zeros(8, dtype=int), 8)


def test_best_pattern_against_brute_force():
    from itertools import combinations_with_replacement

    values = np.array([0.11, 0.3, 0.35, 0.5])
    best = max(sum(values[list(p)]) for n in range(10) for p in combinations_with_replacement(range(4), n) if sum(k + 1 for k in p) <= 9)
    assert abs(packing.best_pattern(values, 9)[0] - best) < 1e-9


def test_packing_places_every_id_once(odd, documents, none):  # noqa: ANN001
    path = tokens.default_vocabulary()
    for df, small in ((odd, True), (documents, False)):
        length, grain = (256, 4) if small else (2048, 8)
        out = [r.asDict() for r in packing.pack(df, length=length, grain=grain).collect()]
        by_sequence: dict[int, list] = {}
        for r in out:
            by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_length"]))
        for pieces in by_sequence.values():
            pieces.sort()
            assert [o for o, *_ in pieces] == list(np.cumsum([0, *[n for _, n, _ in pieces]])[:-1])
            assert sum(n for _, n, _ in pieces) == pieces[0][2] <= length
        assert sorted(by_sequence) == list(range(len(by_sequence)))
        expected = []
        for r in df.collect():
            ids = tokens.library_ids(path, r.text or "").tobytes() + (1).to_bytes(4, "little")
            expected += [(s, min(length, len(ids) // 4 - s), zlib.crc32(ids[4 * s : 4 * (s + length)]), len(ids) // 4) for s in range(0, len(ids) // 4, length)]
        assert sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == sorted(expected)
        total = sum(r["length"] for r in out)
        assert small or len(by_sequence) <= 1.02 * total / length + 2
    assert packing.pack(none).count() == 0
