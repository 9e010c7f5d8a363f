"""Operators that hold texts against one another, and the pipeline, against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylens.llm import fingerprint, hmm, linedup, ngram_join, warc
from quaylens.llm.common import lower_words
from quaylens.llm.components import smallest_reachable

# fingerprints


def words(text):  # noqa: ANN001, ANN201
    return Counter(text.encode().split())


def generalised(a, b):  # noqa: ANN001, ANN201
    keys = a.keys() | b.keys()
    top = sum(max(a[k], b[k]) for k in keys)
    return sum(min(a[k], b[k]) for k in keys) / top if top else 1.0


def test_fingerprints_against_plain_python(documents):  # noqa: ANN001
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    got = {r.doc_id: r for r in fingerprint.fingerprints(documents).collect()}
    assert len(got) == len(rows)
    off_edited, off_next = [], []
    by_text = {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        off_edited.append(r.near_edited - generalised(words(text), words(edited)))
        off_next.append(r.near_next - generalised(words(text), words(after)))
    for off in (off_edited, off_next):
        assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.11
    assert len(set(by_text.values())) == len(by_text)


def test_fingerprints_bear_odd_rows(odd, none):  # noqa: ANN001
    got = fingerprint.fingerprints(odd).collect()
    assert len(got) == 18
    assert len({r.fingerprint for r in got if r.n_chars == 0}) == 1
    assert len([r for r in got if r.doc_id == 8]) == 2 and len({r.fingerprint for r in got if r.doc_id in (7, 8)}) == 1
    assert fingerprint.fingerprints(none).count() == 0


# n-gram join


def brute(rows, n, share):  # noqa: ANN001, ANN201
    sets = defaultdict(list)
    for i, text in rows:
        w = lower_words(text or "")
        k = min(n, len(w))
        sets[i].append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set())
    parent = {i: i for i in sets}

    def root(x):  # noqa: ANN001, ANN202
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for (i, a), (j, b) in itertools.combinations(flat, 2):
        if min(len(a), len(b)) * 100 >= share * max(len(a), len(b)):
            o = len(a & b)
            if 100 * o >= share * (len(a) + len(b) - o):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in sets}


@pytest.mark.parametrize(("n", "share"), [(3, 90), (5, 80)])
def test_join_against_all_pairs(documents, n, share):  # noqa: ANN001
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: r.component_id for r in ngram_join.components(documents, n, share).collect()}
    assert got == brute(rows, n, share)


def test_join_of_a_large_group_of_near_copies(spark):  # noqa: ANN001
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 10_000, 60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(int(rng.integers(0, 5))):
            k = int(rng.integers(0, len(w)))
            w[k : k + 1] = [] if rng.random() < 0.5 else [f"v{rng.integers(0, 40)}"]
        rows.append((i, " ".join(w)))
    rows += [(500 + i, " ".join(base[:30] + [f"u{i}_{k}" for k in range(30)])) for i in range(60)]
    got = {r.doc_id: r.component_id for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()}
    assert got == brute(rows, 3, 80)


def test_join_of_more_near_copies_than_a_small_group_holds(spark, monkeypatch):  # noqa: ANN001
    """Chains, bridges and loners among many copies of one text, with groups gone through in several rounds of pivots."""
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 24)
    monkeypatch.setattr(ngram_join, "PIVOT_STEP", 3)
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(int(rng.integers(1, 7))):
            w[int(rng.integers(0, 60))] = f"v{rng.integers(0, 12)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 400, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (75, 90):
        assert {r.doc_id: r.component_id for r in ngram_join.components(df, 3, share).collect()} == brute(rows, 3, share)


def test_pairs_given_twice_count_once(spark):  # noqa: ANN001
    segments = spark.createDataFrame([(n, f, [f * 10 + k for k in range(3)] if f < 2 else []) for n in (1, 2) for f in range(8)], "node long, fragment int, grams array<long>")
    pairs = spark.createDataFrame([(1, 2, 10, 10)] * 2, "a long, b long, size_a long, size_b long")
    assert ngram_join._links(pairs, segments, 80).count() == 0  # six of ten are shared, given once or twice


def test_join_bears_odd_rows(odd, none):  # noqa: ANN001
    got = {r.doc_id: (r.n_grams, r.component_id) for r in ngram_join.components(odd, 3, 80).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[4] == (1, 4)
    assert got[7][1] == got[8][1] == 7 and got[10][1] == got[11][1] == got[9][1] == 9
    assert ngram_join.components(none, 3, 90).count() == 0
    kept = ngram_join.keep_one(odd, 3, 80)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[7] == 1 and ids[8] == ids[10] == ids[11] == 0 and ids[12] == 1 and ids[None] == 2


def test_components_of_long_chains(spark):  # noqa: ANN001
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)]
    got = {r.node: r.label for r in smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[200] == got[150] == 100


# line dedup


def test_lines_against_plain_python(documents, odd):  # noqa: ANN001
    edges = " \t\x0b\x0c\r"
    for df in (documents, odd):
        rows = [(r.doc_id, r.source, r.text) for r in df.collect()]
        sites, ids = defaultdict(set), defaultdict(list)
        for i, s, text in rows:
            for line in (text or "").split("\n"):
                k = line.strip(edges)
                if len(k) >= 20:
                    sites[k].add(s)
                    ids[k].append(i)
        common = {k: min((i for i in ids[k] if i is not None), default=None) for k, s in sites.items() if len(s - {None}) >= 3}
        expected = Counter()
        for i, _, text in rows:
            kept = [x for x in (text or "").split("\n") if x.strip(edges) not in common or common[x.strip(edges)] == i]
            expected[i, "\n".join(kept) if text is not None else None] += 1
        assert Counter((r.doc_id, r.text) for r in linedup.clean(df).collect()) == expected


def test_cleaned_documents_keep_their_own_columns(odd, none):  # noqa: ANN001
    own = [c for c in odd.columns if c not in ("text", "n_chars")]
    out = linedup.clean_documents(odd)
    assert out.columns == odd.columns
    assert Counter(map(tuple, out.select(*own).collect())) == Counter(map(tuple, odd.select(*own).collect()))
    assert {(r.n_lines, r.n_removed) for r in out.collect()} == {(777, 888)}
    counted = linedup.clean(odd)
    assert sum(r.n_lines for r in counted.collect()) == sum(len(r.text.split("\n")) for r in odd.collect() if r.text is not None)
    assert linedup.clean_documents(none).columns == none.columns


def test_lines_of_documents_without_an_id(spark):  # noqa: ANN001
    line = "a line that many sites have"
    rows = [(None, f"{line}\nown line number {i} of nobody", f"s{i}") for i in range(6)] + [(None, line, "s9"), (5, f"{line}\nx", "s7"), (9, line, "s8")]
    out = linedup.clean(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert [r.text for r in out if r.doc_id == 5] == [f"{line}\nx"] and [r.text for r in out if r.doc_id == 9] == [""]
    assert all(line not in r.text for r in out if r.doc_id is None)


def test_many_sites_need_no_exact_count(spark):  # noqa: ANN001
    rows = [(i, f"This line is on many sites, it is.\nand this one only here {i}", f"s{i}") for i in range(40)]
    out = {r.doc_id: r.text.count("\n") for r in linedup.clean(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0] == 1 and all(out[i] == 0 for i in range(1, 40))


def test_lines_of_an_empty_table(none):  # noqa: ANN001
    assert linedup.clean_documents(none).count() == 0


# language model


def test_forward_recursion_against_all_paths():
    rng = np.random.default_rng(2)
    draw = lambda *s: (x := rng.random(s)) / x.sum(axis=-1, keepdims=True)
    m = hmm.Model(draw(3), draw(3), draw(3, 3), draw(3, 5).T.copy())
    sequences = [np.array(s) for s in ([0], [1, 2, 3, 0], [4, 4, 1, 0, 2, 3])]
    for s, got in zip(sequences, hmm.log10_likelihoods(sequences, m), strict=True):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.step[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            total += p
        assert abs(math.log10(total) - got) < 1e-9


def test_expected_counts_against_all_paths():
    rng = np.random.default_rng(6)
    draw = lambda *s: (x := rng.random(s)) / x.sum(axis=-1, keepdims=True)
    m = hmm.Model(draw(2), draw(2), draw(2, 2), draw(2, 4).T.copy())
    s = np.array([1, 3, 2, 0])
    got = (np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2)))
    hmm.expected_counts([s], m, 256, got)
    start, step, emit, total = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2)), 0.0
    for path in itertools.product(range(2), repeat=4):
        p = m.start[path[0]] * m.emit[s[0], path[0]]
        for t in range(1, 4):
            p *= m.step[path[t - 1], path[t]] * m.emit[s[t], path[t]]
        total += p
        start[path[0]] += p
        for t in range(4):
            emit[s[t], path[t]] += p
            if t:
                step[path[t - 1], path[t]] += p
    for a, b in zip(got, (start, step, emit), strict=True):
        assert np.allclose(a, b / total, atol=1e-4)


def test_windows_do_not_change_expected_counts():
    rng = np.random.default_rng(8)
    draw = lambda *s: (x := rng.random(s)) / x.sum(axis=-1, keepdims=True)
    m = hmm.Model(draw(3), draw(3), draw(3, 3), draw(3, 6).T.copy())
    sequences = [rng.integers(0, 6, n) for n in (1, 2, 7, 8, 9, 30, 30, 61)]
    found = []
    for window in (4, 8, 1000):
        got = (np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3)))
        total = hmm.expected_counts(sequences, m, window, got)
        assert abs(total - hmm.log10_likelihoods(sequences, m).sum()) < 1e-3
        assert abs(got[1].sum() - sum(len(s) - 1 for s in sequences)) < 1e-2  # no transition is lost at an edge
        found.append(got)
    for got in found[1:]:
        assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(got, found[0], strict=True))


def test_every_training_text_counts_in_every_round(spark, monkeypatch):  # noqa: ANN001
    df = spark.createDataFrame([(i, f"a{i % 5} b{i % 7} " * 20) for i in range(60)], "doc_id long, text string")
    real = hmm.expected_counts

    def in_tasks(*a):  # noqa: ANN002, ANN202
        from pyspark import TaskContext

        assert TaskContext.get() is not None, "texts were drawn to the driver"
        return real(*a)

    monkeypatch.setattr(hmm, "expected_counts", in_tasks)
    assert hmm.score(df, hmm.Settings(states=2)).count() == 60


def test_scores_against_plain_python(documents):  # noqa: ANN001
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    counts = Counter(w for i, t in rows if fold(i) != 1 for w in [*lower_words(t), None])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in hmm.score(documents, hmm.Settings(listed=2000)).collect()}
    gain = []
    for i, t in rows:
        ws, r = [*lower_words(t), None], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i) == 1, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-6 * len(ws)
        if r.held_out:
            gain.append((r.score - r.base_score) / len(ws))
    assert np.mean(gain) > 0.02


def test_words_have_the_same_symbols_and_rule_at_every_size(spark):  # noqa: ANN001
    texts = [" ".join(f"w{(i * k) % 97}x" for k in range(40)) + f" only{i} end" for i in range(40)]
    sizes = {}
    for times in (1, 30):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * times)], "doc_id long, text string")
        s = hmm.Settings(listed=50)
        counts = hmm.count_words(df, s.endings, s.parts)
        words, low = hmm.learn_words(counts, s)
        rows = hmm.encode(df.withColumn("held_out", F.lit(False)), words).where("doc_id < 40").collect()
        sizes[times] = {r.doc_id: r.symbols for r in rows}, words, {bytes(r.word) for r in counts.where(F.col("c") >= low).collect()}
    (one, few, listed), (many, all_, _) = sizes[1], sizes[30]
    assert few.size == all_.size and all(len(x) == 2 * 43 for x in one.values())
    classes = lambda rows, words: {i: np.argsort(np.r_[-1, words.symbol_of_class])[np.frombuffer(x, words.kind)].tolist() for i, x in rows.items()}
    assert classes(one, few) == classes(many, all_)  # symbols are numbered by mass, the classes behind them stay
    assert 0 < len(listed - {hmm.END}) <= 50  # rare words aren't listed, yet have their classes by the same rule
    by_class = lambda words: words.masses[words.symbol_of_class - 1] - 0.5
    assert np.allclose(by_class(all_), 30 * by_class(few) - 29 * 0.5 * _words_by_class(texts))


def _words_by_class(texts):  # noqa: ANN001, ANN202
    found = np.zeros(255 * 257)
    for w in {w for t in texts for w in t.encode().split()}:
        found[zlib.crc32(w[-3:]) % 255 * 257 + zlib.crc32(w) % 257] += 1
    return found


def test_probabilities_of_all_words_add_up(spark):  # noqa: ANN001
    """The scores of all one-word texts, and of all unseen words of each class at once, are a distribution of first words."""
    df = spark.createDataFrame([(i, f"a{i % 5} b{i % 7}") for i in range(60)], "doc_id long, text string")
    s = hmm.Settings(endings=3, parts=2)
    words, _ = hmm.learn_words(hmm.count_words(df, 3, 2), s)
    within = np.full(6, 0.5)
    for word, c in zip(words.words, words.counts, strict=True):
        within[words.symbol_of_class[hmm.class_of(word, 3, 2)] - 1] += c + 0.5
    assert np.allclose(within / words.masses, 1)


def test_language_model_bears_odd_rows(odd, none):  # noqa: ANN001
    got = hmm.score(odd).collect()
    assert len(got) == 18 and all(math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert hmm.score(none).count() == 0
    alone = hmm.score(odd.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")).collect()
    assert all(r.train_tokens == 0 and abs(r.base_score) < 1e-6 * r.n_tokens and math.isfinite(r.score) for r in alone)


# WARC

PAGES = "page_id long, url string, html string, digest string, first long"


def test_archives(spark):  # noqa: ANN001
    big, other = "<p>é" * 50, "<b>" + "x" * 200
    rows = [(5, "u", big), (2, None, big), (2, "u\r\nv", big), (9, "u", other), (None, "u", big), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (None, None, None), (7, "u", "y" * 300_000)]
    manifest = warc.write(spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES).repartition(2))
    got = sorted(((r.page_id or -1), r.payload_bytes, r.record_type, r.refers_to or -1) for r in warc.read(manifest).collect())
    expected = [(5, 250, "revisit", 2), (2, 250, "response", -1), (2, 250, "response", -1), (9, 203, "response", -1), (-1, 250, "revisit", 2), (1, 5, "response", -1), (3, 5, "response", -1), (4, 0, "response", -1), (-1, 0, "response", -1), (7, 300_000, "response", -1)]
    assert got == sorted(expected)
    for r in warc.read(manifest).where("record_type = 'response'").collect():
        assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
    first = manifest.first()
    from quaylens.llm.files import open_input

    with open_input(first.folder, first.file) as f:
        assert f.read(4) == (0x184D2A5D).to_bytes(4, "little")
    assert warc.read(warc.write(spark.createDataFrame([], PAGES))).count() == 0


# the pipeline


def cleaned(rows):  # noqa: ANN001, ANN201
    """doc_id and text after line dedup, by plain Python."""
    edges = " \t\x0b\x0c\r"
    sites, ids = defaultdict(set), defaultdict(list)
    for i, source, text in rows:
        for line in (text or "").split("\n"):
            if len(k := line.strip(edges)) >= 20:
                sites[k].add(source)
                ids[k].append(i)
    common = {k: min((i for i in ids[k] if i is not None), default=None) for k, s in sites.items() if len(s - {None}) >= 3}
    stays = lambda i, x: x.strip(edges) not in common or common[x.strip(edges)] == i
    return Counter((i, None if t is None else "\n".join(x for x in t.split("\n") if stays(i, x))) for i, _, t in rows)


def cut(rows):  # noqa: ANN001, ANN201
    """The pieces of documents, by the tokenizers library."""
    from quaylens.llm import tokens

    path, out = tokens.default_vocabulary(), Counter()
    for i, text in rows:
        ids = tokens.library_ids(path, text or "").tobytes() + (1).to_bytes(4, "little")
        n = len(ids) // 4
        out.update((i, s, min(2048, n - s), zlib.crc32(ids[4 * s : 4 * (s + 2048)]), n) for s in range(0, n, 2048))
    return out


def evidence(model, text):  # noqa: ANN001, ANN201
    from quaylens.llm import toxicity

    total = model.bias
    for word in {w.decode() for w in toxicity.words_of(text or "")}:
        total += sum(v for f, v in model.weights.items() if f == "=" + word or (f[0] != "=" and f in f"^{word}$"))
    return total


def check_stages(spark, folder, docs):  # noqa: ANN001, ANN201
    import corpus_pipeline as cp
    from quaylens.llm import quality, toxicity
    from quaylens.llm.common import materialise, read_table

    assert [n for n, _ in cp.STAGES] == ["quality_rules", "toxicity", "line_dedup", "ngram_jaccard", "packing"]
    given, made = [docs], []
    for name, stage in cp.STAGES:
        made.append(materialise(stage(spark, given[-1], folder), name))
        given.append(made[-1])
    assert all(d.schema == docs.schema for d in made[:4])
    texts = [Counter((r.doc_id, r.text) for r in d.collect()) for d in made[:4]]
    wanted = Counter((r.doc_id, r.text) for r in docs.collect())
    kept = quality.assess(docs.select("doc_id", "text")).where("kept")
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in made[0].collect()) and texts[0] <= wanted
    model = toxicity.fit(made[0], read_table(spark, folder, "labels"))
    assert texts[1] == Counter({k: n for k, n in texts[0].items() if evidence(model, k[1]) < 0})
    assert texts[2] == cleaned([(r.doc_id, r.source, r.text) for r in made[1].collect()])
    known = [(r.doc_id, r.text) for r in made[2].collect() if r.doc_id is not None]
    assert {i for i, _ in texts[3] if i is not None} == set(brute(known, 5, 80).values()) and texts[3] <= texts[2]
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in made[4].collect()) == cut([(r.doc_id, r.text) for r in made[3].collect()])
    assert made[4].count() == cp.run(spark, folder).count()
    return texts


def test_pipeline_stage_by_stage(spark, data, documents):  # noqa: ANN001
    texts = check_stages(spark, data, documents)
    assert sum(texts[0].values()) > sum(texts[3].values()) > 0


def test_pipeline_on_odd_and_empty_tables(spark, odd, none, labels, tmp_path):  # noqa: ANN001
    for name, df in (("odd", odd), ("none", none)):
        folder = str(tmp_path / name)
        df.write.parquet(f"{folder}/documents.parquet")
        labels.limit(0 if name == "none" else 1000).write.parquet(f"{folder}/labels.parquet")
        texts = check_stages(spark, folder, spark.read.parquet(f"{folder}/documents.parquet"))
        assert bool(texts[3]) == (name == "odd")


def test_every_query_runs_on_whole_tables(spark, data):  # noqa: ANN001
    from quaylens.llm.queries import QUERIES

    n = spark.read.parquet(f"{data}/documents.parquet").count()
    assert QUERIES["op3_quality"](spark, data).count() == QUERIES["op10_line_dedup"](spark, data).count() == n
    assert QUERIES["op1_toxicity"](spark, data).agg(F.countDistinct("doc_id")).first()[0] == n


def test_near_copies_with_maps_and_repeated_ids(spark):  # noqa: ANN001
    rows = [(1, "b", {"x": 1}), (1, "a", {"y": 2}), (1, "a", {"x": 3}), (2, "other", None), (None, "a", {}), (None, "a", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>")
    got = ngram_join.keep_one(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "a"), (0, "a"), (1, "a"), (2, "other")]
    assert [r.more for r in got if r.doc_id == 1] == [{"x": 3}]
