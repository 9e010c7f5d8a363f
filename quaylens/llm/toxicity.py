"""Toxicity by a counterfactually regularised classifier.

A logistic model over words and pieces of words. Besides the usual loss it pays for every identity term of a labelled
sentence: the term is swapped for each other term of its group, and the squared change of the sentence's score is
added to the loss. A neutral mention of a group then can't push a text over the line by itself.

A text's evidence is the sum, over its distinct lower-cased words, of the non-negative weights of their features; so a
text of any length is scored whole, and harmless words can't outvote toxic ones.

Cases: a null or empty text has no evidence and gets the score of the bias alone. Labels that are null, or whose id is
null, teach nothing; several labels of one id count as toxic if any does. A repeated doc_id is scored row by row. Without
toxic or without other labels there is nothing to learn: every text then gets the smoothed share of toxic labels. Equal
texts get equal scores. `score` keeps extra columns (its own replaces one named score), `reject_toxic` that one too. An
empty table gives an empty result.

Where no labelled sentence holds an identity term, no swap is made and the extra term is zero: `Model.swapped` says how many
sentences were swapped.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylens.llm.common import crc_fold, fresh, text_blocks, texts_of

#: Terms that name groups of people, in English, French, German and Spanish; terms of one group may replace one another.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("woman", "man"),
    ("women", "men"),
    ("female", "male"),
    ("immigrant", "immigrants", "refugee", "refugees", "foreigner", "foreigners"),
    ("deaf", "blind", "disabled"),
    ("old", "young", "elderly"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noir", "blanc", "asiatique", "arabe", "africain", "européen"),
    ("homosexuel", "hétérosexuel", "bisexuel", "transgenre"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("immigré", "réfugié", "étranger"),
    ("immigrés", "réfugiés", "étrangers"),
    ("sourd", "aveugle", "handicapé"),
    ("muslim", "christ", "jude", "hindu", "buddhist", "atheist"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarzer", "weißer", "asiate", "araber", "afrikaner", "europäer"),
    ("schwul", "lesbisch", "bisexuell", "heterosexuell"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("einwanderer", "flüchtling", "ausländer"),
    ("gehörlos", "blind", "behindert"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negro", "blanco", "asiático", "árabe", "africano", "europeo"),
    ("homosexual", "heterosexual", "bisexual", "transgénero"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
    ("inmigrante", "refugiado", "extranjero"),
    ("inmigrantes", "refugiados", "extranjeros"),
    ("sordo", "ciego", "discapacitado"),
)
#: ASCII characters other than letters, digits and the underscore part words
_PARTS = bytes(b if b >= 128 or chr(b).isalnum() or b == 95 else 32 for b in range(256))
#: and so do white space and punctuation beyond ASCII
_WIDE = re.compile("[" + "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isspace() or unicodedata.category(c)[0] in "PZ") + "\u200b]")
#: longer words are not kept in caches
_CACHED = 64
_SENTENCE = re.compile(r"[.!?\n]+")


@dataclass(frozen=True)
class Settings:
    """`toxic_rows` and `other_rows` bound the labelled rows that the fit looks at (about so many, drawn by a hash of the id)."""

    toxic_rows: int = 3_000
    other_rows: int = 5_000
    features: int = 4_096
    least_texts: int = 4
    least_z: float = 3.0
    ridge: float = 2e-4
    counterfactual: float = 1.0
    steps: int = 400
    groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    #: swapped sentences that the fit held against their originals
    swapped: int = 0

    def evidence(self, word: bytes) -> float:
        return sum(self.weights[f] for f in set(filter(self.weights.__contains__, pieces(word))))


def words_of(text: str) -> set[bytes]:
    text = text.lower()
    if not text.isascii():
        text = _WIDE.sub(" ", text)
    return set(text.encode("utf-8", "replace").translate(_PARTS).split())


def pieces(coded: bytes) -> Iterator[str]:
    """The word, and its pieces of four and five characters, with marks for its ends; some may come repeatedly."""
    word = coded.decode("utf-8", "replace")
    yield "=" + word
    marked = f"^{word}$"
    for n in (4, 5):
        for i in range(len(marked) - n + 1):
            yield marked[i : i + n]


def features(coded: bytes) -> set[str]:
    return set(pieces(coded))


def swaps(text: str, groups: tuple[tuple[str, ...], ...]) -> Counter[tuple[str, str]]:
    """How often the sentences of a text hold an identity term, with each term that could stand there instead."""
    partner: dict[bytes, set[str]] = {}
    for group in groups:
        for term in group:
            partner.setdefault(term.encode(), set()).update(group)
    found: Counter[tuple[str, str]] = Counter()
    lowered = text.lower()
    if not words_of(lowered) & partner.keys():
        return found
    for sentence in _SENTENCE.split(lowered):
        for term in words_of(sentence) & partner.keys():
            found.update((term.decode(), other) for other in partner[term] if other != term.decode())
    return found


def fit_weights(rows: list[np.ndarray], toxic: np.ndarray, n_features: int, pairs: list[tuple[np.ndarray, np.ndarray, float]], s: Settings) -> tuple[float, np.ndarray]:
    """Projected Adam on: log loss + ridge + counterfactual * mean squared change over swapped pairs. rows: the feature numbers of each text, with repeats."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows).astype(np.int64) if len(owner) else np.zeros(0, np.int64)
    share = max(1, int(toxic.sum())) / len(rows)
    bias, w = float(np.log(share / max(1e-9, 1 - share))), np.full(n_features, 0.05)
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    total = sum(c for *_, c in pairs) or 1.0
    for step in range(1, s.steps + 1):
        z = bias + np.bincount(owner, weights=w[column], minlength=len(rows))
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) / len(rows)
        g = np.append(np.bincount(column, weights=d[owner], minlength=n_features) + 2 * s.ridge * w, d.sum())
        for here, there, count in pairs:
            change = 2 * s.counterfactual * count / total * (w[here].sum() - w[there].sum())
            np.add.at(g, here, change)
            np.add.at(g, there, -change)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = np.maximum(0.0, w - move[:-1]), bias - move[-1]
    return bias, w


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Learns from the labelled rows whose crc32(doc_id) mod 5 isn't 0: a bounded sample of them picks the features and fits the weights."""
    s = settings or Settings()
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).where(crc_fold(F.col("doc_id")) != 0)
    n_toxic, n_all = known.agg(F.count_if("toxic"), F.count("*")).first()
    n_other = n_all - n_toxic
    if not n_toxic or not n_other:
        return Model(float(np.log((n_toxic + 0.5) / (n_other + 0.5))))
    # the bound makes this small enough to broadcast: a million hash values, of which a share is drawn
    rate = F.when(F.col("toxic"), min(1.0, s.toxic_rows / n_toxic)).otherwise(min(1.0, s.other_rows / n_other))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < rate * 1_000_000)
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yes: Counter[str] = Counter()
        no: Counter[str] = Counter()
        pairs: Counter[tuple[str, str]] = Counter()
        texts = [0, 0]
        cache: dict[bytes, set[str]] = {}
        for block in text_blocks(batches):
            for text, toxic in zip(texts_of(block), block.column("toxic").to_pylist(), strict=True):
                words = words_of(text)
                for word in words - cache.keys():
                    if len(word) <= _CACHED:
                        cache[word] = features(word)
                (yes if toxic else no).update(set().union(*(cache[w] if w in cache else pieces(w) for w in words)))
                texts[toxic] += 1
                pairs.update(swaps(text, s.groups))
            if len(cache) > 200_000:
                cache.clear()
        names = list(yes.keys() | no.keys())
        rows = [("", "", *texts), *((f, "", no[f], yes[f]) for f in names), *((a, b, n, 0) for (a, b), n in pairs.items())]
        for i in range(0, len(rows), 50_000):
            part = rows[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["feature", "instead", "other", "toxic"])

    counts = sample.mapInArrow(count, "feature string, instead string, other long, toxic long").groupBy("feature", "instead").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    counts = counts.persist()
    try:
        size = counts.where("feature = '' and instead = ''").first()
        if size is None or not size.toxic or not size.other:
            return Model(float(np.log((n_toxic + 0.5) / (n_other + 0.5))))
        odds = F.log((F.col("toxic") + 0.5) / (size.toxic + 1)) - F.log((F.col("other") + 0.5) / (size.other + 1))
        z = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
        picked = counts.where((F.col("feature") != "") & (F.col("instead") == "") & (F.col("toxic") >= s.least_texts)).withColumn("z", z).where(F.col("z") >= s.least_z)
        names = [r.feature for r in picked.orderBy(F.desc("z"), "feature").limit(s.features).collect()]
        swapped = [(r.feature, r.instead, float(r.other)) for r in counts.where("instead <> ''").collect()]  # at most the pairs of the groups
    finally:
        counts.unpersist()
    if not names:
        return Model(float(np.log((n_toxic + 0.5) / (n_other + 0.5))))
    number = {f: i for i, f in enumerate(names)}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            rows = [[number[f] for w in words_of(t) for f in features(w) if f in number] for t in texts_of(block)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), block.column("toxic")], names=["features", "toxic"])

    table = sample.mapInArrow(index, "features array<int>, toxic boolean").toArrow()  # bounded by the sample and the number of features
    rows = [np.array(r, dtype=np.int64) for r in table.column("features").to_pylist()]
    toxic = np.array(table.column("toxic").to_pylist(), dtype=np.float64)
    of = lambda term: np.array([number[f] for f in features(term.encode()) if f in number], dtype=np.int64)
    bias, w = fit_weights(rows, toxic, len(names), [(of(a), of(b), n) for a, b, n in swapped], s)
    # the sample holds more toxic texts than the labels do; back to their share
    bias += float(np.log(n_toxic / n_other) - np.log(toxic.sum() / (len(toxic) - toxic.sum())))
    return Model(bias, {f: float(x) for f, x in zip(names, w, strict=True) if x > 1e-6}, int(sum(n for *_, n in swapped)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with a column `score`: the probability that a text is toxic. Needs the column text; keeps all others."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "score"]
    schema = docs.select(*kept).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = handle.value

        class Evidence(dict):
            def __missing__(self, word: bytes) -> float:
                value = m.evidence(word)
                if len(word) <= _CACHED:
                    self[word] = value
                return value

        cache = Evidence()
        for block in text_blocks(batches):
            if len(cache) > 400_000:
                cache.clear()
            z = np.array([sum(map(cache.__getitem__, words_of(t))) for t in texts_of(block)], dtype=np.float64) + m.bias
            scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(scores)], names=[*block.schema.names, "score"])

    return docs.select(*kept).mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, settings: Settings | None = None) -> DataFrame:
    """The rows of `docs` that score below the threshold, with their own columns."""
    held = {c: fresh("own_score", docs) for c in docs.columns if c == "score"}
    scored = score(docs.withColumnsRenamed(held), fit(docs, labels, settings)).where(F.col("score") < threshold).drop("score")
    return scored.withColumnsRenamed({new: old for old, new in held.items()}).select(*docs.columns)
