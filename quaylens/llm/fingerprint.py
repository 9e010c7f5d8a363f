"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is a set of words, each with the number of its occurrences as weight. For every word and sample number, hashes give
two Gamma(2, 1) values r and c and a uniform b; with t = floor(ln(weight) / r + b), the word's bid in that sample is
c * exp(-r * (t - b + 1)). The sample is the lowest bid, of which 31 bits of a hash are kept. Words and weights fix the bids, so two texts share a sample with a
probability equal to their generalised Jaccard similarity, the sum of the lesser weights over the sum of the greater; the
share of equal samples estimates it, with a standard error of at most half the root of 1 / samples.

Words are runs of characters other than space and U+0009 to U+000D, as they are written.

Cases: a null text counts as empty. An empty text has no words; its samples are all a fixed value, so empty texts are equal
to one another and to nothing else. Rows that repeat a doc_id and its text are one document, whose row appears as often as
they do; rows that repeat a doc_id with other texts are documents of their own, in the order of their texts' hashes. Rows
without a doc_id come first. Texts of any length are sampled whole: a long text is more rows, not a longer one. Equal bids give
equal samples. Extra columns aren't read. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylens.llm.common import WORD_GAP, materialise

SAMPLES, BLOCK = 32, 4
#: What tells documents apart: the id (NO_ID for null, which sorts first) and a hash of the text
KEY, NO_ID = ["_id", "_hash"], -(1 << 63)


def _unit(bits: Column, shift: int, width: int) -> Column:
    """`width` bits of a hash as a number in (0, 1)."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(0.5)) * F.lit(1.0 / (1 << width))


def draws(word: Column, sample: Column) -> tuple[Column, Column, Column]:
    """r, c and b of a word (by its hash) in a sample."""
    first = F.xxhash64(word, sample)
    second = F.xxhash64(first, F.lit(1))
    r = -F.ln(_unit(first, 0, 24) * _unit(first, 24, 24))
    c = -F.ln(_unit(second, 0, 32) * _unit(second, 32, 32))
    return r, c, _unit(first, 48, 16)


def bid(r: Column, c: Column, b: Column, log_weight: Column) -> Column:
    """The bid of a word of a weight; null if the weight's logarithm is."""
    return c * F.exp(-r * (F.floor(log_weight / r + b) - b + F.lit(1.0)))


def signatures(words: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """KEY, and the `samples` lowest bids for the weights `held` and `held_edited`. words: KEY, word (a hash) and both weights, one row per word.

    A row for each word and block of samples; an aggregate of lowest bids for each document and block. Blocks are small, so
    that the code generated for a row stays short enough to be compiled.
    """
    j_all, weights = range(BLOCK), ["held", "held_edited"]
    rows = words.select(*KEY, "word", *weights, *[F.ln(F.col(w).cast("double")).alias(f"log_{w}") for w in weights])
    rows = rows.withColumn("_block", F.explode(F.lit(list(range(0, samples, BLOCK)))))
    drawn = {f"{name}{j}": value for j in j_all for name, value in zip("rcb", draws(F.col("word"), F.col("_block") + F.lit(j)), strict=True)}
    rows = rows.select(*KEY, "_block", *weights, "log_held", "log_held_edited", *[v.alias(k) for k, v in drawn.items()])
    of = lambda j, weight: bid(F.col(f"r{j}"), F.col(f"c{j}"), F.col(f"b{j}"), F.col(weight))
    rows = rows.select("*", *[of(j, "log_held").alias(f"held_{j}") for j in j_all])
    # most words weigh the same in both texts
    rows = rows.select(*KEY, "_block", *[f"held_{j}" for j in j_all], *[F.when(F.col("held") == F.col("held_edited"), F.col(f"held_{j}")).otherwise(of(j, "log_held_edited")).alias(f"held_edited_{j}") for j in j_all])
    per_block = rows.groupBy(*KEY, "_block").agg(*[F.min(f"{w}_{j}").alias(f"{w}_{j}") for w in weights for j in j_all])
    gathered = per_block.groupBy(*KEY).agg(*[F.array_sort(F.collect_list(F.struct("_block", F.array(*[f"{w}_{j}" for j in j_all]).alias("v")))).alias(w) for w in weights])
    return gathered.select(*KEY, *[F.flatten(F.transform(w, lambda x: x["v"])).alias(name) for w, name in (("held", "_samples"), ("held_edited", "_edited_samples"))])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.lit(float(samples))


def as_text(samples: Column) -> Column:
    """Eight hexadecimal digits of each sample."""
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def next_documents(keys: DataFrame) -> DataFrame:
    """KEY, next_id, next_hash for each distinct KEY, in ascending order; the last one's next is the first.

    Keys are dealt out by range; the order within a part is a window over that part, and the parts' first keys, one each,
    close the gaps between them.
    """
    parts = materialise(keys.distinct().repartitionByRange(*KEY).withColumn("_part", F.spark_partition_id()), "ordered-keys")
    within = Window.partitionBy("_part").orderBy(*KEY)
    here = parts.select(*KEY, "_part", F.lead(F.struct(*KEY)).over(within).alias("_next"))
    by_part = Window.orderBy("_part")
    firsts = parts.groupBy("_part").agg(F.min(F.struct(*KEY)).alias("_first"))  # a row for each part
    firsts = firsts.select("_part", F.coalesce(F.lead("_first").over(by_part), F.min("_first").over(Window.partitionBy())).alias("_after"))
    found = here.join(F.broadcast(firsts), "_part").withColumn("_next", F.coalesce("_next", "_after"))
    return found.select(*KEY, F.col("_next._id").alias("next_id"), F.col("_next._hash").alias("next_hash"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last quarter of code points replaced by the first as many of the next document.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("_id", F.xxhash64("text").alias("_hash"), "text")
    sizes = materialise(texts.groupBy(*KEY).agg(F.max(F.char_length("text")).alias("n_chars"), F.count("*").alias("_copies")), "text-sizes")
    wanted = materialise(next_documents(sizes.select(*KEY)).join(sizes, KEY), "next-documents")

    # dealt out by key once; the exchange serves as the side that lends, and as the side that borrows
    once = texts.repartition(*KEY) if wanted.where("_copies > 1").isEmpty() else texts.repartition(*KEY).dropDuplicates(KEY)
    lent = once.withColumnsRenamed({"_id": "next_id", "_hash": "next_hash"}).join(wanted, ["next_id", "next_hash"])
    lent = lent.select(*KEY, "n_chars", F.substring("text", F.lit(1), F.floor(F.col("n_chars") / 4).cast("int")).alias("_lent"))
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    both = once.join(lent, KEY).select(*KEY, "text", F.concat(F.substring("text", F.lit(1), kept), "_lent").alias("_edited"))

    # a row for each word of the text and of the edited text; the join has put a document's rows in one place, where they are counted
    parts = F.explode(F.array(F.struct(F.lit(1).alias("own"), F.col("text").alias("t")), F.struct(F.lit(0).alias("own"), F.col("_edited").alias("t"))))
    spoken = both.select(*KEY, parts.alias("v")).select(*KEY, "v.own", F.explode(F.split("v.t", WORD_GAP)).alias("w")).where("w <> ''")
    words = spoken.select(*KEY, "own", F.xxhash64("w").alias("word")).groupBy(*KEY, "word").agg(F.sum("own").alias("held"), F.sum(1 - F.col("own")).alias("held_edited"))
    signed = signatures(words, samples)
    digests = both.select(*KEY, F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"))
    none = F.array_repeat(F.lit(-1.0), samples)
    short = lambda c: F.transform(F.coalesce(c, none), lambda x: F.xxhash64(F.coalesce(x, F.lit(-1.0))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias(c)
    signed = digests.join(signed, KEY, "left").select(*KEY, "edited_sha256", short("_samples"), short("_edited_samples"))
    signed = materialise(signed, "signatures")

    following = signed.select(F.col("_id").alias("next_id"), F.col("_hash").alias("next_hash"), F.col("_samples").alias("_next_samples"))
    out = wanted.join(signed, KEY).join(following, ["next_id", "next_hash"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    kind = docs.schema["doc_id"].dataType
    return out.select(
        F.when(F.col("_id") != NO_ID, F.col("_id")).cast(kind).alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("_samples")).alias("fingerprint"),
        as_text(F.col("_edited_samples")).alias("edited_fingerprint"),
        likeness(F.col("_samples"), F.col("_edited_samples"), samples).alias("near_edited"),
        likeness(F.col("_samples"), F.col("_next_samples"), samples).alias("near_next"),
    )
