"""Line dedup by distinct-site spread, in DataFrame functions only.

One pass over the texts gives the hashes of each document's lines. A HyperLogLog sketch of the sites that a line occurs on
is built per hash and merged by aggregation; lines whose estimate is near the threshold get an exact distinct count. A line
on enough sites is boilerplate: it stays in the document with the smallest id that has it, and leaves all others.

A site is a value of `source`. Lines are what lies between newlines, without the white space around them; short ones are
never boilerplate.

Cases: a null or empty text has no lines and stays as it is; texts and lines of any length are read whole. A null source is
no site. Rows that repeat a doc_id are cleaned by their own lines, all by the same rule; documents without an id come after
all others in the choice of the one that keeps a line, and share that place among themselves. A document that loses every
line stays, with an empty text. Ties don't arise: a line has one smallest id. Other columns stay as they are, whatever their
names; where `docs` has columns n_lines or n_removed, `clean` gives its own numbers in their place, `clean_documents` leaves
them. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylens.llm.common import DROP_SHUFFLES, SPLIT_JOINS, fresh, materialise, session_settings, small


@dataclass(frozen=True)
class Settings:
    least_sites: int = 3
    least_chars: int = 20
    #: log2 of the sketch's registers; estimates within `near` of the threshold, or within a fifth of it, are counted exactly
    sketch_bits: int = 8
    near: float = 1.5


_EDGES = "\x20\x09\x0b\x0c\x0d"


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(_EDGES))


def _hash(line: Column) -> Column:
    return F.xxhash64(_trimmed(line))


def _parts(text: Column) -> Column:
    return F.split(text, "\n")


def lines_of(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, text_hash, source, line_hash: the lines of each document that are long enough, each once."""
    long_enough = F.filter(_parts(F.col("text")), lambda line: F.char_length(_trimmed(line)) >= s.least_chars)
    hashes = F.array_distinct(F.transform(long_enough, _hash))
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", F.explode(hashes).alias("line_hash"))


def boilerplate(lines: DataFrame, s: Settings) -> DataFrame:
    """line_hash, sites, owner: lines on at least `least_sites` sites, and the smallest doc_id that has each. lines: doc_id, source, line_hash."""
    margin = max(s.near, 0.2 * s.least_sites)
    sketched = lines.groupBy("line_hash").agg(F.hll_sketch_agg("source", s.sketch_bits).alias("sketch"), F.min("doc_id").alias("owner"))
    guessed = sketched.select("line_hash", F.hll_sketch_estimate("sketch").alias("sites"), "owner").where(F.col("sites") >= s.least_sites - margin)
    guessed = materialise(guessed, "line-spread")
    sure = F.col("sites") > s.least_sites + margin
    near = lines.where(F.col("source").isNotNull()).join(small(guessed).where(~sure).select("line_hash", "owner"), "line_hash")
    near = near.select("line_hash", "owner", "source").distinct()  # a row for each line and site
    counted = near.groupBy("line_hash", "owner").agg(F.count("*").alias("sites")).where(F.col("sites") >= s.least_sites)
    return counted.select("line_hash", "sites", "owner").unionByName(guessed.where(sure))


def clean(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """All rows and columns of `docs` with boilerplate lines taken out of `text`, and with n_lines and n_removed."""
    s = settings or Settings()
    with session_settings(docs.sparkSession, SPLIT_JOINS | DROP_SHUFFLES):
        lines = materialise(lines_of(docs, s), "lines")
        common = materialise(boilerplate(lines, s), "line-boilerplate")
        hits = lines.join(small(common).select("line_hash", "owner"), "line_hash").where(~F.col("doc_id").eqNullSafe(F.col("owner")))
        gone = materialise(hits.groupBy("doc_id", "text_hash").agg(F.collect_set("line_hash").alias("gone")), "line-hits")
    doc, of, taken, kept = (fresh(c, docs) for c in ("doc", "of", "gone", "kept"))
    gone = gone.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(of), F.col("gone").alias(taken))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(of)), "left")
    changed = F.col(taken).isNotNull()
    stays = F.filter(_parts(F.col("text")), lambda line: ~F.array_contains(F.col(taken), _hash(line)) | (F.char_length(_trimmed(line)) < s.least_chars))
    out = joined.withColumn(kept, F.when(changed, stays))
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size(_parts(F.col("text")))), F.lit(0)).cast("long")
    n_removed = F.when(changed, n_lines - F.size(kept)).otherwise(F.lit(0)).cast("long")
    text = F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("text"))
    own = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*own, n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def clean_documents(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """`docs` with cleaned texts and their lengths, with its own columns."""
    held = {c: fresh(f"own_{c}", docs) for c in ("n_lines", "n_removed") if c in docs.columns}
    out = clean(docs.withColumnsRenamed(held), settings)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop("n_lines", "n_removed").withColumnsRenamed({new: old for old, new in held.items()}).select(*docs.columns)
