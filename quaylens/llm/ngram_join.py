"""Exact Jaccard join of n-gram sets by vertical partitioning.

The global order of all n-grams (by 64-bit hash) is cut into fragments. The first fragment, the lowest `band` share of the
order, finds candidates; for these, the overlap is counted in each fragment separately and summed per pair.

1. Sets. Each text becomes its set of n-gram hashes; equal sets are one node, named by a hash of the set.
2. The first fragment counts each n-gram. A node with more n-grams that nobody else has than the threshold lets it miss
   links with nothing and is done; in ordinary text that is nearly every node.
3. The others put their first-fragment n-grams in the order rarest first (any order of n-grams gives right results, this
   one gives few candidates) and keep as many as two linked sets must share one of. Nodes that share one are candidates,
   if their sizes and the places of the shared n-gram allow a link.
4. A group of candidates doesn't become all its pairs. First each member is held against one member, the one with the
   fewest n-grams of its own; large groups of near copies join there. Then the groups of up to 256 members that are still
   in more than one component are gone through as in step 5. Members of larger groups that are in several components even
   then put all their n-grams in order, rarest among them first, and are grouped anew by the first of these, for step 5.
5. Members of a group are held against pivots: about 16 of its members, then 256, and so on up to all of them. Only
   pairs of different components are made, of these only pairs whose parities allow a link (each fragment is dealt to 64
   buckets; a bucket whose n-grams are odd in number in one set and even in the other holds at least one n-gram that the
   sets don't share, so such buckets count at most the n-grams on which the sets differ), and of two components' pairs the likeliest is counted first, the others at
   the end, where they are still needed. Linked members join between rounds; one that links with a share s of its group
   meets about 1 / s pivots before it joins, so a round makes a few pairs a member, however large the group.

Nothing is capped: steps 2 to 5 drop only pairs that can't reach the threshold or whose texts are already known to be
linked, so no component is lost.

Cases: a null, empty or blank text has an empty set and links with nothing. A text with fewer than n words is one n-gram,
its whole sequence. Rows that repeat a doc_id are one document for the result (their texts' components count as one). A
null doc_id is kept as such. Extra columns aren't read. Ties don't matter: a component is named by its smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylens.llm.common import DROP_SHUFFLES, SPLIT_JOINS, block_words, fresh, materialise, scratch, semi_join, session_settings, small, text_blocks
from quaylens.llm.components import smallest_reachable

FRAGMENTS, PIVOT_STEP, SMALL_GROUP = 8, 16, 256
#: bytes of a work table that a task reads at a time
SMALL_PARTS = {"spark.sql.files.maxPartitionBytes": "4m"}
_B, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = value
        return value


@lru_cache(maxsize=1)
def _word_hashes() -> _WordHashes:
    return _WordHashes()


def gram_sets(block: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """The distinct n-gram hashes of each text of a block, ascending."""
    words, edges = block_words(block)
    coded, cache = words.dictionary_encode(), _word_hashes()
    distinct = np.fromiter(map(cache.__getitem__, coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    h = distinct[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    rolled = np.full(max(0, len(h) - n + 1), n, dtype=np.uint64)  # over the whole block; windows across two texts aren't used
    for j in range(n):
        rolled = _mix(rolled * _B + h[j : j + len(rolled)])
    out = []
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if 0 < end - start < n:
            whole = np.full(1, end - start, dtype=np.uint64)
            for x in h[start:end]:
                whole = _mix(whole * _B + x)
            out.append(whole)
        else:
            out.append(np.unique(rolled[start : max(start, end - n + 1)]))
    return out


def _names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set that don't depend on an order."""
    first = np.array([_mix(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], dtype=np.uint64)
    second = np.array([_mix(s ^ _B).sum(dtype=np.uint64) if len(s) else 0 for s in sets], dtype=np.uint64)
    size = np.array([len(s) for s in sets], dtype=np.uint64)
    return _mix(first + size).view(np.int64), _mix(second ^ size).view(np.int64)


def document_sets(docs: DataFrame, n: int, share: int, band: float) -> DataFrame:
    """doc_id, n_grams, node, check, grams: the size of each document's set, two hashes that name it, and its n-grams of the first fragment.

    n-grams are ascending; a set with fewer of them in the fragment than two linked sets must share one of gives as many as those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = _band_limit(band)
        for block in text_blocks(batches):
            sets = gram_sets(block, n)
            node, check = _names(sets)
            size = np.array([len(s) for s in sets], dtype=np.int64)
            taken = np.maximum([np.searchsorted(s, limit) for s in sets], np.minimum(size, size - -(-share * size // 100) + 1))
            grams = _lists([s[:t] for s, t in zip(sets, taken, strict=True)])
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(size), pa.array(node), pa.array(check), grams], names=["doc_id", "n_grams", "node", "check", "grams"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_grams long, node long, check long, grams array<long>")


def _band_limit(band: float) -> np.uint64:
    return np.uint64(min(2**64 - 1, int(band * 2**64)))


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as signed longs in the same order."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(np.concatenate(parts)) if parts else np.zeros(0, np.int64)))


def _named_apart(sets: DataFrame) -> DataFrame:
    """`sets` with a node for each pair of node and check; where two sets share a node, all are named anew by both."""
    while not sets.where("n_grams > 0").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").isEmpty():
        sets = materialise(sets.withColumn("node", F.xxhash64("node", "check")), "gram-sets")
    return sets


def _first_fragment_counts(sets: DataFrame, band: float) -> DataFrame:
    """owner, gram, uses: for an n-gram of the first fragment that one node alone has, that node; for any other, the n-gram and in how many texts it is."""
    limit = int(_signed(np.array([_band_limit(band)]))[0])
    rows = sets.select("node", F.explode("grams").alias("gram")).where(F.col("gram") < limit)
    counted = rows.groupBy("gram").agg(F.count("*").alias("uses"), F.min("node").alias("low"), F.max("node").alias("high"))
    alone = F.col("low") == F.col("high")
    return counted.select(F.when(alone, F.col("low")).alias("owner"), *[F.when(~alone, F.col(c)).alias(c) for c in ("gram", "uses")])


def _segments(docs: DataFrame, n: int) -> DataFrame:
    """node, fragment, grams, parity: each set cut into the fragments of the global order. A text whose set hasn't the given check gives nothing.

    A parity has a bit for each of 64 buckets, which says whether an odd number of the fragment's n-grams fall into it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64(2**64 // FRAGMENTS)).astype(np.uint64)
        for block in text_blocks(batches):
            sets = gram_sets(block, n)
            fits = np.flatnonzero(_names(sets)[1] == block.column("check").to_numpy())
            parts = [p for i in fits for p in np.split(sets[i], np.searchsorted(sets[i], edges))]
            owner = block.column("node").take(pa.array(np.repeat(fits, FRAGMENTS)))
            bits = np.uint64(1) << (np.concatenate([np.zeros(0, np.uint64), *parts]) & np.uint64(63))
            upto, ends = np.r_[np.uint64(0), np.bitwise_xor.accumulate(bits)], np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
            parity = pa.array((upto[ends[1:]] ^ upto[ends[:-1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays([owner, pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(fits))), _lists(parts), parity], names=["node", "fragment", "grams", "parity"])

    return docs.select("node", "check", "text").mapInArrow(run, "node long, fragment int, grams array<long>, parity long")


def _least_overlap(x: str, y: str, share: int) -> str:
    """The smallest overlap of two sets of so many n-grams that reaches the share: o / (x + y - o) >= share / 100, in integers."""
    return f"(({share}L * ({x} + {y}) + {100 + share - 1}L) div {100 + share}L)"


def _possible(share: int) -> str:
    """Whether x and y, by their sizes, the n-grams that are theirs alone and the places of a shared one, can reach the share."""
    need = _least_overlap("x.n_grams", "y.n_grams", share)
    return (
        f"100L * least(x.n_grams, y.n_grams) >= {share}L * greatest(x.n_grams, y.n_grams)"
        f" and least(x.n_grams - x.own, y.n_grams - y.own) >= {need}"
        f" and least(x.n_grams - x.place, y.n_grams - y.place) >= {need}"
    )


def _with_parities(members: DataFrame, segments: DataFrame) -> DataFrame:
    """`members` with size and turn, and with the parities p0 to p7 of each node."""
    parities = segments.groupBy("node").agg(*[F.max(F.when(F.col("fragment") == j, F.col("parity"))).alias(f"p{j}") for j in range(FRAGMENTS)])
    turn = F.shiftrightunsigned(F.xxhash64("node", "gram"), 11) / F.lit(float(1 << 53))
    return members.join(parities, "node").withColumn("turn", turn)


def _sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("gram").agg(F.count("*").alias("size")).where("size > 1")


def _pairs(rows: DataFrame, *more: Column) -> DataFrame:
    """From x joined with y to a, b (the smaller node first) and their sizes."""
    turned = F.expr("x.node < y.node")
    sides = [F.when(turned, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")).alias(name) for c, name in (("node", "a"), ("n_grams", "size_a"))]
    sides += [F.when(turned, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(name) for c, name in (("node", "b"), ("n_grams", "size_b"))]
    return rows.select(*sides, *more).distinct()


def _links(pairs: DataFrame, segments: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) that reach the share, each once however often it is given. Overlaps are counted per fragment and summed per pair."""
    pairs = materialise(pairs.select("a", "b", "size_a", "size_b").distinct(), "linked-pairs")
    nodes = pairs.select(F.col("a").alias("_n")).unionByName(pairs.select(F.col("b").alias("_n"))).distinct()
    needed = segments.join(small(materialise(nodes, "linked-nodes")), F.col("node") == F.col("_n"), "left_semi")
    left, right = (needed.select(F.col("node").alias(k), "fragment", F.col("grams").alias(f"grams_{k}")) for k in "ab")
    counted = pairs.join(left, "a").join(right, ["b", "fragment"])
    counted = counted.select("a", "b", "size_a", "size_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("part"))
    summed = counted.groupBy("a", "b", "size_a", "size_b").agg(F.sum("part").alias("overlap"))
    return summed.where(f"overlap >= {_least_overlap('size_a', 'size_b', share)}").select("a", "b")


def _prefixes(grams: DataFrame, share: int) -> DataFrame:
    """The first n-grams of each node, as many as two linked sets must share one of; `grams` needs node, n_grams, own, gram, uses and late."""
    place = F.row_number().over(Window.partitionBy("node").orderBy("late", "uses", "gram")) - 1 + F.col("own")
    return grams.withColumn("place", place).where(f"place <= {_missing(share)}").select("gram", "node", "n_grams", "own", "place")


def _missing(share: int) -> str:
    """How many n-grams that a linked set lacks a set can have."""
    return f"(n_grams - (({share}L * n_grams + 99L) div 100L))"


def _relabel(label: DataFrame, links: DataFrame) -> DataFrame:
    """`label` (node, label) after the components of linked nodes have been joined."""
    x, y = (small(label.select(F.col("node").alias(k), F.col("label").alias(f"label_{k}"))) for k in "ab")
    met = links.join(x, "a").join(y, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).where("a <> b")
    merged = smallest_reachable(met).select(F.col("node").alias("label"), F.col("label").alias("_to"))
    return materialise(label.join(merged, "label", "left").select("node", F.coalesce("_to", "label").alias("label")), "node-labels")


def _star_links(prefix: DataFrame, segments: DataFrame, share: int) -> DataFrame:
    """Links of each group's members with the member that has the fewest n-grams of its own."""
    centre = prefix.groupBy("gram").agg(F.min(F.struct("own", "node", "n_grams", "place")).alias("c"), F.count("*").alias("size")).where("size > 1").select("gram", "c.*")
    rows = prefix.alias("x").join(centre.alias("y"), F.expr(f"x.gram = y.gram and x.node <> y.node and {_possible(share)}"))
    return _links(materialise(_pairs(rows), "star-pairs"), segments, share)


def _join_by_pivots(members: DataFrame, label: DataFrame, segments: DataFrame, share: int) -> DataFrame:
    """`label` after all links between members of one group that are in different components have been found.

    members: gram, node, n_grams, own, place, parities, turn (the member's rank in its group, as a fraction of it, about) and
    size. Round by round, PIVOT_STEP times as many members of each group as before are its pivots, and all others are held
    against the new ones; between rounds linked members join, so a member with many links is done before there are many
    pivots. The last round has all members for pivots, so no pair is left out.
    """
    differ = " + ".join(f"bit_count(x.p{j} ^ y.p{j})" for j in range(FRAGMENTS))
    alike = f"{differ} <= x.n_grams + y.n_grams - 2L * {_least_overlap('x.n_grams', 'y.n_grams', share)}"
    settled, pivots, waiting = 0, PIVOT_STEP, None
    while True:
        known = members.join(small(label), "node")
        several = known.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("gram")
        rows = materialise(known.join(several, "gram"), "open-groups")
        most = rows.agg(F.max("size")).first()[0]
        if most is None or settled >= most:
            break
        new = rows.where(f"turn * size < {pivots} and turn * size >= {settled}")
        after = "(x.turn > y.turn or x.turn = y.turn and x.node > y.node)"
        met = rows.alias("x").join(new.alias("y"), F.expr(f"x.gram = y.gram and x.label <> y.label and {after} and {_possible(share)} and {alike}"))
        pairs = _pairs(met, F.least("x.label", "y.label").alias("low"), F.greatest("x.label", "y.label").alias("high"), F.expr(f"{differ} - x.n_grams - y.n_grams").alias("off"))
        pairs = materialise(pairs, "pivot-pairs")
        # two components need one link: the likeliest pair first, the others only if it isn't one
        first = pairs.groupBy("low", "high").agg(F.min(F.struct("off", "a", "b", "size_a", "size_b")).alias("p")).select("p.*")
        if not pairs.isEmpty():
            label = _relabel(label, _links(first, segments, share))
            others = pairs.select("a", "b", "size_a", "size_b").subtract(first.select("a", "b", "size_a", "size_b"))
            waiting = materialise(_apart(others if waiting is None else others.union(waiting), label), "other-pairs")
        members = rows.drop("label")
        settled, pivots = pivots, pivots * PIVOT_STEP
    if waiting is not None:
        label = _relabel(label, _links(_apart(waiting, label), segments, share))
    return label


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Those pairs whose nodes have different labels."""
    x, y = (small(label.select(F.col("node").alias(k), F.col("label").alias(f"label_{k}"))) for k in "ab")
    return pairs.join(x, "a").join(y, "b").where("label_a <> label_b").select(*pairs.columns)


def components(docs: DataFrame, n: int = 5, share: int = 80) -> DataFrame:
    """doc_id, n_grams, component_id. Texts link when their n-gram sets have a Jaccard similarity of share / 100 or more.

    n_grams is the largest set of a doc_id's rows; component_id is the smallest doc_id that links reach.
    """
    if not 50 <= share <= 100:
        raise ValueError("share is a percentage from 50 to 100")
    docs, spark = docs.select("doc_id", "text"), docs.sparkSession
    band = min(1.0, max(0.1, 2 * (100 - share) / 100))
    with session_settings(spark, SPLIT_JOINS | DROP_SHUFFLES), scratch(spark):
        sets = _named_apart(materialise(document_sets(docs, n, share, band), "gram-sets"))
        with scratch(spark):
            open_nodes, held, prefix = _open_nodes(sets, share, band)
        segments = materialise(_segments_of(docs, materialise(held.select("doc_id", "node", "check"), "open-owners"), n), "segments")
        star = smallest_reachable(_star_links(prefix, segments, share)).withColumnRenamed("label", "_to")
        label = open_nodes.select("node", F.col("node").alias("label")).join(star, "node", "left")
        label = materialise(label.select("node", F.coalesce("_to", "label").alias("label")), "node-labels")
        sized = prefix.join(_sizes(prefix), "gram")
        few = materialise(_with_parities(_several(sized.where(f"size <= {SMALL_GROUP}"), label), segments), "open-groups")
        label = _join_by_pivots(few, label, segments, share)
        many = materialise(_several(sized.where(f"size > {SMALL_GROUP}"), label).select("node", "n_grams").distinct(), "open-members")
        if not many.isEmpty():
            again = _grouped_anew(many, segments, share)
            again = materialise(_with_parities(again.join(_sizes(again), "gram"), segments), "open-groups")
            label = _join_by_pivots(again, label, segments, share)

        # rows of one doc_id are one document: its texts' components are joined too
        documents = sets.drop("grams", "check").join(label, "node", "left").select("doc_id", "n_grams", F.when(F.col("n_grams") > 0, F.coalesce("label", "node")).alias("label"))
        known = materialise(documents, "document-labels", outlives=1)
    return _name_components(known)


def _open_nodes(sets: DataFrame, share: int, band: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with so few n-grams of their own that they can have links (node, n_grams, doc_id, own), their sets, and their prefixes."""
    with session_settings(sets.sparkSession, SMALL_PARTS):  # a task counts its n-grams in memory, and few of them come twice
        counts = materialise(_first_fragment_counts(sets, band), "gram-counts")
    alone = counts.where("owner is not null").groupBy(F.col("owner").alias("node")).agg(F.count("*").alias("own"))
    nodes = sets.where("n_grams > 0").groupBy("node").agg(F.max("n_grams").alias("n_grams"), F.min_by("doc_id", F.struct(F.col("doc_id").isNull(), "doc_id")).alias("doc_id"))
    nodes = nodes.join(alone, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    open_nodes = materialise(nodes.where(f"own <= {_missing(share)}"), "open-nodes", outlives=1)

    # one text of each open node: a doc_id may have several texts, so the node is part of the key
    of = open_nodes.select(F.col("node").alias("_node"), F.col("doc_id").alias("_doc"), "own")
    held = sets.join(small(of), (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).drop("_node", "_doc")
    held = materialise(held.dropDuplicates(["node"]), "open-sets", outlives=1)
    limit = int(_signed(np.array([_band_limit(band)]))[0])
    grams = held.select("node", "n_grams", "own", F.explode("grams").alias("gram")).withColumn("late", F.col("gram") >= limit)
    known = grams.join(counts.where("gram is not null").select("gram", "uses"), "gram", "left")
    known = known.where(F.col("late") | F.col("uses").isNotNull())  # the others are the node's own, and come first in its order
    return open_nodes, held, materialise(_prefixes(known, share), "gram-prefixes", outlives=1)


def _several(members: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of groups whose members are in several components."""
    labelled = members.join(small(label), "node")
    several = labelled.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("gram")
    return labelled.join(several, "gram").drop("label")


def _grouped_anew(nodes: DataFrame, segments: DataFrame, share: int) -> DataFrame:
    """The prefixes of some nodes (node, n_grams) when all their n-grams are put in order, rarest among them first."""
    every = materialise(segments.join(small(nodes), "node").select("node", "n_grams", F.explode("grams").alias("gram")), "open-grams")
    uses = every.groupBy("gram").agg(F.count("*").alias("uses"), F.min("node").alias("low"), F.max("node").alias("high"))
    own = uses.where("low = high").groupBy(F.col("low").alias("node")).agg(F.count("*").alias("own"))
    shared = every.join(uses.where("low <> high").select("gram", "uses"), "gram").withColumns({"own": F.lit(0), "late": F.lit(False)})
    first = _prefixes(shared, share).drop("own").join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    return materialise(first.withColumn("place", F.col("place") + F.col("own")).where(f"place <= {_missing(share)}"), "open-prefixes")


def _segments_of(docs: DataFrame, owners: DataFrame, n: int) -> DataFrame:
    """The segments of one text of each node. owners: doc_id, node and check; other texts of an owner's doc_id are left out."""
    ids = owners.select(F.col("doc_id").alias("_doc"), "node", "check")
    found = docs.join(small(ids), F.col("doc_id").eqNullSafe(F.col("_doc"))).select("node", "check", "text")
    return _segments(found, n).dropDuplicates(["node", "fragment"])


def _name_components(known: DataFrame) -> DataFrame:
    """From doc_id, n_grams, label (null: linked with nothing) to one row per doc_id, named by the smallest doc_id of its component."""
    several = known.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("n_grams").alias("n_grams"))
    twice = several.where("low <> high")
    if not twice.isEmpty():
        pairs = known.join(twice.select("doc_id", "low"), "doc_id").where("label is not null and label <> low").select(F.col("label").alias("a"), F.col("low").alias("b"))
        merged = smallest_reachable(pairs).select(F.col("node").alias("label"), F.col("label").alias("_to"))
        known = known.join(merged, "label", "left").withColumn("label", F.coalesce("_to", "label")).drop("_to")
    per_doc = known.groupBy("doc_id").agg(F.max("n_grams").alias("n_grams"), F.min("label").alias("label"))
    names = per_doc.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return per_doc.join(names, "label", "left").select("doc_id", "n_grams", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, share: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, whole and with its own columns.

    Of rows that repeat a doc_id one stays: the one whose text sorts first. Rows without a doc_id all stay.
    """
    found = components(docs, n, share)
    found = materialise(found, "near-copies")
    out = semi_join(docs, found.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti")
    rows, ids = docs.agg(F.count("doc_id")).first()[0], found.where("doc_id is not null").count()
    if rows > ids:
        named, unnamed = out.where("doc_id is not null"), out.where("doc_id is null")
        best = fresh("best", docs)
        # maps and variants have no order of their own; their text has
        told = [F.to_json(F.struct(F.col(c))) if "map<" in kind or "variant" in kind else F.col(c) for c, kind in docs.dtypes if c not in ("doc_id", "text")]
        one = F.min_by(F.struct(*[c for c in docs.columns if c != "doc_id"]), F.struct(F.col("text"), *told)).alias(best)
        out = named.groupBy("doc_id").agg(one).select("doc_id", f"{best}.*").select(*docs.columns).unionByName(unnamed)
    return out.select(*docs.columns)
