"""The registered queries of the corpus operators: each applies one operator to its whole table, and oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylens.llm import bpe, centroids, chunked_bpe, fingerprint, hmm, linedup, ngram_join, packing, quality, repair, toxicity, training_order, warc
from quaylens.llm.common import crc_fold, read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = training_order.write(read_table(spark, sf_dir, "documents"))
    return training_order.read_back(folder, manifest)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.assess(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.components(read_table(spark, sf_dir, "documents"), n=3, share=90)
    return out.select("doc_id", F.col("n_grams").alias("n_shingles"), "component_id")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.decode(bpe.encode(read_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return warc.read(warc.write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linedup.clean(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), "n_removed", "text")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return repair.repair(repair.damage(turns), turns)


def op12_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunked_bpe.decode(chunked_bpe.encode(read_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", F.sha2(F.col("decimal").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.cluster(read_table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_training_order": op2_training_order,
    "op3_quality": op3_quality,
    "op4_fingerprint": op4_fingerprint,
    "op5_hmm": op5_hmm,
    "op6_packing": op6_packing,
    "op7_ngram_join": op7_ngram_join,
    "op8_bpe": op8_bpe,
    "op9_warc": op9_warc,
    "op10_line_dedup": op10_line_dedup,
    "op11_repair": op11_repair,
    "op12_chunked_bpe": op12_chunked_bpe,
    "op13_centroids": op13_centroids,
    "pipeline": pipeline,
}

_WORDS = r"""filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"""

QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (SELECT r, {_WORDS} AS ws FROM d)),
g AS (
  SELECT r, p, w, length(w) AS n,
    CASE WHEN lead(w, 2) OVER o IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o) END AS g3,
    CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END AS g5,
    CASE WHEN lead(w, 6) OVER o IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o) END AS g7,
    CASE WHEN lead(w, 9) OVER o IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o, lead(w, 8) OVER o, lead(w, 9) OVER o) END AS g10
  FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
f AS (
  SELECT r, p, n,
    g3 IS NOT NULL AND count(*) OVER (PARTITION BY r, g3) > 1 AS f3, g5 IS NOT NULL AND count(*) OVER (PARTITION BY r, g5) > 1 AS f5,
    g7 IS NOT NULL AND count(*) OVER (PARTITION BY r, g7) > 1 AS f7, g10 IS NOT NULL AND count(*) OVER (PARTITION BY r, g10) > 1 AS f10
  FROM g),
c AS (
  SELECT r, n,
    bool_or(f3) OVER (PARTITION BY r ORDER BY p ROWS 2 PRECEDING) AS c3, bool_or(f5) OVER (PARTITION BY r ORDER BY p ROWS 4 PRECEDING) AS c5,
    bool_or(f7) OVER (PARTITION BY r ORDER BY p ROWS 6 PRECEDING) AS c7, bool_or(f10) OVER (PARTITION BY r ORDER BY p ROWS 9 PRECEDING) AS c10
  FROM f),
m AS (SELECT r, count(*) AS n_words, sum(n) AS word_chars, count_if(c3) AS n_repeat_words, sum(n) FILTER (c5) AS c5, sum(n) FILTER (c7) AS c7, sum(n) FILTER (c10) AS c10 FROM c GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
u AS (SELECT r, line, count(*) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
v AS (SELECT r, sum(k) AS n_lines, sum(k - 1) AS n_dup_lines, sum(k * length(line)) AS line_chars, sum((k - 1) * length(line)) AS dup_chars FROM u GROUP BY r),
x AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(line_chars, 0) AS line_chars,
    coalesce(dup_chars, 0) AS dup_chars, coalesce(c5, 0) AS c5, coalesce(c7, 0) AS c7, coalesce(c10, 0) AS c10
  FROM d LEFT JOIN m USING (r) LEFT JOIN v USING (r)),
y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_dup_lines <= 30 * n_lines AND 100 * dup_chars <= 30 * line_chars AND 100 * n_symbols <= 10 * word_chars
    AND 100 * c5 <= 32 * word_chars AND 100 * c7 <= 30 * word_chars AND 100 * c10 <= 28 * word_chars AS kept
FROM y
"""

LINES_SQL = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
t AS (SELECT *, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM l),
s AS (SELECT k, min(doc_id) AS owner FROM t WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT source) >= 3),
m AS (SELECT t.*, s.k IS NOT NULL AND t.doc_id IS DISTINCT FROM s.owner AS gone FROM t LEFT JOIN s USING (k)),
c AS (SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, text FROM c
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id <> first THEN first END AS refers_to
FROM q LEFT JOIN f USING (payload_digest)
"""



def _edit(state: str, cost: str, letter: str, put: str = "''", when: str = "true") -> str:
    """A state (cost, audit, repaired rows) after one edit; null where there is none."""
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}', t := {state}.t || {put}) END"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


_USER, _ASSISTANT, _ROW = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || role || ':' || text"
_CLOSED = f"""SELECT *, {_least("k2", _edit("s3", "2", "I", _USER))} AS q2, {_least("s3", _edit("k2", "2", "I", _ASSISTANT))} AS q3 FROM (
    SELECT *, {_least("s2", _edit("s0", "2", "I", _USER), _edit("s1", "2", "I", _USER))} AS k2 FROM {{rows}})"""
_TO_USER = [e for q in ("s0", "s1", "q3") for e in (_edit(q, "late", "K", _ROW, "stays AND letter = 'u'"), _edit(q, "2 + late", "R", f"{_USER} || text", "stays"))]
_TO_ASSISTANT = [_edit("q2", "late", "K", _ROW, "stays AND letter = 'a'"), _edit("q2", "2 + late", "R", f"{_ASSISTANT} || text", "stays")]
REPAIR_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id) AS conv,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT) AS key FROM conversations),
coded AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, key), lambda crc, b:
    list_reduce(list_prepend(xor(crc, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS fault FROM raw),
damaged AS (
  SELECT conv, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) FROM coded WHERE fault <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS p,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS letter FROM damaged),
faulty AS MATERIALIZED (
  SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY p) > 1 AS duplicate, right(body, 1) NOT IN ('.', '!', '?') AS open,
    p > 1 AND lag(letter) OVER (PARTITION BY conv ORDER BY p) || letter NOT IN ('su', 'ua', 'au') AS illegal FROM placed),
rows_of AS MATERIALIZED (SELECT conv, p, role, text, letter, NOT blank AND NOT duplicate AS stays, open::INTEGER AS late FROM faulty),
steps AS (
  SELECT conv, 0::BIGINT AS done, struct_pack(c := 0, a := '', t := '') AS s0, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS s1, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS s2, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS s3
  FROM (SELECT DISTINCT conv FROM raw)
  UNION ALL
  SELECT conv, done + 1, {_edit("s0", "3", "D")}, {_least(_edit("s1", "3", "D"), _edit("s0", "late", "K", _ROW, "stays AND letter = 's'"))},
    {_least(_edit("q2", "3", "D"), *_TO_USER)}, {_least(_edit("q3", "3", "D"), *_TO_ASSISTANT)}
  FROM ({_CLOSED.format(rows="(SELECT s.*, role, text, letter, stays, late FROM steps s JOIN rows_of r ON r.conv = s.conv AND r.p = s.done + 1)")})),
last AS (SELECT * FROM steps WHERE done = (SELECT count(*) FROM rows_of r WHERE r.conv = steps.conv)),
best AS (SELECT conv, {_least("s0", "q3")} AS b FROM ({_CLOSED.format(rows="last")})),
counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate,
    count_if(open AND NOT blank AND NOT duplicate) AS truncated, count_if(illegal) AS illegal FROM faulty GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, b.c::BIGINT AS cost, b.a AS audit, sha256(b.t[2:]) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM raw) JOIN best USING (conv) LEFT JOIN counted USING (conv)
"""

_NEAREST = """(SELECT r, min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT, c := n)) AS best FROM vectors, {of} GROUP BY r)"""
_ROUND = """m{i} AS MATERIALIZED (
  SELECT n, coalesce(list(floor_mean ORDER BY place), any_value(c)) AS c FROM {of} LEFT JOIN (
    SELECT best.c AS n, place, floor(sum(x)::DECIMAL(38, 0) / count(*))::BIGINT AS floor_mean
    FROM (SELECT best, unnest(v) AS x, unnest(range(1, 65)) AS place FROM vectors JOIN {nearest} USING (r)) GROUP BY ALL) USING (n) GROUP BY n)"""
CENTROIDS_SQL = (
    """WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS n, v AS c FROM vectors ORDER BY n LIMIT 40),
"""
    + ",\n".join(_ROUND.format(i=i, of=f"m{i - 1}", nearest=_NEAREST.format(of=f"m{i - 1}")) for i in range(1, 6))
    + f"""
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m5.c, ',')) AS centroid_sha256
FROM vectors JOIN {_NEAREST.format(of="m5")} USING (r) JOIN m5 ON m5.n = best.c"""
)

ORACLE: dict[str, str] = {"op3_quality": QUALITY_SQL, "op9_warc": WARC_SQL, "op10_line_dedup": LINES_SQL, "op11_repair": REPAIR_SQL, "op13_centroids": CENTROIDS_SQL}
