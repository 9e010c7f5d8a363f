"""The inverted index, evidence in time, and quotes in batches and as a stream."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quaylens.operators import evidence as ev
from quaylens.operators import quotes as qt
from quaylens.operators.inverted import OfferIndex, words_of
from quaylens.streaming import observations as st
from quaylens.streaming import quotes as sq

NOW = "2000-06-01 00:00:00"
WORDS = "red blue widget ring gizmo hot old Ünder 128gb".split()


def docs(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame(rows, "offer_id string, title string, brand string, observed_at string").withColumn("observed_at", F.col("observed_at").cast("timestamp"))


def scanned(rows, query, limit):  # noqa: ANN001, ANN201
    """The same search over plain rows."""
    import math

    newest: dict = {}
    for r in rows:
        if r[0] is not None and (r[0] not in newest or r[3] > newest[r[0]][3]):
            newest[r[0]] = r
    held = {i: (" ".join(x for x in (r[1], r[2]) if x).lower().split(), r[3]) for i, r in newest.items()}
    wanted = words_of(query)
    of = {t: sum(t in w for w, _ in held.values()) for t in wanted}
    if not wanted or not all(of.values()):
        return []
    weight = {t: math.floor(1000 * math.log(1 + len(held) / n)) for t, n in of.items()}
    found = [(-sum(w.count(t) * weight[t] for t in wanted) / len(w), at, i) for i, (w, at) in held.items() if all(t in w for t in wanted)]
    order = sorted(found, key=lambda r: (r[0], [-ord(c) for c in r[1]], r[2]))
    return [(i, round(-rank, 9)) for rank, _, i in order[:limit]]


def searched(index, query, limit):  # noqa: ANN001, ANN201
    return [(r.offer_id, round(r.text_rank, 9)) for r in index.search(query, NOW, 1e9, limit).orderBy("place").collect()]


def test_the_index_finds_what_a_scan_finds_after_each_write(spark, tmp_path):  # noqa: ANN001
    rng = random.Random(2)
    index = OfferIndex(spark, str(tmp_path / "index"), buckets=8)
    made = lambda i, day: (f"o{i:03d}", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 30))), rng.choice(["Acme", "hot", None]), f"2000-01-{day:02d} 00:00:00")
    rows: list = []
    for batch in ([made(i, rng.randrange(2, 9)) for i in range(200)], [made(i, rng.randrange(1, 20)) for i in range(150, 260)], [made(3, 25), made(3, 26), (None, "red", "x", "2000-01-30 00:00:00")]):
        index.write(docs(spark, batch))
        rows += sorted(batch, key=lambda r: (r[3],))
        for query, limit in (("red widget", 5), ("Hot", 400), ("ünder ring 128GB!", 10)):
            assert searched(index, query, limit) == scanned(rows, query, limit)
    assert searched(index, "red nothing", 5) == [] and searched(index, " - ", 5) == []
    small = index.compact(str(tmp_path / "compact"))
    assert searched(small, "red widget", 30) == searched(index, "red widget", 30) and len(small.commits()) == 1
    # a write that never came to its end counts for nothing
    index._write(docs(spark, [("x", "red widget", "", NOW)]).withColumn("bucket", F.lit(1)), "docs", 9, ["offer_id"])
    assert ("x", 1) not in {(i, 1) for i, _ in searched(index, "red widget", 300)}


def test_a_search_reads_the_buckets_of_its_words(spark, tmp_path):  # noqa: ANN001
    index = OfferIndex(spark, str(tmp_path / "index"), buckets=16)
    index.write(docs(spark, [(f"o{i}", " ".join(WORDS[i % 9 :]) + " pad" * (i % 20), "b", NOW) for i in range(300)]))
    rows = index.postings(["red"], [9, 10])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(term" in plan or "EqualTo(term" in plan
    read = {r.bucket for r in index._table("postings").where(F.col("bucket").isin(index._buckets_of(["red"]))).select("bucket").distinct().collect()}
    assert len(read) == 1
    reads: list = []
    plain = index.scored
    index.scored = lambda terms, weights, tiers: reads.append(tiers) or plain(terms, weights, tiers)
    got = searched(index, "128gb", 3)
    assert len(got) == 3 and sum(map(len, reads)) < len(index.stats(["128gb"])["128gb"])


def test_documents_of_one_text_share_its_postings(spark, tmp_path):  # noqa: ANN001
    index = OfferIndex(spark, str(tmp_path / "index"), buckets=4)
    index.write(docs(spark, [(f"o{i}", f"red widget {i % 2}", "b", NOW) for i in range(100)]))
    assert sorted((r.n, r.tf) for r in index.postings(["red"]).collect()) == [(50, 1), (50, 1)]
    assert index.stats(["red", "0"]) == {"red": {4: (100, 0.25)}, "0": {4: (50, 0.25)}}
    assert len(searched(index, "red 1", 100)) == 50


def test_a_write_over_another_counts_texts_not_documents(spark, tmp_path):  # noqa: ANN001
    index = OfferIndex(spark, str(tmp_path / "index"), buckets=4)
    for text, at in (("red widget", "2000-01-01 00:00:00"), ("blue widget", "2000-01-02 00:00:00"), ("late widget", "2000-01-01 12:00:00"), ("red widget", "2000-01-03 00:00:00")):
        index.write(docs(spark, [(f"o{i}", text, None, at) for i in range(60)]))
    assert sorted((r.segment, r.n) for r in index.postings(["widget"]).collect()) == [(0, 60), (1, 60), (3, 60)]
    assert {t: {k: n for k, (n, _) in of.items()} for t, of in index.stats(["red", "blue", "late"]).items()} == {"red": {2: 60}, "blue": {}, "late": {}}
    assert [len(searched(index, q, 100)) for q in ("red", "blue", "late")] == [60, 0, 0] and index.documents().count() == 60


def test_no_index_is_an_error(spark, tmp_path):  # noqa: ANN001
    with pytest.raises(ValueError, match="no index"):
        OfferIndex(spark, str(tmp_path / "none")).search("red", NOW, 1e9, 5)


def test_evidence_on_both_edges(spark):  # noqa: ANN001
    at = datetime(2024, 1, 1, 12, 0, 0)
    shifts = {"old": -300.000001, "first": -300, "last": 60, "new": 60.000001}
    asked = spark.createDataFrame([(n, n, at) for n in shifts] + [("null", None, at), ("untimed", "first", None)], "offer string, sku string, at timestamp")
    told = spark.createDataFrame([(n, at + timedelta(seconds=s), i, n) for i, (n, s) in enumerate(shifts.items())] + [("last", at, 9, "older"), ("last", at + timedelta(seconds=60), 1, "tie")], "sku string, found_at timestamp, evidence_id int, what string")
    got = {r.offer: r.found.what if r.found else None for r in ev.newest_in_time(asked, told, "sku", "at").collect()}
    assert got == {"old": None, "first": "first", "last": "last", "new": None, "null": None, "untimed": None}


def test_evidence_against_all_pairs(spark):  # noqa: ANN001
    rng, base = random.Random(4), datetime(2024, 1, 1)
    asked = [(i, rng.choice("ab"), base + timedelta(seconds=rng.randrange(4000))) for i in range(150)]
    told = [(rng.choice("ab"), base + timedelta(seconds=rng.randrange(4000)), i) for i in range(60)]
    df = ev.newest_in_time(spark.createDataFrame(asked, "i int, sku string, at timestamp"), spark.createDataFrame(told, "sku string, found_at timestamp, evidence_id int"), "sku", "at")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    for r in df.collect():
        inside = [(t, i) for s, t, i in told if s == r.sku and -300 <= (t - r.at).total_seconds() <= 60]
        assert (r.found.evidence_id if r.found else None) == (max(inside)[1] if inside else None)


@pytest.mark.parametrize(("changes", "reason"), [({}, "admitted"), ({"price": 49.9}, "price_review"), ({"price": 50.0}, "admitted"), ({"price": 200.0}, "admitted"), ({"price": 200.1}, "price_review"), ({"price": None}, "price_invalid"), ({"currency": "USD"}, "price_invalid"), ({"sku": "other"}, "sku_mismatch"), ({"brand": "Bolt"}, "variant_conflict"), ({"brand": None}, "admitted"), ({"model": "X 2"}, "variant_conflict")])
def test_admission(spark, changes, reason):  # noqa: ANN001
    found = {"sku": "s", "brand": "ACME", "model": "x-1", "price": 90.0, "currency": "SAR"} | changes
    df = spark.createDataFrame([("s", "Acme", "X 1", 100.0, tuple(found.values()))], "key string, brand string, model string, product_price double, found struct<sku:string,brand:string,model:string,price:double,currency:string>")
    r = ev.admit_evidence(df, "key", "product_price").first()
    assert (r.reason, r.final_price) == (reason, found["price"] if reason == "admitted" else 100.0)


# quotes

COMMANDS = "quote_id string, command_id string, at timestamp, kind string, payload string, price long, eta_days long, valid_seconds long, terms string, expected_revision long, decision string"
T0 = datetime(2024, 1, 1)


def request(q, i, s, payload="p"):  # noqa: ANN001, ANN201
    return (q, i, T0 + timedelta(seconds=s), "request", payload, None, None, None, None, None, None)


def priced(q, i, s, expected=None, price=100, days=3, seconds=600, terms="net"):  # noqa: ANN001, ANN201
    return (q, i, T0 + timedelta(seconds=s), "quote", None, price, days, seconds, terms, expected, None)


def decided(q, i, s, revision, decision="accepted"):  # noqa: ANN001, ANN201
    return (q, i, T0 + timedelta(seconds=s), "decide", None, None, None, None, None, revision, decision)


CASES = [
    ([request("a", "1", 0), request("a", "2", 1), request("a", "3", 2, "other"), request("a", "1", 3)], ["requested", "replayed", "payload_conflict", "repeated"]),
    ([priced("a", "1", 0), decided("a", "2", 1, 0), request("a", "3", 2, None)], ["not_mutable", "not_found", "invalid_request"]),
    ([request("a", "1", 0), priced("a", "2", 1, 0), priced("a", "3", 2, 0), priced("a", "4", 3), decided("a", "5", 4, 1), decided("a", "6", 5, 2), priced("a", "7", 6)], ["requested", "quoted", "not_mutable", "quoted", "expired_or_changed", "accepted", "not_mutable"]),
    ([request("a", "1", 0), priced("a", "2", 1, seconds=60), decided("a", "3", 61, 1)], ["requested", "quoted", "expired_or_changed"]),
    ([request("a", "1", 0), priced("a", "2", 1, seconds=60), decided("a", "3", 60, 1, "declined")], ["requested", "quoted", "declined"]),
    ([request("a", "1", 0), *[priced("a", str(i + 2), i + 1, **bad) for i, bad in enumerate([{"price": 0}, {"price": 10**9}, {"days": 91}, {"seconds": 59}, {"terms": " "}, {"expected": -1}])]], ["requested", *["invalid_quote"] * 6]),
    ([decided("a", "1", 0, None), decided("a", "2", 1, 1, "maybe")], ["invalid_decision"] * 2),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_quote_rules(case):  # noqa: ANN001
    quote, names = qt.Quote(), [c.split()[0] for c in COMMANDS.split(", ")]
    rows, expected = CASES[case]
    import pandas as pd

    assert [quote.apply(dict(zip(names, r, strict=True)) | {"at": pd.Timestamp(r[2])}) for r in rows] == expected


def many():  # noqa: ANN201
    rng, out = random.Random(7), []
    for q in "abcdef":
        for i in range(40):
            s, name = rng.randrange(3600), f"{q}{i:03d}"
            out.append(rng.choice([request(q, name, s, rng.choice("xy")), priced(q, name, s, rng.choice([None, None, 0, 1, 2]), price=rng.randrange(5), seconds=rng.choice([60, 600])), decided(q, name, s, rng.randrange(4), rng.choice(["accepted", "declined"]))]))
    out += rng.sample(out, 20)
    return out


def key(r):  # noqa: ANN001, ANN201
    return (r.quote_id, r.command_id, r.outcome, r.status, r.revision, r.price, r.valid_until)


def test_the_stream_agrees_with_the_batch(spark, tmp_path):  # noqa: ANN001
    """Commands out of order by up to ten minutes over many batches, some of them twice."""
    rows = many()
    batch = spark.createDataFrame(rows, COMMANDS)
    expected = [r for r in qt.outcomes(batch).collect()]
    rng = random.Random(1)
    arriving = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.randrange(600)))
    # what comes much later lets the watermark pass; quotes that are made then expire with the one after
    parts = [*[arriving[i : i + 45] for i in range(0, len(arriving), 45)], *[[request("flush", f"z{i}", i * 10**6)] for i in (1, 2, 3)]]
    for part in parts:
        spark.createDataFrame(part, COMMANDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with_store = {k: spark.conf.get(k, None) for k in sq.STORE}
    for k, v in sq.STORE.items():
        spark.conf.set(k, v)
    try:
        got = st.run_available(sq.outcomes_of(stream), "append", str(tmp_path / "out")).where("quote_id <> 'flush'").collect()
    finally:
        for k, v in with_store.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    effective = lambda found: sorted(map(repr, (key(r) for r in found if r.outcome not in ("repeated", "expired"))))
    assert effective(got) == effective(expected)
    assert sum(r.outcome == "repeated" for r in got) == 20
    ended = {r.quote_id: r for r in qt.view(qt.outcomes(batch), "2024-01-02 00:00:00").collect()}
    assert {r.quote_id for r in got if r.outcome == "expired" and r.revision == ended[r.quote_id].revision} == {q for q, r in ended.items() if r.status == "expired"}
