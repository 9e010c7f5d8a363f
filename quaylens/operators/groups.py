"""Comparable groups: offers that may be held against one another, by an order-dependent greedy rule.

Offers are taken with a manufacturer's model number first, then by variant key; each joins the one group all of whose members it
fits, and founds its own where none or several do. What decides is the identity (brand, category, condition, name, model
number, attributes); the rule runs over distinct identities, and offers join back to them.

Two identities can only fit if they share a model number, or a name and the core variants, within one brand, category and
condition. Identities linked that way are a component, and no group reaches beyond one; so the rule runs for each component on
its own, in any order. Links by name count only where an identity without a model number has that name, since two with different numbers
never fit. An identity that fits nothing, not even itself (a laptop without a digit in its name), makes each of its offers a group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylens.functions.text import joined_units, models, plain_text, screen_size
from quaylens.operators.offers import enrich, rank_order
from quaylens.schema import BUCKETS
from quaylens.sources.storage import small, work_folder, written

#: Categories whose name must have a digit to tell one product.
NUMBERED = ("laptop", "printer", "desktop", "monitor", "tv", "tablet", "camera", "watch")
#: Attributes that must be equal unless the model number is, and further ones that may not contradict each other.
CORE = ("storage", "color", "edition", "form", "bundle")
OTHER = ("ram", "region", "sim")
EXTRA = ("size", "weight", "capacity", "pack", "pack size", "quantity", "material", "style", "flavor", "grind", "processor", "gpu", "screensize", "network")


def _plain(value: Column) -> Column:
    return joined_units(plain_text(F.coalesce(value, F.lit(""))))


def identity(offers: DataFrame) -> DataFrame:
    """Adds brand, category, condition, name, number, the core variants and all attributes that aren't blank in comparable form, as the struct `identity`.

    offers: brand, category, condition, title, model_number; any of storage, color, edition, form, bundle, ram, region, sim as
    strings; extra_specs as a map, of which the known names count.
    """
    have = set(offers.columns)
    empty = F.array().cast("array<struct<key:string,value:string>>")
    told = F.lit(None)
    if "extra_specs" in have:
        told = F.transform(F.map_entries("extra_specs"), lambda e: F.struct(plain_text(e["key"]).alias("key"), e["value"].alias("value")))
    # one step a projection, so that nothing is worked out twice
    rows = offers.withColumns({"_title": plain_text(F.coalesce("title", F.lit(""))), "_category": _plain(F.col("category")), "_told": F.coalesce(told, empty)})
    rows = rows.withColumns({f"_{c}": _plain(F.col(c)) if c in have else F.lit("") for c in (*CORE, *OTHER)})
    told = F.filter("_told", lambda e: e["key"].isin(*EXTRA) & e["value"].isNotNull() & ~((F.col("_category") == "phone") & (e["key"] == "processor")))
    told = F.transform(told, lambda e: F.struct(e["key"].alias("key"), F.when(e["key"] == "screensize", screen_size(e["value"])).otherwise(_plain(e["value"])).alias("value")))
    stated = F.regexp_extract("_storage", r"\b([0-9]+(?:gb|tb))\b", 1)
    rows = rows.withColumns({"_named": models(F.col("_title")), "_told": told, "_storage": F.when(stated != "", stated).otherwise(F.col("_storage"))})
    # of names that become equal, the last value in order counts
    once = F.transform(F.array_distinct(F.transform("_told", lambda e: e["key"])), lambda k: F.struct(k.alias("key"), F.array_max(F.transform(F.filter("_told", lambda e: e["key"] == k), lambda e: e["value"])).alias("value")))
    rows = rows.withColumn("_told", F.when(F.size("_told") > 1, once).otherwise(F.col("_told")))
    own = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"_{c}").alias("value")) for c in (*CORE, *OTHER)])
    fields = {
        "brand": _plain(F.col("brand")),
        "category": F.col("_category"),
        "condition": _plain(F.coalesce("condition", F.lit("unknown"))),
        "name": F.when(F.size("_named") > 0, F.col("_named")[0]).otherwise(joined_units(F.col("_title"))),
        "number": F.regexp_replace(F.lower(F.coalesce("model_number", F.lit(""))), r"[^\p{L}\p{N}]+", ""),
        **{c: F.col(f"_{c}") for c in CORE},
        "attributes": F.array_sort(F.filter(F.concat(own, "_told"), lambda e: e["value"] != "")),
    }
    rows = rows.withColumn("identity", F.struct(*[c.alias(n) for n, c in fields.items()]))
    return rows.drop("_title", "_category", "_told", "_named", *[f"_{c}" for c in (*CORE, *OTHER)])


def variant_key() -> Column:
    """brand|name|storage|color|condition|sku:number|other attributes by name."""
    number = F.col("identity.number")
    others = F.filter("identity.attributes", lambda e: ~e["key"].isin(*CORE))
    told = F.array_join(F.transform(others, lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ";")
    return F.concat_ws("|", "identity.brand", "identity.name", F.col("identity.storage"), F.col("identity.color"), "identity.condition", F.concat(F.lit("sku:"), F.when(number == "", "unknown").otherwise(number)), told)


def telling_name() -> Column:
    """Whether the name tells one product of its category: known, with a digit where models are numbered, and of a phone with capacity and colour."""
    name, category = F.col("identity.name"), F.col("identity.category")
    sized = (F.col("identity.storage") != "") & (F.col("identity.color") != "")
    return (name != "") & (name != "unknown model") & (~category.isin(*NUMBERED) | name.rlike(r"\d")) & ((category != "phone") | sized)


def fits(a: dict, b: dict) -> bool:
    """Whether two identities of one brand, category and condition may be in one group. a, b: category, name, telling, number, attributes."""
    if a["number"] and b["number"] and a["number"] != b["number"]:
        return False
    same, phone = bool(a["number"]) and a["number"] == b["number"], a["category"] == "phone"
    x, y = a["attributes"], b["attributes"]
    for key in {*x, *y}:
        if same and key == "form":
            continue
        u, v = x.get(key, ""), y.get(key, "")
        if u != v and ((phone and key == "region") or (key in CORE and not same) or (u and v)):
            return False
    if same:
        return not phone or a["name"] == b["name"]
    return a["telling"] and a["name"] == b["name"]


def grouped(component: list[dict]) -> Iterator[tuple[int, bool]]:
    """For each identity of a component, in the rule's order: the number of the identity that founded its group, and whether each of its offers is a group of its own."""
    founded: list[tuple[int, list[dict], int]] = []  # founder, members, how many such groups there are
    at: dict[tuple, list[int]] = {}
    for i, who in enumerate(component):
        keys = [("name", who["name"], *[who["attributes"].get(c, "") for c in CORE]), *([("number", who["number"])] if who["number"] else [])]
        near = {g for k in keys for g in at.get(k, ())}
        found = [g for g in near if all(fits(m, who) for m in founded[g][1])]
        several = sum(founded[g][2] for g in found) > 1
        if len(found) == 1 and not several:
            g = found[0]
            founded[g][1].append(who)
        else:
            g = len(founded)
            founded.append((i, [who], who["n"] if several else 1))
        for k in keys:
            at.setdefault(k, []).append(g)
        yield founded[g][0], several and who["n"] > 1


def components(edges: DataFrame, folder: str) -> DataFrame:
    """id, component (the smallest id that it reaches) of every id that shares a key. edges: id, key, without repeats; ids with one key are linked.

    In each round every component so far joins the least one that it shares a key with, pointers are doubled, and what is left are
    the links between the joined ones; so rounds are few and their tables shrink. Each is written.
    """
    shared = lambda e: e.join(e.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key").select("id", "key")
    edges = written(shared(edges), f"{folder}/edges-0")
    names, around = written(edges.select("id", F.col("id").alias("component")).distinct(), f"{folder}/names-0"), 0
    while True:
        around += 1
        least = edges.groupBy("key").agg(F.min("id").alias("least"))
        joins = written(edges.join(least, "key").groupBy(F.col("id").alias("root")).agg(F.min("least").alias("to")), f"{folder}/joins-{around}")
        if joins.isEmpty():
            return names
        for _ in range(3):
            joins = joins.join(joins.select(F.col("root").alias("_root"), F.col("to").alias("_to")), F.col("to") == F.col("_root")).select("root", F.col("_to").alias("to"))
        joins = written(joins, f"{folder}/roots-{around}")
        moved = names.join(joins, F.col("component") == F.col("root"), "left")
        names = written(moved.select("id", F.coalesce("to", "component").alias("component")), f"{folder}/names-{around}")
        edges = written(shared(edges.join(joins, F.col("id") == F.col("root")).select(F.col("to").alias("id"), "key").distinct()), f"{folder}/edges-{around}")


def founders(identities: DataFrame) -> DataFrame:
    """id, check, founder, founder_check, alone for each identity that fits itself. identities: id, check, identity, telling, key, n, best."""
    number = F.col("identity.number")
    block = [F.col(f"identity.{c}") for c in ("brand", "category", "condition")]
    by_number = F.when(number != "", F.xxhash64(F.lit("number"), *block, number))
    by_name = F.when(F.col("telling"), F.xxhash64(F.lit("name"), *block, F.col("identity.name"), *[F.col(f"identity.{c}") for c in CORE]))
    keyed = identities.select("id", number.alias("number"), by_number.alias("by_number"), by_name.alias("by_name"))
    bridged = keyed.where("number = '' and by_name is not null").select(F.col("by_name").alias("key")).distinct()
    edges = keyed.where("by_number is not null").select("id", F.col("by_number").alias("key")).unionByName(keyed.where("by_name is not null").select("id", F.col("by_name").alias("key")).join(bridged, "key", "left_semi"))
    of = components(edges.distinct(), work_folder(identities.sparkSession, "groups"))
    placed = identities.join(of, "id", "left")
    single = placed.where("component is null").select("id", "check", F.col("id").alias("founder"), F.col("check").alias("founder_check"), F.lit(False).alias("alone"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for pdf in batches for r in pdf.to_dict("records"))
        for _, members in itertools.groupby(rows, key=lambda r: r["component"]):
            held = [r | {"attributes": {e["key"]: e["value"] for e in r["attributes"]}} for r in members]
            out = [(r["id"], r["check"], held[f]["id"], held[f]["check"], alone) for r, (f, alone) in zip(held, grouped(held), strict=True)]
            yield pd.DataFrame(out, columns=["id", "check", "founder", "founder_check", "alone"])

    several = placed.where("component is not null").select("component", "id", "check", "identity.category", "identity.name", "identity.number", "identity.attributes", "telling", "key", "n", "best")
    ordered = several.repartition("component").sortWithinPartitions("component", F.col("number") == "", "key", "best", "id")
    return single.unionByName(ordered.drop("best", "key").mapInPandas(run, "id long, check long, founder long, founder_check long, alone boolean"))


def with_best(identities: DataFrame, said: DataFrame, enriched: DataFrame) -> DataFrame:
    """Adds `best`, the place of an identity's first offer, where the rule's order needs it: where variant keys are equal (form, edition and bundle aren't in them). It is null elsewhere.

    identities: id, check, identity, key. said: said, said_check, id, check. enriched: the offers, with said and said_check.
    """
    spark = identities.sparkSession
    keyed = identities.select("id", "check", F.xxhash64("identity.brand", "identity.category", "identity.condition", "key").alias("_key"))
    shared = written(keyed.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key"), work_folder(spark, "shared-keys"))
    place = F.coalesce(*[F.when(F.col("bucket") == b, F.lit(i)) for i, b in enumerate(BUCKETS)])
    order = F.struct(place, F.coalesce("total_sar", F.lit(float("inf"))), F.coalesce("product_price", F.lit(float("inf"))), -F.coalesce("match_confidence", F.lit(0.0)), "offer_id")
    if shared.isEmpty():
        return identities.withColumn("best", F.lit(None))
    tied = written(said.select("said", "said_check", "id", "check").join(keyed.join(small(shared), "_key", "left_semi").drop("_key"), ["id", "check"]), work_folder(spark, "tied"))
    best = enriched.join(small(tied), ["said", "said_check"]).groupBy("id", "check").agg(F.min(order).alias("best"))
    return identities.join(written(best, work_folder(spark, "best")), ["id", "check"], "left")


#: columns that `identity` reads, where they are
STATED = ("brand", "category", "condition", "title", "model_number", *CORE, *OTHER)


def placed(offers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The enriched offers with a mark of what they state (said, said_check); the number of each statement's group (said, said_check, g), in one table, and in another for statements whose offers are a group of their own each; the groups' founders (g, founder, founder_check) with group_key, their variant keys.

    Offers that state the same are counted first, so the text work runs once for each statement, not for each offer.
    """
    spark = offers.sparkSession
    stated = [F.col(c) for c in STATED if c in offers.columns]
    if "extra_specs" in offers.columns:
        stated.append(F.array_sort(F.map_entries("extra_specs")).alias("extra_specs"))
    e = enrich(offers).withColumns({"said": F.xxhash64(*stated), "said_check": F.xxhash64(F.lit("said"), *stated)})
    said = e.groupBy("said", "said_check").agg(F.any_value(F.struct(*stated)).alias("s"), F.count("*").alias("n")).select("s.*", "said", "said_check", "n")
    if "extra_specs" in offers.columns:
        said = said.withColumn("extra_specs", F.map_from_entries("extra_specs"))
    said = identity(said).select("said", "said_check", "n", "identity", F.xxhash64("identity").alias("id"), F.xxhash64(F.lit("identity"), "identity").alias("check"))
    said = written(said, work_folder(spark, "statements"))
    few = said.groupBy("id", "check").agg(F.any_value("identity").alias("identity"), F.sum("n").alias("n"))
    few = written(few.withColumns({"telling": telling_name(), "key": variant_key(), "g": F.monotonically_increasing_id()}), work_folder(spark, "identities"))
    names = few.select("g", F.col("id").alias("founder"), F.col("check").alias("founder_check"), F.col("key").alias("group_key"))
    few = with_best(few, said, e)
    fit = (F.col("identity.number") != "") | F.col("telling")
    # offers of identities that fit nothing are groups of their own
    alone = few.where(~fit).select(F.col("id").alias("founder"), F.col("check").alias("founder_check"), "id", "check", F.lit(True).alias("alone"))
    of = founders(few.where(fit)).unionByName(alone).join(names.drop("group_key"), ["founder", "founder_check"]).drop("founder", "founder_check")
    of = said.select("said", "said_check", "id", "check").join(of, ["id", "check"]).drop("id", "check")
    of = written(of, work_folder(spark, "groups-of"))
    several, single = (written(of.where(F.col("alone") == alone).drop("alone"), work_folder(spark, f"groups-of-{name}")) for name, alone in (("several", False), ("single", True)))
    return e, several, single, names


#: a group in short: its founder's number, and a slash and the offer where that is a group of its own
GROUP = ("g", "own")


def named(grouped: DataFrame, names: DataFrame) -> DataFrame:
    """`group` (the founding identity, and the offer where it is a group of its own) and `group_key`, the founder's variant key, for a group in short."""
    group = F.concat(F.hex("founder"), F.lit("/"), F.hex("founder_check"), "own")
    return grouped.join(small(names), "g").withColumn("group", group).drop("founder", "founder_check", *GROUP)


def grouped_offers(enriched: DataFrame, of: DataFrame, alone: bool) -> DataFrame:
    """The offers of these statements with their group in short. Offers stay where they are if there are few statements."""
    own = F.coalesce(F.concat(F.lit("/"), "offer_id"), F.lit("")) if alone else F.lit("")
    return enriched.join(small(of), ["said", "said_check"]).withColumn("own", own).drop("said", "said_check")


def members(offers: DataFrame) -> DataFrame:
    """The enriched offers with their `group` and `group_key`."""
    e, several, single, names = placed(offers)
    return named(grouped_offers(e, several, False).unionByName(grouped_offers(e, single, True)), names)


def comparable(offers: DataFrame) -> DataFrame:
    """A row for each group: group, group_key, offers, merchants, best_offer, price_basis, best_value, savings_to_next, fastest_days.

    The value of an offer is its total where it is confirmed, else its price; savings are those of the best offer against the next
    one, where both have values of one kind and the next is dearer.
    """
    spark = offers.sparkSession
    e, several, single, names = placed(offers)
    several, single = grouped_offers(e, several, False), grouped_offers(e, single, True)
    by_total = (F.col("bucket") == "confirmed") & F.col("total_sar").isNotNull()
    value = F.when(by_total, F.col("total_sar")).otherwise(F.col("product_price"))
    at = lambda rn, c: F.max(F.when(F.col("rn") == rn, c))
    best = [at(1, F.col("offer_id")).alias("best_offer"), at(1, by_total).alias("_t1"), at(2, by_total).alias("_t2"), at(1, value).alias("best_value"), at(2, value).alias("_next")]
    ranked = F.row_number().over(Window.partitionBy(*GROUP).orderBy(*rank_order("lowest"))).alias("rn")
    ranks = ["offer_id", "bucket", "total_sar", "product_price", "match_confidence"]

    # groups of any size: the counts need few columns of an offer, and have a pass of their own
    counts = several.groupBy("g", "merchant").agg(F.count("*").alias("_n"), F.min("delivery_days").alias("_days")).groupBy("g").agg(F.sum("_n").alias("offers"), F.count("merchant").alias("merchants"), F.min("_days").alias("fastest_days"))
    counts = written(counts, work_folder(spark, "group-counts"))
    first = several.select(*GROUP, *ranks, ranked).where("rn <= 2").groupBy(*GROUP).agg(*best)
    large = first.join(small(counts), "g")
    # groups of one offer, and of those that share its id, are gathered once
    seller = F.dense_rank().over(Window.partitionBy(*GROUP).orderBy(F.col("merchant").asc_nulls_last())).alias("seller")
    sellers = F.coalesce(F.max(F.when(F.col("merchant").isNotNull(), F.col("seller"))), F.lit(0)).cast("long")
    single = single.select(*GROUP, *ranks, "merchant", "delivery_days", ranked, seller)
    single = single.groupBy(*GROUP).agg(*best, F.count("*").alias("offers"), sellers.alias("merchants"), F.min("delivery_days").alias("fastest_days"))
    found = written(large.unionByName(single), work_folder(spark, "groups-found"))
    saved = F.when(F.col("_t1").eqNullSafe(F.coalesce("_t2", F.lit(False))) & (F.col("_next") > F.col("best_value")), F.col("_next") - F.col("best_value"))
    out = named(found, names).withColumns({"price_basis": F.when(F.col("_t1"), "comparable_total").otherwise("advertised_price"), "savings_to_next": saved})
    return out.select("group", "group_key", "offers", "merchants", "best_offer", "price_basis", "best_value", "savings_to_next", "fastest_days")
