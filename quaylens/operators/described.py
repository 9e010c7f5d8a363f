"""What an offer around a game console sells: the console, a game, or an accessory; its platform, edition, storage and form.

A title of this kind names a console in most accessories too, so the words alone don't tell. What counts is the subject, the
part before a link (`with`, `plus`, a `+` that stands alone): a console as subject stays one whatever comes with it, and an
accessory stays one whatever it fits. All is one projection of built-in functions over the rows, without a shuffle.

Cases: a null or empty title is a product of no platform. Titles of any length are read whole. Repeated rows are described row
by row; extra columns stay. The columns added replace ones of the same name. An empty table gives an empty result. Scripts are
taken as they stand: alternative Arabic letters are a task of the normaliser (`functions.text`), to be applied before.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylens.functions.text import joined_units, plain_text

# Patterns over normal titles.
PLATFORM = r"\b(?:ps[45]|xbox(?: series [sx])?|nintendo switch(?: 2)?)\b"
DISC_DRIVE = r"\b(?:disc|disk|optical|blu ray) drive\b"
ACCESSORY = r"\b(?:controllers?|dualsense|dual sense|remote|camera|charging station|stick module|headset|adaptor|adapter|covers?|cases?|face\s?plates?|side shell plates?|replacement shells?|skins?|decals?|accessor(?:y|ies)|gift card|recharge card|disc drive|disk drive|optical drive|blu ray drive|cooling fans?|wall mounts?|mounting brackets?|game drives?|external hdd|external hard drive|hard drive enclosure|(?:usb|multiport|expansion|charging) hubs?|hubs?|docking stations?|port expanders?|stands?)\b"
ARABIC_ACCESSORY = r"(?:^| )(?:غطاء|اغطيه|مروحه تبريد|حامل|حامل جداري|حامل حائط|قارئ disc|قارئ disk|قارئ اقراص|هارد خارجي|قرص صلب خارجي|هب|موزع منافذ)(?= |$)"
STORAGE_ACCESSORY = r"\b(?:ssds?|nvme|solid state drives?|storage expansion(?: drives?)?|external usb (?:ssd|drive))\b"
STORAGE_PART = r"\b(?:heatsinks?|heat sinks?|cooling plates?|enclosures?|ssd cases?|thermal pads?|installation kits?)\b"
SSD_WITH_COOLING = r"\b(?:ssds?|solid state drives?) (?:with|including|includes|plus)(?: [a-z]+){0,3} (?:heatsinks?|heat sinks?)\b"
CONSOLE_FIRST = r"^(?:sony )?ps[45](?: (?:slim|pro|digital|disc|edition|standard|gaming|white|black|blu ray|\d+(?:gb|tb))){0,9}(?: console| (?:digital|disc) edition| (?:dig|digital|disc) \d+(?:gb|tb))\b"
CONSOLE_SUBJECT = r"^(?:sony )?ps[45](?: (?:slim|pro|digital|disc|edition|standard|gaming|\d+(?:gb|tb))){0,7} console\b"
CONSOLE_LINK = r"^(?: \d+(?:gb|tb))?(?: with| including| includes| plus)\b"
CONSOLE_WITH_DRIVE = r"\bconsole\b.*\b(?:with|including|includes)\b.*\b(?:disc|disk|optical|blu ray) drive\b"
CONSOLE_HUB = r"\bconsole\s+(?:(?:usb|multiport|expansion)\s+)?hubs?\b"
EDITION_SUBJECT = r"^(?:sony )?ps5 (?:slim|pro) (?:digital|disc)(?: edition)?(?: \d+(?:gb|tb))?$"
PACKAGE = r"^(.+?) (?:with|including|includes|plus) (.+)$"
CONTROLLER = r"\b(?:dualsense|controllers?)\b"
CONTROLLER_PART = r"\b(?:dualsense (?:chargers?|charging stations?|docks?)|controller (?:holders?|stands?|chargers?|charging stations?))\b"
GAME = r"\b(?:code in box|digital game code|download code|game card|video game|game disc)\b"
GAME_ALONE = r"^(?:game|games)(?: |$)|(?:^| )شريط(?: |$)"
GAME_ADDRESS = r"/playstation-games(?:/|$)"
CHASSIS = r"^CFI[127]\d"
CONTROLLER_BUNDLES = r"^(?:ps5 dualsense bundle|ps5 console bundle controller)$"
CONSOLE_WORDS = r"\b(?:sony|microsoft|nintendo|console|slim|pro|digital|disc|edition|bundle|new|used|refurbished|black|white|\d+(?:gb|tb))\b"

SIZED = r"\b\d+(?:gb|tb)\b"
DIGITAL = r"\b(?:digital|dig)\b"
DISC = r"\b(?:disc|blu ray)\b"
EITHER_EDITION = r"\b(?:digital|dig|disc)\b"
NAMED_EDITION = r"\b(?:digital|disc) edition\b"
CONSOLE_SIZE = r"\b(?:825gb|1tb|2tb)\b"
JOINING = r"\b(?:bundle|including|includes|with)\b"

#: What a text must contain one of to match a pattern: to look for it costs a small part of a search by pattern, and most texts have none.
NEEDS: dict[str, tuple[str, ...]] = {
    PLATFORM: ("ps4", "ps5", "xbox", "nintendo switch"),
    DISC_DRIVE: (" drive",),
    ACCESSORY: ("controller", "dualsense", "dual sense", "remote", "camera", "charging", "stick module", "headset", "adapt", "cover", "case", "plate", "shell", "skin", "decal", "accessor", "card", "drive", "fan", "mount", "hdd", "hub", "dock", "expander", "stand"),
    STORAGE_ACCESSORY: ("ssd", "nvme", "solid state drive", "storage expansion", "external usb"),
    STORAGE_PART: ("heat", "cooling plate", "enclosure", "ssd case", "thermal pad", "installation kit"),
    SSD_WITH_COOLING: ("heat",),
    CONSOLE_WITH_DRIVE: (" drive",),
    CONSOLE_HUB: ("hub",),
    CONTROLLER: ("dualsense", "controller"),
    CONTROLLER_PART: ("dualsense", "controller"),
    GAME: ("game", "code"),
    GAME_ALONE: ("game", "شريط"),
    SIZED: ("gb", "tb"),
    DIGITAL: ("dig",),
    DISC: ("disc", "blu ray"),
    EITHER_EDITION: ("dig", "disc"),
    NAMED_EDITION: (" edition",),
    CONSOLE_SIZE: ("825gb", "1tb", "2tb"),
    JOINING: ("bundle", "includ", "with"),
}

COLUMNS = ("kind", "platform", "edition", "size", "form", "is_bundle")


def console_text(text: Column) -> Column:
    """The normal text with `256 gb` as `256gb` and `PlayStation 5` as `ps5`."""
    return named_platform(joined_units(plain_text(F.coalesce(text, F.lit("")))))


def named_platform(plain: Column) -> Column:
    """`playstation 5` to `ps5`, in a normal text."""
    return F.regexp_replace(plain, r"\b(?:playstation|play station|ps) ?([45])\b", "ps$1")


def _contains(text: Column, *words: str) -> Column:
    """Whether a text (a column, since it's read for each word) contains one of the words. As a loop over an array it also keeps the projections apart: fused, they are one method that is too long for the JVM to compile."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def _has(text: Column, pattern: str) -> Column:
    if pattern == ARABIC_ACCESSORY:
        return (F.octet_length(text) > F.length(text)) & text.rlike(pattern)
    return _contains(text, *NEEDS[pattern]) & text.rlike(pattern)


def _any(text: Column, *patterns: str) -> Column:
    return reduce(Column.__or__, [_has(text, p) for p in patterns])


def _word(text: Column, word: str) -> Column:
    return text.contains(word) & text.rlike(rf"\b{word}\b")


def _first(text: Column, pattern: str) -> Column:
    """The first match, or null."""
    return F.when(_contains(text, *NEEDS[pattern]), F.nullif(F.regexp_extract(text, pattern, 0), F.lit("")))


def describe(offers: DataFrame, device: str | None = None) -> DataFrame:
    """Adds kind (console, game, accessory, product), platform, edition, size, form and is_bundle to offers.

    Read are title, model_number, storage and source_url, and `device`, a column that names the type of device and its series,
    if there is one. What is asked more than once of a title is a column, and what a title can't have isn't searched for.
    """
    raw, text, plain = F.coalesce("title", F.lit("")), F.col("_text"), F.col("_plain")
    rows = offers.withColumns({"_plain": plain_text(raw), "_device": console_text(F.col(device)) if device else F.lit(""), "_sku": F.regexp_replace(F.coalesce("model_number", F.lit("")), "[^A-Za-z0-9]", "")})
    # the steps of `console_text`, each where it can do anything
    rows = rows.withColumn("_plain", F.when(_contains(plain, " gb", " tb", " mb"), joined_units(plain)).otherwise(plain))
    rows = rows.withColumn("_text", F.when(_contains(plain, "ps", "play"), named_platform(plain)).otherwise(plain))
    rows, both = (rows.withColumn("_both", F.concat_ws(" ", "_text", "_device")), F.col("_both")) if device else (rows, text)
    package = _contains(text, " with ", " including ", " includes ", " plus ")
    part_of = lambda n: F.when(package, F.regexp_extract(text, PACKAGE, n)).otherwise(F.lit(""))
    # parts of the title: the console it begins with, what follows that, what stands before a lone +, a package's two sides
    rows = rows.withColumn("_own", text.startswith("ps") | text.startswith("sony ps"))
    own = F.col("_own")
    rows = rows.withColumns(
        {
            "_subject": F.when(own & text.contains(" console"), F.regexp_extract(text, CONSOLE_SUBJECT, 0)).otherwise(F.lit("")),
            "_plus": raw.contains("+") & raw.rlike(r"\s\+\s"),
            "_head": F.when(own, part_of(1)).otherwise(F.lit("")),
            "_tail": F.when(own, part_of(2)).otherwise(F.lit("")),
            "_cfi": F.lower("_sku").startswith("cfi") & F.col("_sku").rlike(f"(?i){CHASSIS}"),
            "_bundle": _word(text, "bundle"),
            "_console": _word(text, "console"),
            "_sized": _first(text, SIZED),
        }
    )
    behind = lambda whole: F.substring(whole, F.length("_subject") + 1, F.length(whole))
    rows = rows.withColumns(
        {
            "_base": F.when(F.col("_plus") & (F.col("_subject") != ""), behind(console_text(F.split(raw, r"\s+\+\s+")[0]))),
            "_before": F.when(F.col("_cfi") & F.col("_bundle"), F.split(text, r"\bbundle\b")[0]).otherwise(text),
            "_told": F.lower("storage"),
        }
    )
    base, before_bundle = F.col("_base"), F.col("_before")
    added = F.col("_plus") & ~_any(base, ACCESSORY, ARABIC_ACCESSORY)
    linked = behind(text).rlike(CONSOLE_LINK) & ~_has(text, CONSOLE_HUB)
    open_edition = before_bundle.rlike(r"\b(?:slim|pro)\b") & ~_any(before_bundle, ACCESSORY, ARABIC_ACCESSORY, STORAGE_ACCESSORY)
    part_only = _has(text, STORAGE_PART) & ~_has(text, SSD_WITH_COOLING)
    # why a title that names accessories can still be a console's
    rows = rows.withColumns(
        {
            "_included": (F.col("_subject") != "") & (added | linked) & _any(text, ACCESSORY, ARABIC_ACCESSORY, STORAGE_ACCESSORY),
            "_package": (F.col("_head") != "") & F.col("_head").rlike(EDITION_SUBJECT) & _has(F.col("_tail"), CONTROLLER) & ~_has(F.col("_tail"), CONTROLLER_PART),
            "_chassis": F.col("_cfi") & text.rlike(r"^sony ps[45]\b") & ~part_only,
        }
    )
    proven = F.col("_chassis") & F.col("_sized").isNotNull() & (F.col("_plus") | _has(text, JOINING)) & (_has(text, EITHER_EDITION) | open_edition)
    rows = rows.withColumn("_proven", proven)
    rows = rows.withColumn("is_bundle", F.col("_bundle") | F.col("_included") | F.col("_proven") | F.col("_package"))
    own_console = F.col("_bundle") & F.col("_console") & ~_has(text, CONSOLE_HUB)
    excused = own_console | F.col("_proven") | F.col("_package") | F.col("_included") | (_has(text, DISC_DRIVE) & _has(text, CONSOLE_WITH_DRIVE))
    drive = _has(text, STORAGE_ACCESSORY) & ~((own & text.rlike(CONSOLE_FIRST)) | F.col("_chassis") | F.col("_included"))
    address = F.lower("source_url").contains("/playstation-games") & F.col("source_url").rlike(f"(?i){GAME_ADDRESS}")
    game = _any(text, GAME, GAME_ALONE) | F.coalesce(address, F.lit(False))
    console = F.col("_package") | F.col("_cfi") | F.col("_console") | _any(text, NAMED_EDITION, CONSOLE_SIZE) | (own & text.rlike(r"^(?:sony )?ps[45](?: slim| pro)?$"))
    rows = rows.withColumn("_platform", F.coalesce(_first(text, PLATFORM), _first(F.col("_device"), PLATFORM)))
    kind = (
        F.when(F.col("_platform").isNull(), "product")
        .when(drive | (~excused & _any(both, ACCESSORY, ARABIC_ACCESSORY)), "accessory")
        .when(~(F.col("is_bundle") & (F.col("_console") | F.col("_package"))) & game, "game")
        .otherwise(F.when(console, "console").otherwise("game"))
    )
    out = rows.withColumns(
        {
            "kind": kind,
            "platform": F.col("_platform"),
            "edition": F.when(_has(both, DIGITAL), "digital").when(_has(text, DISC), "disc"),
            "size": F.coalesce(F.when(_contains(F.col("_told"), *NEEDS[SIZED]), F.nullif(F.regexp_extract(console_text(F.col("storage")), SIZED, 0), F.lit(""))), F.col("_sized")),
            "form": F.when(_word(text, "pro"), "Pro").when(_word(both, "slim"), "Slim").otherwise(""),
        }
    )
    return out.drop("_plain", "_text", "_both", "_device", "_sku", "_own", "_subject", "_plus", "_head", "_tail", "_cfi", "_bundle", "_console", "_sized", "_base", "_before", "_told", "_included", "_package", "_chassis", "_proven", "_platform")


def asked_kind(query: str) -> str | None:
    """The kind that a query (normal text) around a console asks for; None for other queries."""
    if not re.search(PLATFORM, query):
        return None
    subject = re.search(CONSOLE_SUBJECT, query)
    linked = subject and re.search(CONSOLE_LINK, query[subject.end() :]) and not re.search(CONSOLE_HUB, query)
    if re.search(CONTROLLER_BUNDLES, query) or re.search(CONSOLE_WITH_DRIVE, query) or (linked and re.search(f"{ACCESSORY}|{STORAGE_ACCESSORY}", query)):
        return "console"
    if re.search(rf"{ACCESSORY}|{ARABIC_ACCESSORY}|{STORAGE_ACCESSORY}|\bstorage\b", query):
        return "accessory"
    if re.search(rf"{GAME}|{GAME_ALONE}|\bgames?\b", query):
        return "game"
    rest = re.sub(CONSOLE_WORDS, "", re.sub(PLATFORM, "", query, count=1)).strip()
    return "game" if rest else "console"


def of_asked_kind(offers: DataFrame, query: str) -> DataFrame:
    """The offers, described, of the kind and on the platform that a query around a console asks for; all of them for other queries."""
    described, kind = describe(offers), asked_kind(query)
    if kind is None:
        return described
    return described.where((F.col("kind") == kind) & (F.col("platform") == re.search(PLATFORM, query)[0]))
