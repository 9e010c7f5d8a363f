"""Texts: normal forms, tokens, similarity, and what product titles say."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

_NOT_WORD = re.compile(r"[^\w]+|_+")
_MARKS = re.compile("[ً-ٰٟ]")
_FOLDED = str.maketrans("أإآىة", "اااي" + "ه")


@F.pandas_udf(StringType())
def normalize_text(values: pd.Series) -> pd.Series:
    """NFKC, lower case, Arabic marks and letter forms folded, other characters to single spaces. NFKC has no built-in function, hence Arrow batches."""

    def one(v: str | None) -> str:
        v = _MARKS.sub("", unicodedata.normalize("NFKC", v or "").lower()).translate(_FOLDED)
        return _NOT_WORD.sub(" ", v).strip()

    return values.map(one)


def plain_text(text: Column) -> Column:
    """Lower case, everything but letters and digits of any script to single spaces; without NFKC, in built-in functions."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(plain_text(text), " "), lambda t: t != "")


def token_similarity(a: Column, b: Column) -> Column:
    """Shared distinct tokens over those of the larger set; 0 if either has none."""
    return distinct_similarity(F.array_distinct(a), F.array_distinct(b))


def distinct_similarity(x: Column, y: Column) -> Column:
    """`token_similarity` of tokens that don't repeat."""
    larger = F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / larger)


def joined_units(text: Column) -> Column:
    """`256 gb` to `256gb`."""
    return F.regexp_replace(text, r"([0-9]+) (gb|tb|mb)( |$)", "$1$2$3")


def screen_size(text: Column) -> Column:
    """`15,6"` and `15.6 inches` to `15.6inch`; otherwise the plain text with joined units."""
    raw = F.lower(F.trim(text))
    size = F.regexp_extract(raw, r'^([0-9]+([.,][0-9]+)?) *("|″|inch(es)?|in\.?)$', 1)
    number = F.translate(size, ",", ".")
    return F.when(size != "", F.concat(F.regexp_replace(number, r"\.0+$", ""), F.lit("inch"))).otherwise(joined_units(plain_text(text)))


def capacity_gb(text: Column) -> Column:
    """The storage in GB that a text names, if it names just one."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+) ?(gb|tb)"), F.lit(0))
    sizes = F.array_distinct(F.transform(found, lambda x: F.regexp_extract(x, "([0-9]+)", 1).cast("int") * F.when(x.endswith("tb"), 1024).otherwise(1)))
    return F.when(F.size(sizes) == 1, sizes[0])


#: The conditions that schema.org names.
SCHEMA_CONDITIONS = {"newcondition": "new", "usedcondition": "used", "refurbishedcondition": "refurbished"}
#: What words say of a condition and of a stock; the first that are found decide.
CONDITION_WORDS = (
    ("unknown", r"(not|non|never)\s+(brand\s+)?new"),
    ("refurbished", r"refurbished?|renewed|remanufactured"),
    ("open_box", r"open\s*box"),
    ("used", r"like\s*new|used|pre\s*owned|second\s*hand"),
    ("new", r"new"),
)
STOCK_WORDS = (
    ("out_of_stock", r"unavailable|not\s+available|out\s+of\s+stock|outofstock|sold\s+out"),
    ("preorder", r"pre\s*order"),
    ("in_stock", r"in\s*stock|available"),
)


def _said(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """The first state of the table whose words a text has; unknown if none."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[_-]+", " "))
    # states in their own name, as most come, need no search
    plain = F.lower(F.trim(text))
    return F.coalesce(F.when(text.isNull(), "unknown"), *[F.when(plain == state.replace("_", " "), F.lit(state)) for state, _ in table if state not in ("unknown", "preorder")], *[F.when(spaced.rlike(rf"(?<![a-z0-9_])({words})(?![a-z0-9_])"), F.lit(state)) for state, words in table], F.lit("unknown"))


def normalize_condition(text: Column) -> Column:
    """new, used, refurbished, open_box or unknown from a schema.org name or free text. Addresses other than schema.org's, and negated claims, say nothing."""
    raw = F.trim(text)
    name = F.lower(F.regexp_extract(raw, r"^(?:https?://schema\.org/)?([A-Za-z]+Condition)/?$", 1))
    named = F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in SCHEMA_CONDITIONS.items()], F.lit("unknown"))
    silent = raw.isNull() | (F.length(raw) > 256) | ((name == "") & raw.rlike("(?i)^[a-z][a-z0-9+.-]*:"))
    return F.when(silent, "unknown").when(name != "", named).otherwise(_said(raw, CONDITION_WORDS))


def normalize_availability(text: Column) -> Column:
    """in_stock, out_of_stock, preorder or unknown from free text."""
    return _said(text, STOCK_WORDS)


@F.pandas_udf(StringType())
def folded_text(values: pd.Series) -> pd.Series:
    """Words of a text under NFKC and case folding, by single spaces; neither is built in."""
    return values.map(lambda v: " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", v or "").casefold())))


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, a column of the table at a time: each bit of `open_` stands for a character of `a` that adds nothing yet."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = open_ = (1 << len(a)) - 1
    for y in b:
        if (here := places.get(y)) is not None:
            taken = open_ & here
            open_ = ((open_ + taken) | (open_ - taken)) & every
    return len(a) - open_.bit_count()


@F.pandas_udf(DoubleType())
def fuzzy_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """How alike two texts are, from 0 to 100: twice their longest common subsequence over both lengths. Two empty texts are alike."""

    def one(a: str | None, b: str | None) -> float:
        a, b = a or "", b or ""
        return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


#: Fixed value: how models of phones, consoles and vacuums are named in a normal text.
MODEL_PATTERN = r"\b(?:iphone (?:air|\d+)(?: pro(?: max)?| plus| air)?|galaxy s\d+(?: ultra| plus| fe| edge)?|pixel \d+(?: pro)?|ps[45](?: slim| pro)?|dyson v\d+)\b"


def models(text: Column) -> Column:
    """All models that a normal text names."""
    return F.regexp_extract_all(text, F.lit(MODEL_PATTERN), F.lit(0))


#: Words that ask, and so say nothing about what is asked for.
ASKING_WORDS = ("ابغي", "ابي", "اريد", "ابحث", "عن", "لي", "بافضل", "افضل", "ارخص", "سعر", "اشتري", "please", "find")
#: The capacities that a phone's name may have without a unit.
BARE_CAPACITIES = ("64", "128", "256", "512", "1024")
_DIGITS = {0x0660 + i: str(i) for i in range(10)} | {0x06F0 + i: str(i) for i in range(10)}


def phrase_rewriter(phrases: dict[str, str]) -> Callable[[str], str]:
    """Rewrites phrases that stand between spaces, the longest first, in one pass over a normal text."""
    if not phrases:
        return lambda text: text
    longest_first = sorted(phrases, key=lambda p: (-len(p), p))
    pattern = re.compile(r"(?<!\S)(" + "|".join(map(re.escape, longest_first)) + r")(?!\S)")
    return lambda text: pattern.sub(lambda m: phrases[m[1]], text)


def query_normalizer(aliases: dict[str, str], lexicon: dict[str, str]) -> Callable[[Column], Column]:
    """A function of columns that brings shoppers' queries into one form.

    aliases: names in Arabic letters and what they stand for; lexicon: retail phrases of other languages. Both are tables of
    normal texts, given as parameters; texts without Arabic letters skip the first. Python runs in Arrow batches, since NFKC
    and a table of phrases have no built-in function.
    """
    known, foreign = phrase_rewriter(aliases), phrase_rewriter(lexicon)
    asking = re.compile(r"(?<!\S)(?:" + "|".join(ASKING_WORDS) + r")(?!\S)")
    bare = re.compile(r"\b(" + "|".join(BARE_CAPACITIES) + r")(?= |$)(?! (?:gb|tb)\b)")

    def one(value: str | None) -> str:
        text = unicodedata.normalize("NFKC", value or "").lower()
        text = re.sub(r"\b(s\d{1,3})\s*\+", r"\1 plus ", text)  # a plus behind a model is a word of its name
        text = _MARKS.sub("", text.translate(_DIGITS)).replace("ـ", "").translate(_FOLDED)
        text = _NOT_WORD.sub(" ", text).strip()
        text = re.sub(r"\b(\d+)(?:st|nd|rd|th)\b", r"\1", text)
        if re.search("[؀-ۿ]", text):
            text = re.sub(r"([ء-ي])(?=\d)", r"\1 ", text)
            text = known(re.sub(r"(\d)(?=جيجا|تيرا)", r"\1 ", text))
        text = foreign(text)
        if re.search(r"\b(?:iphone|galaxy)\b", text):
            text = bare.sub(r"\1gb", text)
        text = asking.sub(" ", text)
        text = re.sub(r"\b(iphone|airpods|ps)\s*(\d+)", r"\1 \2", text)
        text = re.sub(r"\bps (\d+)\b", r"ps\1", re.sub(r"\bplaystation\s+(\d+)\b", r"ps \1", text))
        return " ".join(re.sub(r"\b(\d+)\s+(gb|tb|mb|mah|mp)\b", r"\1\2", text).split())

    @F.pandas_udf(StringType())
    def normalize(values: pd.Series) -> pd.Series:
        return values.map(one)

    return normalize
