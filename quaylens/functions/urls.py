"""Addresses as identities: the parts that say where a product is sold, without tracking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = r"(?i)^(utm_.*|gclid|fbclid|ref|aff|affiliate)$"
COMPARISON_TRACKING = r"(?i)^(utm_|campaign|gclid|fbclid|gad_|gbraid|wbraid)"


def _rest(url: Column, pattern: str) -> tuple[Column, Column]:
    """What stands before the query, and the query without parameters whose name matches."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).rlike(pattern))
    return F.regexp_replace(plain, r"\?.*$", ""), F.array_join(kept, "&")


def canonical_url(url: Column) -> Column:
    """https only and without credentials; lower-case host without www, no trailing slashes, fragment or tracking. Null for anything else."""
    once = lambda value, then: F.get(F.transform(F.array(value), then), 0)  # noqa: E731  a value that is used several times is worked out once

    def whole(p: Column) -> Column:
        path = F.when(p["path"] == "", "/").otherwise(p["path"])
        return F.when(p["host"] != "", F.concat(F.lit("https://"), p["host"], path, F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"]))))

    def parts(r: Column) -> Column:
        host = F.regexp_replace(F.lower(F.regexp_extract(r["head"], "^https://([^/@]+)(/.*)?$", 1)), r"^www\.", "")
        path = F.regexp_replace(F.regexp_extract(r["head"], "^https://[^/@]+(/.*)?$", 1), "/+$", "")
        return once(F.struct(host.alias("host"), path.alias("path"), r["query"].alias("query")), whole)

    head, query = _rest(url, TRACKING)
    return once(F.struct(head.alias("head"), query.alias("query")), parts)


def comparison_url(url: Column) -> Column:
    """Only the fragment and tracking go; other texts stay as they are."""
    head, query = _rest(url, COMPARISON_TRACKING)
    return F.when(F.trim(url).rlike("(?i)^https?://"), F.concat(head, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))).otherwise(F.coalesce(url, F.lit("")))


def is_url(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"(?i)^https?://[^\s/]+"), F.lit(False))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)), r"^www\.", "")
