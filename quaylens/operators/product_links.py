"""Links of result pages that lead to products: anchors and the addresses in a page's data, scored by a query's words.

Cases: a null or empty page has no links. Repeated links count once, at their first place. An address is kept as it is written,
without fragment and entities; letters beyond ASCII aren't encoded. Without words each link scores a half. An empty table gives
an empty result; extra columns aren't read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylens.functions.text import plain_text
from quaylens.functions.urls import host

# Ways in which a page writes an address, files that are no pages, and the least share of a query's words.
ANCHOR = r"(?is)<a\b[^>]*href=[\"']([^\"'#]+)[\"'][^>]*>(.*?)</a>"
IN_DATA = (
    r"(?i)[\"']((?:https?:)?(?:\\?/){1,2}[^\"' <>\s]+)[\"']",
    r"(?i)[\"']((?:https?:)?(?:\\u002F){1,2}[^\"'<>]+)[\"']",
)
BY_NAME = r"(?i)[\"'](?:canonicalUrl|productUrl|productDetailUrl|seoUrl|seoLinkUrl|linkUrl|url)[\"']\s*:\s*[\"']([^\"']*)[\"']"
NO_PAGE = r"(?i)\.(?:avif|gif|jpe?g|png|svg|webp|ico|woff2?|ttf|css|js)/?$"
LEAST_SHARE = 0.2
ENTITIES = {"&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def _decoded(text: Column) -> Column:
    for name, sign in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def product_links(pages: DataFrame, query: str, product_path: str, most: int | None = None) -> DataFrame:
    """page_id, link, label, score and place of the links of each page (page_id, url, html) to products of its own host, the best first.

    `product_path` is the pattern of a merchant's product pages, over path and query. A page's links are read, made absolute and
    filtered in its own row; only distinct ones are shuffled, and `most` lets Spark keep that many of a page before the sort.
    """
    words = [w for w in re.sub(r"[^\w]+|_", " ", query.lower()).split() if len(w) >= 2]
    html = F.coalesce("html", F.lit(""))
    plain = _decoded(html)
    anchors = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("label"))
    bare = lambda hrefs: F.transform(hrefs, lambda h: F.struct(h.alias("href"), F.lit("").alias("label")))
    found = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    rooted = lambda hrefs: F.transform(hrefs, lambda h: F.when(h.rlike(r"(?i)^(?:https?:|/|\\/|\\u002F)"), h).otherwise(F.concat(F.lit("/"), h)))
    data = lambda text: F.concat(*[bare(found(text, p)) for p in IN_DATA], bare(rooted(found(text, BY_NAME))))
    both = F.when(plain == html, F.concat(anchors, data(html))).otherwise(F.concat(anchors, data(html), data(plain)))
    # made plain within the array: what follows the explosion refers to them many times
    href = lambda c: F.regexp_replace(F.regexp_replace(_decoded(F.trim(c["href"])), r"(?i)\\u002F", "/"), r"\\/", "/")
    label = lambda c: F.trim(F.regexp_replace(F.regexp_replace(_decoded(c["label"]), "<[^>]*>", " "), r"\s+", " "))
    cleaned = F.transform(both, lambda c: F.struct(href(c).alias("href"), label(c).alias("label")))
    rows = pages.select("page_id", "url", F.posexplode(cleaned).alias("at", "c")).select("page_id", "url", "at", F.col("c.href").alias("_href"), F.col("c.label").alias("label"))
    root = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    beside = F.regexp_extract("url", "^https?://[^/?#]+((?:/[^?#]*)?/)", 1)
    full = (
        F.when(F.col("_href").rlike("(?i)^https?://"), F.col("_href"))
        .when(F.col("_href").startswith("//"), F.concat(F.regexp_extract("url", "^(https?:)", 1), "_href"))
        .when(F.col("_href").startswith("/"), F.concat(root, "_href"))
        .when(~F.col("_href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(root, F.when(beside == "", "/").otherwise(beside), "_href"))
    )
    rows = rows.withColumn("link", F.regexp_replace(full, "#.*$", ""))
    behind = F.regexp_extract("link", "^https://[^/?#]+(.*)$", 1)
    own = F.col("link").rlike("^https://[^/?#@]+(?:[/?]|$)") & (host(F.col("link")) == host(F.col("url")))
    rows = rows.where(own & behind.rlike(product_path) & ~F.regexp_extract(behind, r"^([^?]*)", 1).rlike(NO_PAGE))
    rows = rows.select("page_id", "link", "at", "label")
    text = plain_text(F.concat_ws(" ", "label", "link"))
    hits = sum((F.when(F.col("_said").contains(w), 1).otherwise(0) for w in words), F.lit(0))
    rows = rows.withColumn("_said", text).withColumn("score", hits / F.lit(float(len(words))) if words else F.lit(0.5))
    if len(words) > 1:
        rows = rows.where(F.col("score") >= LEAST_SHARE)
    first = rows.groupBy("page_id", "link").agg(F.min(F.struct("at", "label", "score")).alias("f")).select("page_id", "link", "f.*")
    out = first.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "at", "link"))).drop("at")
    return out.where(F.col("place") <= most) if most is not None else out
