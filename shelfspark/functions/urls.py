"""URL parts, link resolution and the product-page rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.strings import strip

#: Product pages end in `/p/<digits>`.
PRODUCT_PATH = r"/p/\d+$"


def resolve_link(base: Column, href: Column) -> Column:
    """A rooted href against the scheme and host of the page it stands on."""
    root = F.concat(
        F.try_parse_url(base, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(base, F.lit("AUTHORITY"))
    )
    return F.when(href.startswith("/"), F.concat(root, href)).otherwise(href)


def site_name(url: Column) -> Column:
    """Host and port without any `www.`; '' if the URL names no host."""
    host = F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))
    return F.replace(host, F.lit("www."), F.lit(""))


def is_product_url(url: Column, path_pattern: str = PRODUCT_PATH) -> Column:
    """Does the path look like a product page? Unreadable URLs are no product."""
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")).rlike(path_pattern), F.lit(False))


def is_yes(answer: Column) -> Column:
    """Reads a yes/no answer: `sí` or `si` in any case; null is no."""
    return F.coalesce(F.lower(strip(answer)).isin("sí", "si"), F.lit(False))
