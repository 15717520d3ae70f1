"""URL columns."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_join(link: Column, base: str) -> Column:
    """Resolve a link against a fixed base address (base path is a folder)."""
    parts = urlsplit(base)
    origin = f"{parts.scheme}://{parts.netloc}"
    folder = parts.path.rsplit("/", 1)[0] + "/" if parts.path else "/"
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.lit(f"{parts.scheme}:"), link))
        .when(link.startswith("/"), F.concat(F.lit(origin), link))
        .when(link == "", F.lit(base))
        .otherwise(F.concat(F.lit(origin + folder), link))
    )


def partition_key(ticker: Column) -> Column:
    """Ticker as a path-safe partition value."""
    return F.upper(F.translate(ticker, "/", "_"))


def price_ticker(ticker: Column) -> Column:
    """Ticker as the price source spells it."""
    return F.translate(ticker, ".", "-")
