"""Ingest: news tables of pages to articles, de-duplicated by URL."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from newsflow.functions import html
from newsflow.functions.temporal import news_time
from newsflow.functions.urls import url_join
from newsflow.operators.keys import insert_ignore
from newsflow.operators.stage import computed
from newsflow.schema import pad_articles
from newsflow.sources.sinks import with_ids

DAYS_BACK = 30
BASE_URL = "https://finviz.com/"
ROWS = "array<struct<pos:int,cell:string,full:string,link:string,headline:string>>"
LINKS = "array<struct<pos:int,link:string,label:string>>"


def _read(pages: DataFrame, keep: Sequence[str], read: Callable[[str | None], list[tuple]], kind: str) -> DataFrame:
    """Columns `keep` and `rows`, what `read` finds in the page: one narrow pass over the pages, in Arrow batches."""
    struct = to_arrow_type(T._parse_datatype_string(kind))
    names = [f.name for f in struct.value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[dict(zip(names, row)) for row in read(html)] for html in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, struct)], names=[*keep, "rows"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, "html").mapInArrow(run, f"{kinds}, rows {kind}")


def page_links(pages: DataFrame, base: str = BASE_URL) -> DataFrame:
    """All links of the pages in order: (page_id, pos, url, label)."""
    each = _read(pages, ["page_id"], html.links, LINKS).select("page_id", F.inline("rows"))
    return each.select("page_id", "pos", url_join(F.col("link"), base).alias("url"), "label")


def news_rows(pages: DataFrame, base: str = BASE_URL) -> DataFrame:
    """Rows of the news tables: (page_id, ticker, pos, cell, url, headline)."""
    each = _read(pages, ["page_id", "ticker"], html.news_rows, ROWS).select("page_id", "ticker", F.inline("rows"))
    return each.select("page_id", "ticker", "pos", "cell", url_join(F.col("link"), base).alias("url"), "headline")


def recent(rows: Column, as_of: Column, days_back: int = DAYS_BACK) -> Column:
    """Rows of one page with their UTC time `datetime`, up to the first one older than the limit; those without a valid time go.

    A cell with only a time has the date of the last dated row of its page in `full`.
    """
    timed = F.transform(rows, lambda r: F.struct(
        r["pos"].alias("pos"), r["link"].alias("link"), r["headline"].alias("headline"), news_time(r["full"], as_of).alias("datetime")))
    limit = as_of - F.make_dt_interval(F.lit(days_back))
    old = F.array_position(F.transform(timed, lambda r: F.coalesce(r["datetime"] < limit, F.lit(False))), True)
    upto = F.when(old > 0, F.slice(timed, F.lit(1), (old - 1).cast("int"))).otherwise(timed)
    return F.filter(upto, lambda r: r["datetime"].isNotNull())


def parse_pages(pages: DataFrame, as_of: Column, days_back: int = DAYS_BACK, base: str = BASE_URL) -> DataFrame:
    """Pages to news rows with times: (page_id, pos, ticker, datetime, headline, url, text)."""
    read = computed(_read(pages, ["page_id", "ticker"], html.news_rows, ROWS), {"rows": recent(F.col("rows"), as_of, days_back)})
    each = read.select("page_id", "ticker", F.inline("rows"))
    return each.select("page_id", "pos", "ticker", "datetime", "headline", url_join(F.col("link"), base).alias("url"), F.lit("").alias("text"))


def new_articles(pages: DataFrame, stored: DataFrame, as_of: Column, days_back: int = DAYS_BACK,
                 base: str = BASE_URL) -> DataFrame:
    """Articles of the pages that are not stored yet, one per URL (lowest page, position, ticker), padded to
    the table's columns, with ids from the URL."""
    found = parse_pages(pages, as_of, days_back, base)
    fresh = insert_ignore(stored, found, "url", ["page_id", "pos", "ticker"])
    return pad_articles(with_ids(fresh).drop("page_id", "pos"))


def ingest(pages: DataFrame, stored: DataFrame, as_of: Column, days_back: int = DAYS_BACK) -> DataFrame:
    """The table after an ingest run: stored rows plus the new ones."""
    return stored.unionByName(new_articles(pages, stored, as_of, days_back), allowMissingColumns=True)
