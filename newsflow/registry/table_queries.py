"""Queries on scans, keyed updates, ingest, coverage, reports and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow import schema
from newsflow.operators.keys import first_per_key, keyed_update, without_known
from newsflow.plans import coverage, enrich, ingest, report
from newsflow.plans.scoring import is_unscored
from newsflow.plans.train import inference_rows, significant_move, training_rows, training_sizes
from newsflow.registry import views
from newsflow.registry.base import SQL_DAY, SQL_STAMP, query, rounded, stamp
from newsflow.session import scratch_path
from newsflow.sources import sinks, tables

STAMP = SQL_STAMP.format("dt")

# Documents at different stages of enrichment: what a language lacks is what its next job has to fill.
V_STAGES = views.V_ARTICLES + """,
v_stages AS (SELECT id, CASE WHEN n_chars % 50 = 0 THEN '' ELSE ticker END AS ticker, dt, headline, url,
  CASE WHEN lang <> 'es' THEN n_chars % 7 / 7.0::DOUBLE END AS sentiment_combined,
  CASE WHEN lang NOT IN ('es', 'de') THEN CASE WHEN n_chars % 2 = 0 THEN 'Signal' ELSE 'Noise' END END AS sentiment_category,
  CASE WHEN lang IN ('en', 'fr') THEN n_chars / 10.0::DOUBLE END AS price_close,
  CASE WHEN lang = 'en' THEN n_chars % 100 / 1.0::DOUBLE END AS rsi_14,
  CASE WHEN lang = 'en' THEN n_chars / 9.0::DOUBLE END AS std_upper,
  CASE WHEN lang <> 'fr' THEN n_chars % 40 / 1.0::DOUBLE END AS vix_close,
  CASE WHEN lang <> 'de' THEN 0.5::DOUBLE END AS hour_sin,
  CASE WHEN lang = 'en' THEN n_chars % 9 - 4.0::DOUBLE END AS pct_change_eod FROM v_articles)"""


def staged(spark, sf_dir) -> DataFrame:
    n, lang = F.col("n_chars"), F.col("lang")
    return views.articles(spark, sf_dir).select(
        "id", F.when(n % 50 == 0, "").otherwise(F.col("ticker")).alias("ticker"), "datetime", "headline", "url", "text",
        F.when(lang != "es", n % 7 / 7.0).alias("sentiment_combined"),
        F.when(~lang.isin("es", "de"), F.when(n % 2 == 0, "Signal").otherwise("Noise")).alias("sentiment_category"),
        F.when(lang.isin("en", "fr"), n / 10.0).alias("price_close"),
        F.when(lang == "en", n % 100 / 1.0).alias("rsi_14"), F.when(lang == "en", n / 9.0).alias("std_upper"),
        F.when(lang != "fr", n % 40 / 1.0).alias("vix_close"), F.when(lang != "de", 0.5).alias("hour_sin"),
        F.when(lang == "en", n % 9 - 4.0).alias("pct_change_eod"),
    )


@query("q_scan", f"""WITH {V_STAGES} SELECT id, ticker, headline, url, {STAMP} AS datetime FROM v_stages WHERE pct_change_eod IS NOT NULL AND ticker = '3'""")
def scan(spark, sf_dir):
    # Written as the articles table and read back: the predicate and the five columns reach the scan.
    path = scratch_path(spark, "articles")
    sinks.write_version(schema.pad_articles(staged(spark, sf_dir)), path, by_date=False)
    rows = tables.read_articles(
        spark, path, ["id", "ticker", "headline", "url", "datetime"], "pct_change_eod IS NOT NULL AND ticker = '3'")
    return rows.withColumn("datetime", stamp("datetime"))


@query("q_unprocessed", f"""WITH {V_STAGES} SELECT id, sentiment_combined IS NULL OR sentiment_category IS NULL AS unscored,
  ticker <> '' AND (price_close IS NULL OR rsi_14 IS NULL) AS unpriced, hour_sin IS NULL AS no_temporal,
  pct_change_eod IS NULL AS no_outcome, pct_change_eod IS NULL AND sentiment_combined IS NOT NULL AS to_predict FROM v_stages""")
def unprocessed(spark, sf_dir):
    df = staged(spark, sf_dir)
    to_predict = inference_rows(df, "pct_change_eod", []).select("id", F.lit(True).alias("to_predict"))
    flags = df.select("id", is_unscored().alias("unscored"), enrich.is_unpriced().alias("unpriced"),
                      enrich.lacks_temporal().alias("no_temporal"), enrich.lacks_outcome().alias("no_outcome"))
    return flags.join(to_predict, "id", "left").fillna(False, ["to_predict"])


@query("q_pending_dates", f"""WITH {V_STAGES} SELECT DISTINCT {SQL_DAY.format('dt')} AS date FROM v_stages WHERE vix_close IS NULL""")
def pending_dates(spark, sf_dir):
    return enrich.dates_without_context(staged(spark, sf_dir)).select(F.date_format("date", "yyyy-MM-dd").alias("date"))


@query("q_tickers", f"""WITH {V_STAGES} SELECT DISTINCT ticker FROM v_stages WHERE ticker <> ''""")
def tickers(spark, sf_dir):
    return enrich.named_tickers(staged(spark, sf_dir))


@query("q_status", f"""WITH {V_STAGES} SELECT total, tickers, with_sentiment, with_price, with_bands,
    round(with_sentiment * 100.0::DOUBLE / total, 1) AS pct_sentiment, round(with_price * 100.0::DOUBLE / total, 1) AS pct_price,
    round(with_bands * 100.0::DOUBLE / total, 1) AS pct_bands, {SQL_STAMP.format('a')} AS earliest, {SQL_STAMP.format('b')} AS latest
  FROM (SELECT count(*) AS total, count(DISTINCT ticker) AS tickers, count(sentiment_combined) AS with_sentiment,
    count(price_close) AS with_price, count(std_upper) AS with_bands, min(dt) AS a, max(dt) AS b FROM v_stages)""")
def status(spark, sf_dir):
    return report.status(staged(spark, sf_dir)).withColumns({c: stamp(c) for c in ("earliest", "latest")})


@query("q_export_stats", f"""WITH {V_STAGES} SELECT total, with_sentiment, with_price, complete, with_predictions,
    round(with_sentiment * 100.0::DOUBLE / total, 1) AS pct_with_sentiment, round(with_price * 100.0::DOUBLE / total, 1) AS pct_with_price,
    round(complete * 100.0::DOUBLE / total, 1) AS pct_complete
  FROM (SELECT count(*) AS total, count(*) FILTER (sentiment_combined IS NOT NULL) AS with_sentiment,
    count(*) FILTER (price_close IS NOT NULL) AS with_price,
    count(*) FILTER (sentiment_combined IS NOT NULL AND price_close IS NOT NULL) AS complete,
    count(*) FILTER (sentiment_category IS NOT NULL) AS with_predictions FROM v_stages)""")
def export_stats(spark, sf_dir):
    return report.export_stats(staged(spark, sf_dir))


@query("q_backlog", f"""WITH {V_STAGES} SELECT count(pct_change_eod) AS with_outcome, count(*) FILTER (pct_change_eod IS NULL) AS lacks_outcome,
  count(*) FILTER (vix_close IS NULL) AS lacks_context, count(*) FILTER (hour_sin IS NULL) AS lacks_temporal,
  count(*) FILTER (sentiment_combined IS NULL OR sentiment_category IS NULL) AS unscored FROM v_stages""")
def backlog(spark, sf_dir):
    return report.backlog(staged(spark, sf_dir))


@query("q_recent_sample", f"""WITH {V_STAGES} SELECT id, ticker, {SQL_DAY.format('dt')} AS date, left(headline, 25) AS headline_short,
    round(sentiment_combined, 3) AS sent, round(price_close, 2) AS price, round(pct_change_eod, 2) AS chg_pct, round(std_upper, 2) AS upper,
    CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS width FROM v_stages WHERE price_close IS NOT NULL ORDER BY id DESC LIMIT 15""")
def recent_sample(spark, sf_dir):
    return report.recent_sample(schema.ensure_columns(staged(spark, sf_dir)))


@query("q_latest", f"""WITH {V_STAGES}, newest AS (SELECT id, ticker, dt, price_close, sentiment_category FROM v_stages ORDER BY dt DESC, id DESC LIMIT 2000)
  SELECT 'row' AS kind, CAST(id AS VARCHAR) AS value FROM newest
  UNION ALL SELECT DISTINCT 'ticker', ticker FROM newest
  UNION ALL SELECT DISTINCT 'category', coalesce(sentiment_category, 'Unprocessed') FROM newest""")
def latest(spark, sf_dir):
    rows = report.latest(schema.ensure_columns(staged(spark, sf_dir), {
        **schema.HEALED, "ml_confidence": "double"}))
    values = report.choices(rows).select(F.col("field").alias("kind"), "value")
    return rows.select(F.lit("row").alias("kind"), F.col("id").cast("string").alias("value")).unionByName(values)


def _export(mode: str, where: str):
    """Register the export of a mode: written as CSV, read back."""

    @query("q_export" if mode == "complete" else f"q_export_{mode}", f"""WITH {V_STAGES} SELECT id, coalesce(ticker, '') AS ticker, {STAMP} AS datetime,
      coalesce(headline, '') AS headline, url, round(sentiment_combined, 9) AS sentiment_combined, price_close, sentiment_category FROM v_stages WHERE {where}""")
    def export(spark, sf_dir):
        df = schema.pad_articles(staged(spark, sf_dir))
        path = scratch_path(spark, "export")
        sinks.export_csv(df, path, mode)
        back = sinks.read_export(spark, path)
        return back.select("id", F.coalesce("ticker", F.lit("")).alias("ticker"), stamp("datetime").alias("datetime"),
                           F.coalesce("headline", F.lit("")).alias("headline"), "url",
                           F.round("sentiment_combined", 9).alias("sentiment_combined"), "price_close", "sentiment_category")


_export("complete", "sentiment_combined IS NOT NULL AND price_close IS NOT NULL")
_export("all", "true")
_export("predicted", "sentiment_category IS NOT NULL")


SQL_UPSERT = """WITH up AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'Signal' END AS c, toxic / 2.0::DOUBLE AS m FROM labels
    UNION ALL SELECT doc_id + 1000000000, 'Noise', 1.0 FROM labels)
  SELECT d.doc_id AS id, CASE WHEN up.id IS NOT NULL THEN c ELSE 'old' END AS sentiment_category,
    CASE WHEN up.id IS NOT NULL THEN m ELSE 0.1 END AS ml_confidence FROM documents d LEFT JOIN up ON up.id = d.doc_id"""


def _label_updates(spark, sf_dir) -> DataFrame:
    """A NULL overwrites, and updates of unknown ids are ignored."""
    lab = views.table(spark, sf_dir, "labels")
    updates = lab.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "Signal").alias("sentiment_category"),
                         (F.col("toxic") / 2.0).alias("ml_confidence"))
    stray = lab.select((F.col("doc_id") + 1_000_000_000).alias("id"), F.lit("Noise").alias("sentiment_category"), F.lit(1.0).alias("ml_confidence"))
    return updates.unionByName(stray)


@query("q_upsert", SQL_UPSERT)
def upsert(spark, sf_dir):
    docs = views.articles(spark, sf_dir).select("id", F.lit("old").alias("sentiment_category"), F.lit(0.1).alias("ml_confidence"))
    return keyed_update(docs, _label_updates(spark, sf_dir), ["sentiment_category", "ml_confidence"])


@query("q_upsert_stored", SQL_UPSERT)
def upsert_stored(spark, sf_dir):
    """The same on the stored table: only the days of the updated rows are written anew."""
    docs = views.articles(spark, sf_dir).select(
        "id", F.date_trunc("month", "datetime").alias("datetime"), F.lit("old").alias("sentiment_category"), F.lit(0.1).alias("ml_confidence"))
    path = scratch_path(spark, "articles")
    sinks.write_version(docs, path)
    sinks.update_stored(spark, path, _label_updates(spark, sf_dir), ["sentiment_category", "ml_confidence"])
    return spark.read.parquet(path).select("id", "sentiment_category", "ml_confidence")


@query("q_reset", f"""WITH {V_STAGES} SELECT id, ticker, headline, url, CAST(NULL AS DOUBLE) AS sentiment_combined, CAST(NULL AS DOUBLE) AS price_close,
  CAST(NULL AS VARCHAR) AS sentiment_category FROM v_stages""")
def reset(spark, sf_dir):
    return schema.reset_derived(staged(spark, sf_dir)).select(
        "id", "ticker", "headline", "url", "sentiment_combined", "price_close", "sentiment_category")


@query("q_ensure_columns", f"""WITH {V_STAGES} SELECT id, price_close, CAST(NULL AS DOUBLE) AS macd, CAST(NULL AS DOUBLE) AS pct_change_1h,
  {len(schema.ARTICLES)} AS n_columns FROM v_stages""")
def ensure_columns(spark, sf_dir):
    padded = schema.pad_articles(schema.ensure_columns(staged(spark, sf_dir)))
    return padded.select("id", "price_close", "macd", "pct_change_1h", F.lit(len(padded.columns)).alias("n_columns"))


@query("q_training_frame", f"""WITH {V_STAGES}, live AS (SELECT * FROM v_stages WHERE pct_change_eod IS NOT NULL)
  SELECT id, {STAMP} AS datetime, round(sentiment_combined, 9) AS sentiment_combined, rsi_14, pct_change_eod,
    CAST(abs(pct_change_eod) >= 1.5 AS INT) AS significant_move FROM live""")
def training_frame(spark, sf_dir):
    df = staged(spark, sf_dir)
    target = schema.target_column("EOD")
    features, _ = schema.available_features(df, schema.CLASSIFIER_FEATURES)
    rows = training_rows(df, target, features, extra=())
    labelled = rows.withColumn("significant_move", significant_move(F.col(target))).withColumn("datetime", stamp("datetime"))
    return rounded(labelled, {"sentiment_combined": 9})


# --- pages ------------------------------------------------------------------------------------------------------

@query("q_page_links", r"""WITH a AS (
    SELECT page_id, replace(unnest(list_transform((string_split(html, '<a href="'))[2:], lambda x: string_split(x, '"')[1])), '&amp;', '&') AS link
    FROM pages)
  SELECT page_id, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link WHEN link LIKE '//%' THEN 'https:' || link
    WHEN link LIKE '/%' THEN 'https://finviz.com' || link WHEN link = '' THEN 'https://finviz.com/' ELSE 'https://finviz.com/' || link END AS url,
    count(*) AS n FROM a GROUP BY 1, 2""")
def page_links(spark, sf_dir):
    links = ingest.page_links(views.table(spark, sf_dir, "pages"))
    return links.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("n"))


@query("q_news_dedupe", """WITH batch AS (SELECT url, page_id, 1 AS seen FROM pages UNION ALL SELECT url, page_id + 1000000, 0 FROM pages WHERE length(html) % 2 = 0),
  host AS (SELECT url FROM pages WHERE contains(url, '/fr/'))
  SELECT url, arg_min(page_id, (seen, page_id)) AS page_id FROM batch WHERE url NOT IN (SELECT url FROM host) GROUP BY url""")
def news_dedupe(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages")
    batch = pages.select("url", "page_id", F.lit(1).alias("seen")).unionByName(
        pages.where(F.length("html") % 2 == 0).select("url", (F.col("page_id") + 1_000_000).alias("page_id"), F.lit(0).alias("seen")))
    stored = pages.where(F.col("url").contains("/fr/")).select("url")
    return without_known(first_per_key(batch, ["url"], ["seen", "page_id"]), stored, "url").select("url", "page_id")


# News pages made of the documents: 20 rows a page, newest first, every fifth with a date. Two documents in three
# share a link with a neighbour. Times are in winter, when Eastern is UTC - 5.
AS_OF = "2001-12-31 17:00:00"
V_NEWS = views.V_ARTICLES + r""",
v_news AS (SELECT id, id // 20 AS page_id, id % 20 AS pos, ticker,
  CASE WHEN id % 20 % 7 = 6 THEN NULL ELSE TIMESTAMP '2001-12-31 21:30:00' + to_days(CAST(-((id // 20) % 9) - (id % 20) // 5 * (2 + (id // 20) % 13) AS INT))
    - to_minutes(CAST(id % 20 % 5 * 61 AS BIGINT)) END AS dt,
  trim(regexp_replace(headline, '\s+', ' ', 'g')) || CASE WHEN id % 4 = 0 THEN ' — don''t €' ELSE '' END AS headline,
  CASE id % 3 WHEN 0 THEN 'https://finviz.com/news/' || (id // 2) || '?a=1&b=it''s two' WHEN 1 THEN 'https://n.example/' || (id // 4) ELSE 'https://cdn.example/' || (id // 2) END AS url
  FROM v_articles),
v_kept AS (SELECT * FROM (
  SELECT *, max(CASE WHEN dt < TIMESTAMP '2001-12-01 17:00:00' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS stopped
  FROM v_news) WHERE stopped = 0 AND dt IS NOT NULL)"""


def _escaped(text):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def news_pages(spark, sf_dir) -> DataFrame:
    """The pages as HTML. A page has 20 rows by construction."""
    n = F.col("id")
    page, pos = F.floor(n / 20), (n % 20).cast("int")
    back = (page % 9) + F.floor(pos / 5) * (F.lit(2) + page % 13)
    local = F.timestamp_seconds(
        F.unix_seconds(F.lit("2001-12-31 16:30:00").cast("timestamp")) - back * 86400 - (pos % 5) * 61 * 60)
    clock = F.date_format(local, "hh:mma")
    # All four forms of a date, and rows with a time only.
    dated = (
        F.when(back == 0, F.concat(F.lit("Today "), clock)).when(back == 1, F.concat(F.lit("Yesterday "), clock))
        .when(page % 4 == 2, F.concat_ws(" ", F.date_format(local, "MMM d"), clock)).otherwise(F.concat_ws(" ", F.date_format(local, "MMM-dd-yy"), clock)))
    cell = F.when(pos % 7 == 6, "n/a").when(pos % 5 == 0, dated).otherwise(clock)
    link = (
        F.when(n % 3 == 0, F.concat(F.lit("/news/"), F.floor(n / 2).cast("string"), F.lit("?a=1&amp;b=it's two")))
        .when(n % 3 == 1, F.concat(F.lit("https://n.example/"), F.floor(n / 4).cast("string")))
        .otherwise(F.concat(F.lit("//cdn.example/"), F.floor(n / 2).cast("string"))))
    title = F.trim(F.regexp_replace("headline", r"\s+", " "))
    row = F.concat(F.lit("<tr class='cursor'>\n<td width=130>"), cell, F.lit("</td><td><a class='tab-link' href=\""), link,
                   F.lit("\"><b>"), _escaped(title), F.when(n % 4 == 0, " &mdash; don&#x27;t &#8364;").otherwise(""), F.lit("</b></a> <span>src</span></td></tr>"))
    rows = views.articles(spark, sf_dir).select(page.alias("page_id"), pos.alias("pos"), row.alias("row"), "ticker")
    made = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "row"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["row"]), "")
    # A table whose id only begins alike, then the news as a table or inside a div, then a table that is none.
    decoy = F.lit("<html><body><table id=\"news-table-head\"><tr><td>Dec-01-01 10:00AM</td><td><a href='/no'>no</a></td></tr></table>")
    table = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<table id=\"news-table\">"), body, F.lit("</table>"))).otherwise(
        F.concat(F.lit("<div id=news-table class=x><table>"), body, F.lit("</table></div>")))
    html = F.concat(decoy, table, F.lit("<table><tr><td>Dec-01-01 10:00AM</td><td><a href='/no'>no</a></td></tr></table></body></html>"))
    return made.select("page_id", F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("ticker"), html.alias("html"))


@query("q_news_rows", f"WITH {V_NEWS} SELECT page_id, pos, {STAMP} AS datetime, headline, url FROM v_kept")
def news_rows(spark, sf_dir):
    rows = ingest.parse_pages(news_pages(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))
    return rows.select("page_id", "pos", stamp("datetime").alias("datetime"), "headline", "url")


@query("q_ingest_job", f"""WITH {V_NEWS}, stored AS (SELECT DISTINCT url FROM v_news WHERE page_id % 4 = 1 AND pos < 5),
  firsts AS (SELECT url, arg_min(struct_pack(dt := dt, headline := headline, ticker := 'P' || page_id), (page_id, pos)) AS r FROM v_kept
    WHERE url NOT IN (SELECT url FROM stored) GROUP BY url)
  SELECT url, r.ticker AS ticker, {SQL_STAMP.format('r.dt')} AS datetime, r.headline AS headline FROM firsts
  UNION ALL SELECT url, 'stored', '', '' FROM stored""")
def ingest_job(spark, sf_dir):
    pages = news_pages(spark, sf_dir)
    old = ingest.news_rows(pages).where("page_id % 4 = 1 AND pos < 5").select("url").distinct()
    stored = schema.pad_articles(old.withColumns({"ticker": F.lit("stored"), "headline": F.lit("")}))
    as_of = F.lit(AS_OF).cast("timestamp")
    once = ingest.ingest(pages, stored, as_of)
    twice = ingest.ingest(pages, once, as_of)  # a second run adds nothing
    return twice.select("url", "ticker", F.coalesce(stamp("datetime"), F.lit("")).alias("datetime"), "headline")


@query("q_stored_table", f"""WITH {V_NEWS}, firsts AS (SELECT url, arg_min(struct_pack(dt := dt, headline := headline), (page_id, pos)) AS r FROM v_kept GROUP BY url)
  SELECT url, {SQL_STAMP.format('r.dt')} AS datetime, {SQL_DAY.format('r.dt')} AS dt, r.headline AS headline FROM firsts""")
def stored_table(spark, sf_dir):
    """Create the table, append two ingest runs below its path, read through the table."""
    path, name = scratch_path(spark, "articles"), f"articles_{uuid.uuid4().hex}"
    schema.create_articles_table(spark, name, path)
    rows = ingest.parse_pages(news_pages(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))
    for part in (rows, rows):
        sinks.append_articles(spark.table(name), part, path, ["page_id", "pos", "ticker"])
        schema.refresh_articles_table(spark, name)
    return spark.table(name).select("url", stamp("datetime").alias("datetime"), F.date_format("dt", "yyyy-MM-dd").alias("dt"), "headline")


# --- coverage ---------------------------------------------------------------------------------------------------

# Four kinds of pages: full news table, one-row table, news words with a date, news words without one; then raw pages.
@query("q_has_news", """WITH made AS (SELECT DISTINCT doc_id // 20 AS p FROM documents),
  sized AS (SELECT p, (SELECT count(*) FROM documents WHERE doc_id // 20 = p) AS n FROM made)
  SELECT 'P' || p AS ticker, CASE p % 5 WHEN 0 THEN n > 1 WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE NULL END AS has_news,
    CASE p % 5 WHEN 0 THEN CASE WHEN n > 1 THEN 'news_table_' || n || '_rows' ELSE 'no_news_found' END WHEN 2 THEN 'news_pattern_latest news'
      WHEN 4 THEN NULL ELSE 'no_news_found' END AS reason FROM sized
  UNION ALL SELECT 'R' || page_id, false, 'no_news_found' FROM pages""")
def has_news(spark, sf_dir):
    kinds = _page_kinds(spark, sf_dir)
    return kinds.select("ticker", coverage.news_check(F.col("html")).alias("c")).select("ticker", "c.has_news", "c.reason")


def _page_kinds(spark, sf_dir) -> DataFrame:
    """(page_id, ticker, html) of the made pages, of five kinds, and of the raw ones."""
    p = F.col("page_id")
    # A block whose first child ends early: rows and links behind it count.
    kinds = (
        F.when(p % 10 == 0, F.col("html")).when(p % 5 == 0, F.regexp_replace("html", "<div id=news-table class=x>", "<div id=news-table class=x><div>head</div>"))
        .when(p % 5 == 1, "<div class='x-news-box'><table class='my-news'><tr><td><a href='/a'>one</a></td></tr></table></div>")
        .when(p % 5 == 2, F.concat(F.lit("<p>Latest News, "), F.lit("Today</p>"), F.lit("<p>Nov-12</p>")))
        .when(p % 5 == 3, "<p>Breaking News</p>"))
    made = news_pages(spark, sf_dir).select("page_id", "ticker", kinds.alias("html"))
    raw = views.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("R"), F.col("page_id").cast("string")).alias("ticker"), "html")
    return made.unionByName(raw)


# Pages of a ticker: made ones of five kinds and raw ones, by number; of several pages one with news counts.
V_COVER = """u AS (SELECT DISTINCT upper(c_mktsegment || '-' || c_nationkey) AS ticker, c_nationkey AS n FROM customer),
  news AS (SELECT ticker FROM u WHERE n < 6),
  none AS (SELECT ticker, CASE WHEN n % 3 < 2 THEN TIMESTAMP '2024-05-01' + to_days(n) END AS seen_at FROM u WHERE n BETWEEN 6 AND 14),
  done AS (SELECT ticker FROM news UNION SELECT ticker FROM none WHERE seen_at IS NOT NULL
    AND epoch(TIMESTAMP '2024-06-10' - seen_at) < 30 * 86400),
  todo AS (SELECT ticker FROM u EXCEPT SELECT ticker FROM done),
  made AS (SELECT doc_id // 20 AS p, count(*) AS rows FROM documents GROUP BY 1),
  checked AS (SELECT p % 25 AS n, CASE p % 5 WHEN 0 THEN rows > 1 WHEN 2 THEN true ELSE false END AS has_news FROM made WHERE p % 5 < 4
    UNION ALL SELECT page_id % 25, false FROM pages),
  pg AS (SELECT u.ticker, bool_or(c.has_news) AS has_news FROM u JOIN checked c USING (n) WHERE n % 4 < 3 GROUP BY 1),
  cover AS (SELECT ticker, true AS has_news FROM news UNION ALL SELECT t.ticker, pg.has_news FROM todo t JOIN pg USING (ticker)
    UNION ALL SELECT ticker, false FROM none WHERE ticker NOT IN (SELECT t.ticker FROM todo t JOIN pg USING (ticker)))"""


def _coverage(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = views.table(spark, sf_dir, "customer")
    name = F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string"))
    raw = c.select(F.lower(name).alias("Ticker"), "c_nationkey")
    universe = tables.universe(raw)
    # The caches are JSON texts, as the jobs find them; one text per segment here.
    known = raw.where("c_nationkey < 6").select(F.upper("Ticker").alias("t"), "c_nationkey").distinct()
    with_json = known.groupBy("c_nationkey").agg(F.to_json(F.collect_set("t")).alias("value"))
    missed = raw.where("c_nationkey between 6 and 14").select(F.upper("Ticker").alias("t"), "c_nationkey").distinct()
    at = F.when(F.col("c_nationkey") % 3 < 2, F.date_format(F.date_add(F.lit("2024-05-01").cast("date"), F.col("c_nationkey")), "yyyy-MM-dd'T'HH:mm:ss"))
    without_json = missed.groupBy("c_nationkey").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("t", F.coalesce(at, F.lit("bad")))))).alias("value"))
    own = raw.where("c_nationkey % 4 < 3").select(F.upper("Ticker").alias("ticker"), F.col("c_nationkey").alias("n")).distinct()
    pages = _page_kinds(spark, sf_dir).select((F.col("page_id") % 25).alias("n"), "html").join(own, "n").select("ticker", "html")
    done = coverage.coverage_job(
        universe, tables.json_list(with_json), tables.json_map(without_json), pages,
        F.lit("2024-06-10 00:00:00").cast("timestamp"), recheck_days=30)
    return done, universe


@query("q_coverage", f"WITH {V_COVER} SELECT ticker, has_news FROM cover")
def cover(spark, sf_dir):
    done, _ = _coverage(spark, sf_dir)
    path = scratch_path(spark, "coverage")
    sinks.write_coverage(done, path)
    return spark.read.schema("ticker string, has_news boolean, checked_at timestamp, reason string").json(path).select("ticker", "has_news")


@query("q_coverage_summary", f"""WITH {V_COVER} SELECT count(*) FILTER (has_news) AS with_news, count(*) FILTER (NOT has_news) AS without_news,
  count(*) AS processed, (SELECT count(*) FROM u) AS universe, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM u), 1) AS completion_pct FROM cover""")
def cover_summary(spark, sf_dir):
    return coverage.summary(*_coverage(spark, sf_dir))


@query("q_coverage_letters", f"""WITH {V_COVER} SELECT left(ticker, 1) AS letter, count(*) AS n FROM cover WHERE has_news GROUP BY 1""")
def cover_letters(spark, sf_dir):
    return coverage.by_first_letter(_coverage(spark, sf_dir)[0])


@query("q_coverage_sample", f"""WITH {V_COVER} SELECT ticker FROM cover WHERE has_news ORDER BY ticker LIMIT 20""")
def cover_sample(spark, sf_dir):
    return coverage.sample_tickers(_coverage(spark, sf_dir)[0])


# --- gates and fallbacks ----------------------------------------------------------------------------------------

@query("q_training_gate", f"""WITH {V_STAGES} SELECT 'eod' AS horizon, count(pct_change_eod) AS rows, count(pct_change_eod) >= {schema.MIN_TRAINING_ROWS} AS enough FROM v_stages
  UNION ALL SELECT '1hr', 0, false UNION ALL SELECT '4hr', 0, false""")
def training_gate(spark, sf_dir):
    return training_sizes(schema.ensure_columns(staged(spark, sf_dir)))


@query("q_no_bars", "SELECT doc_id AS id, CAST(NULL AS DOUBLE) AS price_close, CAST(NULL AS DOUBLE) AS rsi_14 FROM documents")
def no_bars(spark, sf_dir):
    """A price source without rows has the columns of one with rows: the job runs and prices nothing."""
    daily = enrich.daily_indicators(tables.normalise_bars(tables.empty_bars(spark)), views.AS_OF)
    return enrich.enrich_prices(views.articles(spark, sf_dir), daily).select("id", "price_close", "rsi_14")
