"""Time columns: calendar parts, cyclic hour, target days, zones, news times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"
MARKET_CLOSE_HOUR = 16


def hour_sin(ts: Column) -> Column:
    return F.sin(F.lit(2.0) * F.pi() * F.hour(ts) / F.lit(24.0))


def hour_cos(ts: Column) -> Column:
    return F.cos(F.lit(2.0) * F.pi() * F.hour(ts) / F.lit(24.0))


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def market_date(ts: Column) -> Column:
    """Eastern calendar date of a UTC time: the trading day the item belongs to."""
    return F.to_date(F.from_utc_timestamp(ts, EASTERN))


def eod_date(ts: Column) -> Column:
    """Day whose close settles the end-of-day outcome: next day from the closing hour on."""
    return F.date_add(F.to_date(ts), (F.hour(ts) >= MARKET_CLOSE_HOUR).cast("int"))


def eow_date(ts: Column) -> Column:
    """Friday that settles the end-of-week outcome; the following one once Friday has closed."""
    to_friday = F.pmod(F.lit(4) - F.weekday(ts), F.lit(7))
    late = (to_friday == 0) & (F.hour(ts) >= MARKET_CLOSE_HOUR)
    return F.date_add(F.to_date(ts), F.when(late, 7).otherwise(to_friday))


def pct_change(after: Column, before: Column) -> Column:
    """Change in percent; NULL when the base is NULL or zero."""
    return F.try_divide(after - before, before) * 100


def parse_iso(text: Column) -> Column:
    """ISO time, with or without fraction; NULL when it does not parse."""
    return text.try_cast("timestamp")


def news_time(text: Column, as_of: Column) -> Column:
    """UTC time of a news row's date cell.

    `as_of` is the UTC time of reading. Cells are in Eastern time and come in four forms: "Today h:mmAM",
    "Yesterday h:mmAM", "Mon-dd-yy h:mmAM" and "Mon dd h:mmAM" (the year is the latest one whose month has
    begun). Anything else is NULL.
    """
    cell = F.trim(text)
    low = F.lower(cell)
    now = F.from_utc_timestamp(as_of, EASTERN)
    clock = F.upper(F.trim(F.regexp_replace(low, "^(today|yesterday)", "")))

    def at_clock(day: Column) -> Column:
        stamp = F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), clock)
        return F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd h:mma"))

    month_day = F.regexp_extract(cell, r"^([A-Za-z]{3})\s+(\d{1,2})\s+(\d{1,2}:\d{2}\s*[AaPp][Mm])$", 1)
    day_no = F.regexp_extract(cell, r"^([A-Za-z]{3})\s+(\d{1,2})\s+(\d{1,2}:\d{2}\s*[AaPp][Mm])$", 2)
    time_no = F.regexp_extract(cell, r"^([A-Za-z]{3})\s+(\d{1,2})\s+(\d{1,2}:\d{2}\s*[AaPp][Mm])$", 3)

    def yearless(year: Column) -> Column:
        stamp = F.concat_ws(" ", F.initcap(month_day), day_no, year.cast("string"), F.upper(time_no))
        return F.try_to_timestamp(stamp, F.lit("MMM d yyyy h:mma"))

    # The month alone decides the year, so it is read from the first of the month.
    month = F.month(F.try_to_timestamp(F.concat_ws(" ", F.initcap(month_day), F.lit("1 2000")), F.lit("MMM d yyyy")))
    year = F.year(now) - (month > F.month(now)).cast("int")
    full = F.regexp_replace(cell, r"\s+", " ")
    dashed = F.try_to_timestamp(
        F.concat(F.initcap(F.regexp_extract(full, "^([A-Za-z]{3})-", 1)),
                 F.upper(F.regexp_extract(full, "^[A-Za-z]{3}(-.*)$", 1))),
        F.lit("MMM-d-yy h:mma"),
    )
    local = (
        F.when(low.startswith("today"), at_clock(now))
        .when(low.startswith("yesterday"), at_clock(now - F.expr("INTERVAL 1 DAY")))
        .when(cell.contains("-"), dashed)
        .when(month_day != "", yearless(year))
    )
    return F.to_utc_timestamp(local, EASTERN)


def age_days(ts: Column, as_of: Column) -> Column:
    """Whole days between two times, rounded down."""
    return F.floor((F.unix_seconds(as_of) - F.unix_seconds(ts)) / 86400)
