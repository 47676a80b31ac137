"""Date parsing and rendering."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# English month abbreviations of the version dates, in order.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# Shape of "%a, %d %b %Y %H:%M:%S %Z" with a GMT or UTC zone.
_VERSION_RE = r"^ *[A-Za-z]{3}, \d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{1,2}:\d{1,2} (?:GMT|UTC) *$"


def parse_version_date(col) -> Column:
    """``'Mon, 2 Apr 2007 19:18:42 GMT'`` to a wall-clock TIMESTAMP_NTZ.

    The fields are extracted and assembled with ``try_make_timestamp_ntz``,
    so the result does not depend on the session time zone; the weekday and
    the zone name are not interpreted. Anything malformed (wrong shape,
    unknown month, day 31 of a 30-day month) is NULL.
    """
    c = _c(col)
    ok = c.rlike(_VERSION_RE)
    # After the shape check, the fields are the tokens between separators:
    # weekday, day, month, year, hour, minute, second, zone.
    parts = F.split(F.trim(c), "[ ,:]+")

    def part(i):
        return parts.getItem(i)

    month_no = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.initcap(part(2)))
    ts = F.try_make_timestamp_ntz(part(3).cast("int"), month_no.cast("int"), part(1).cast("int"),
                                  part(4).cast("int"), part(5).cast("int"), part(6).cast("int"))
    return F.when(ok & (month_no > 0), ts)


def format_version_date(col) -> Column:
    """Inverse of :func:`parse_version_date` for a TIMESTAMP_NTZ column."""
    return F.concat(F.date_format(_c(col), "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def utc_wall_clock(col) -> Column:
    """A TIMESTAMP instant as its UTC wall-clock TIMESTAMP_NTZ, whatever the
    session time zone."""
    seconds = (F.unix_micros(_c(col)).cast("decimal(24,6)") / F.lit(1000000)).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def iso_utc(col, instant: bool = False) -> Column:
    """ISO-8601 text with a ``+00:00`` offset for a UTC wall-clock time, or
    for a TIMESTAMP ``instant``. Fractions have six digits and appear only
    when there are any."""
    c = utc_wall_clock(col) if instant else _c(col)
    fraction = F.date_format(c, "SSSSSS")
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(F.lit("")),
                    F.lit("+00:00"))
