"""Days out of the notations that sources use, in UTC whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZONE = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"


def _plausible(day: Column) -> Column:
    return F.when((F.year(day) >= 1000) & (F.year(day) <= 9999), day)


def utc_day(timestamp: Column, kind: str) -> Column:
    """The UTC day of a timestamp column; ``kind`` is its type in the schema."""
    if kind == "timestamp_ntz":
        return timestamp.cast("date")
    return F.to_utc_timestamp(timestamp, F.current_timezone()).cast("date")


def iso_day(text: Column) -> Column:
    """The UTC day of an ISO 8601 date or time; null if it can't be read."""
    text = F.trim(text)
    dated = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    timed = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}")
    zoned = text.rlike(_ZONE)
    return _plausible(
        F.when(dated, text.try_cast("date"))
        .when(timed & zoned, F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("date"))
        .when(timed, text.try_cast("timestamp_ntz").cast("date"))
    )


def european_day(text: Column) -> Column:
    """The day of ``day.month.year``; null if it can't be read."""
    text = F.trim(text)
    part = [F.regexp_extract(text, r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})$", i) for i in (3, 2, 1)]
    return _plausible(F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0")).try_cast("date"))


def any_day(text: Column) -> Column:
    return F.coalesce(iso_day(text), european_day(text))


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Names of zones in dates of mail and feeds.
_ZONES = {"gmt": "+00:00", "ut": "+00:00", "utc": "+00:00", "z": "+00:00", "est": "-05:00", "edt": "-04:00", "cst": "-06:00", "cdt": "-05:00", "mst": "-07:00", "mdt": "-06:00", "pst": "-08:00", "pdt": "-07:00"}


def published(text: Column, as_of: Column, first_year: int = 1995) -> Column:
    """A source's date as ``YYYY-MM-DDTHH:MM:SSZ``, or as it is where it is a bare day; null if it can't be read.

    ISO 8601 or the form of mail and feeds (``Tue, 02 Jan 2024 10:00:00
    +0100``), without a zone taken for UTC. Years before ``first_year`` and
    times more than a day after ``as_of`` are none.
    """
    text = F.trim(text)
    mail = r"(?i)^(?:[a-z]{3},\s*)?(\d{1,2}) ([a-z]{3})[a-z]* (\d{4})(?: (\d{2}:\d{2})(:\d{2})?)? ?([+-]\d{4}|[a-z]{1,3})?$"
    part = lambda i: F.regexp_extract(text, mail, i)
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(part(2)))
    named = F.create_map(*(F.lit(x) for pair in _ZONES.items() for x in pair))
    zone = F.when(part(6).rlike(r"^[+-]\d{4}$"), F.concat(F.substring(part(6), 1, 3), F.lit(":"), F.substring(part(6), 4, 2))).otherwise(F.coalesce(F.try_element_at(named, F.lower(part(6))), F.lit("+00:00")))
    clock = F.concat(F.when(part(4) == "", "00:00").otherwise(part(4)), F.when(part(5) == "", ":00").otherwise(part(5)))
    from_mail = F.when(month > 0, F.concat(part(3), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("T"), clock, zone))
    day = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.when(text.rlike(_ZONE), text).otherwise(F.concat(text, F.lit("+00:00"))))
    at = F.coalesce(iso, F.when(text.rlike(mail), from_mail)).try_cast("timestamp")
    utc = F.to_utc_timestamp(at, F.current_timezone())
    last = F.to_utc_timestamp(as_of.cast("timestamp"), F.current_timezone()) + F.make_dt_interval(F.lit(1))
    bare = F.when(day & text.try_cast("date").isNotNull() & (F.substring(text, 1, 4).cast("int") >= first_year) & (text <= F.date_format(last, "yyyy-MM-dd")), text)
    timed = F.when((F.year(utc) >= first_year) & (utc <= last), F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.when(day, bare).otherwise(timed)
