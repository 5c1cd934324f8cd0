"""The two date readings of news pages: naive local time and offset-aware UTC."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fields(c: Column, hour_digits: str) -> list[Column]:
    """Day, month, year, hour, minute as ints, or all NULL when the text has no such date."""
    found = F.regexp_extract(
        c, rf"(?U)[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}},\s*[0-9]{{{hour_digits}}}:[0-9]{{2}}", 0
    )
    parts = F.split(F.regexp_replace(found, r"[^0-9]+", " "), " ")
    return [F.get(parts, F.lit(i)).try_cast("int") for i in range(5)]


def parse_local(c: Column) -> Column:
    """``dd/mm/yyyy, HH:MM`` anywhere in the text, zone ignored, two hour digits required.
    NULL stands for "no usable date"."""
    d, m, y, h, mi = _fields(c, "2")
    ts = F.try_make_timestamp_ntz(y, m, d, h, mi, F.lit(0))
    return F.when(y >= 1, ts)


def parse_utc(c: Column, default_offset: int = 7) -> Column:
    """The same date read with its ``(GMT+N)`` whole-hour offset and returned in UTC."""
    d, m, y, h, mi = _fields(c, "1,2")
    zone = F.regexp_extract(c, r"\(GMT([+-][0-9]+)\)", 1)
    offset = F.when(zone == "", F.lit(default_offset)).otherwise(zone.try_cast("int"))
    ts = F.try_make_timestamp(y, m, d, h, mi, F.lit(0), F.lit("UTC"))
    return F.when((y >= 1) & (F.abs(offset) < 24), ts - F.make_dt_interval(hours=offset))
