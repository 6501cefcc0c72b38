"""Dates of documents: parsing the accepted spellings, and writing them back, as Column expressions.

A parsed date is struct<moment timestamp_ntz, offset_min int>: the wall clock as written, and the zone's offset in
minutes where one was written, since a date with a zone and one without are written back differently.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings beside the packed form, tried in order, "/" read as "-".
PATTERNS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy"]
PACKED = r"^[Dd]:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:(Z)|([+\-])(\d{2})?(\d{2})?)?$"
ZONE = r"^(.*\d{2}:\d{2}:\d{2})(?:(Z)|([+\-])(\d{2}):?(\d{2}))$"


def _part(text: Column, group: int, default: str) -> Column:
    found = F.regexp_extract(text, PACKED, group)
    return F.when(found == "", F.lit(default)).otherwise(found)


def _offset(sign: Column, hours: Column, minutes: Column) -> Column:
    number = lambda x: F.when(x == "", 0).otherwise(x.cast("int"))
    return F.when(sign == "-", -1).otherwise(1) * (number(hours) * 60 + number(minutes))


def parse_date(text: Column) -> Column:
    """Null where no spelling fits."""
    packed = F.regexp_replace(F.trim(text), "[' ]", "")
    parts = [_part(packed, i, d) for i, d in ((1, "0"), (2, "01"), (3, "01"), (4, "00"), (5, "00"), (6, "00"))]
    written = F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2], F.lit(" "), parts[3], F.lit(":"), parts[4], F.lit(":"), parts[5])
    zone = F.when(F.regexp_extract(packed, PACKED, 7) == "Z", 0).when(F.regexp_extract(packed, PACKED, 8) != "", _offset(*[F.regexp_extract(packed, PACKED, g) for g in (8, 9, 10)]))
    plain = F.replace(F.trim(text), F.lit("/"), F.lit("-"))
    has_zone = plain.rlike(ZONE)
    bare = F.when(has_zone, F.regexp_extract(plain, ZONE, 1)).otherwise(plain)
    named = F.when(has_zone & (F.regexp_extract(plain, ZONE, 2) == "Z"), 0).when(has_zone, _offset(*[F.regexp_extract(plain, ZONE, g) for g in (3, 4, 5)]))
    moment = F.coalesce(*[F.try_to_timestamp(bare, F.lit(p)).cast("timestamp_ntz") for p in PATTERNS])
    return F.when(packed.rlike(PACKED), _dated(F.try_to_timestamp(written, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"), zone)).otherwise(_dated(moment, named))


def _dated(moment: Column, offset: Column) -> Column:
    return F.when(moment.isNotNull(), F.struct(moment.alias("moment"), offset.cast("int").alias("offset_min")))


def _suffix(offset: Column, between: str, after: str) -> Column:
    size = F.abs(offset)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(offset.isNull(), "").otherwise(F.concat(F.when(offset < 0, "-").otherwise("+"), two(F.floor(size / 60)), F.lit(between), two(size % 60), F.lit(after)))


def packed_date(moment: Column, offset: Column) -> Column:
    """D:20210305120000+03'00'"""
    return F.concat(F.date_format(moment, "'D:'yyyyMMddHHmmss"), _suffix(offset, "'", "'"))


def iso_date(moment: Column, offset: Column) -> Column:
    """2021-03-05T12:00:00+03:00"""
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), _suffix(offset, ":", ""))
