"""Lenient date parsing with an explicit, ordered list of layouts.

Results are ``TIMESTAMP_NTZ`` and never depend on the session time zone. A layout
is a date part and an optional time (seconds, AM/PM and a zone are optional too);
a text with ``Z`` or an offset is turned to UTC, one without keeps its wall-clock
reading. Invalid calendar dates give null. Time-only text is not a date (it would
otherwise take the current day).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: accepted layouts (yyyy-M-d, yyyy/M/d, yyyyMMdd; M/d/yyyy then d/M/yyyy, also with - and .)
_TIME = "(?:[T ][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.][0-9]{1,9})?)? ?(?:[AaPp][Mm])? ?(?:Z|UTC|[+-][0-9]{2}:?[0-9]{2})?)?"
LAYOUT = "^(?:[0-9]{8}|(?:[0-9]{4}([-/])[0-9]{1,2}\\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\\2[0-9]{4})" + _TIME + ")\\z"
COMPACT = "^([0-9]{4})([0-9]{2})([0-9]{2})\\z"
YEAR_FIRST = "^([0-9]{4})/([0-9]{1,2})/"
YEAR_LAST = "^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})"
AFTER_CLOCK = "^([^:]*:[0-9:.]*[0-9]) ?([AaPp][Mm])? ?(Z|UTC|[+-][0-9]{2}:?[0-9]{2})?\\z"
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "yyyyMMdd", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "M.d.yyyy", "d.M.yyyy")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _wall(s: Column) -> Column:
    """The date and clock of a text in an accepted layout, without AM/PM and zone."""
    # The date part is rewritten as yyyy-M-d and what follows the clock is cut off, then Spark casts.
    dated = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, AFTER_CLOCK, "$1"), YEAR_FIRST, "$1-$2-"), COMPACT, "$1-$2-$3")
    return F.when(
        s.rlike(LAYOUT),
        _let(
            dated,
            lambda d: F.coalesce(
                F.regexp_replace(d, YEAR_LAST, "$3-$1-$2").try_cast("timestamp_ntz"),
                F.regexp_replace(d, YEAR_LAST, "$3-$2-$1").try_cast("timestamp_ntz"),
            ),
        ),
    )


def _moved(s: Column, wall: Column) -> Column:
    """The reading with AM/PM and the zone of the text applied; null if its hour is none of a 12-hour clock."""

    def apply(parts: Column) -> Column:
        half, zone, hour = parts["half"], parts["zone"], parts["hour"]
        later = F.when((half == "PM") & (hour < 12), 720).when((half == "AM") & (hour == 12), -720).otherwise(0)
        digits = F.regexp_replace(zone, "[^0-9]", "")
        minutes = F.coalesce(F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
        ahead = F.when(zone.startswith("-"), -minutes).otherwise(minutes)
        return F.when((half == "") | ((hour >= 1) & (hour <= 12)), wall + F.make_dt_interval(F.lit(0), F.lit(0), later - ahead))

    parts = F.struct(
        F.upper(F.regexp_extract(s, AFTER_CLOCK, 2)).alias("half"), F.regexp_extract(s, AFTER_CLOCK, 3).alias("zone"), F.hour(wall).alias("hour")
    )
    return _let(parts, apply)


def to_timestamp_lenient(col: Column, data_type: T.DataType = T.StringType()) -> Column:
    """Parse a column into TIMESTAMP_NTZ; unparseable values become null."""
    if isinstance(data_type, (T.TimestampNTZType, T.DateType, T.TimestampType)):
        # Of an instant, its wall-clock reading in the session zone.
        return col.cast("timestamp_ntz")
    text = F.regexp_replace(col.cast("string"), "(?U)^\\s+|\\s+\\z", "")

    def parse(s: Column) -> Column:
        # AM, PM and zones are rare: their steps run only where the text ends in one after a clock.
        marked = F.when(s.rlike(":.*[A-Za-z+-]"), _let(_wall(s), lambda w: _moved(s, w))).otherwise(_wall(s))
        # Every accepted layout starts with a digit: other text skips the regex work.
        return F.when(F.substring(s, 1, 1).between("0", "9"), marked)

    return _let(text, parse)


def hours_between(start: Column, end: Column) -> Column:
    """(end - start) in hours as double, exact to the microsecond."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return micros / F.lit(3.6e9)
