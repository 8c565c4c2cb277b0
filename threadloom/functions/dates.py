"""Epoch and date-text conversion.

All of it works on TIMESTAMP_NTZ, so no result depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from threadloom.functions.bind import let

TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"

# English month names by their first letters, clock words and zone names without an offset.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_DAY = r"([0-9]{1,2})(?:st|nd|rd|th)?"
# A date is tokens of known width, with one kind of sign between: the alternatives differ in their first tokens, so one
# match reads a text once. Groups: year, month, day; year, month, day without signs; first, sign, second, year;
# day, month name, year; month name, day, year; year, month name, day.
_DATES = "|".join((
    r"([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", r"([0-9]{4})([0-9]{2})([0-9]{2})",
    r"([0-9]{1,2})([-/.])([0-9]{1,2})[-/.]([0-9]{4}|[0-9]{2})",
    rf"{_DAY}[-\s]?(?:of\s+)?{_MONTH},?[-\s]?([0-9]{{4}}|[0-9]{{2}})", rf"{_MONTH}[-\s]?{_DAY},?[-\s]+([0-9]{{4}})",
    rf"([0-9]{{4}})[-\s]{_MONTH}[-\s]{_DAY}"))
# Groups: hour, minute, second, fraction, half of the day; hour and half alone; zone sign, hours, minutes.
_CLOCK = (r"(?:(?:\s*,?\s+(?:at\s+)?|t)(?:([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)?\s*([ap])?\.?(?:m\.?)?"
          r"|([0-9]{1,2})\s*([ap])\.?m\.?)(?:\s*(?:z|utc|gmt)?(?:([+-])([0-9]{2}):?([0-9]{2})?)?)?)?")
_DATE_TEXT = rf"(?i)^\s*{_WEEKDAY}(?:{_DATES})\.?{_CLOCK}\s*$"
_GROUPS = 29

# Range of a nanosecond timestamp in whole seconds; beyond it a value is "bad".
MIN_EPOCH = -9223372036
MAX_EPOCH = 9223372036


def whole_number(c: Column) -> Column:
    """Text or number -> bigint, fraction cut toward zero, bad text -> NULL."""
    return c.cast("string").try_cast("double").try_cast("bigint")


def epoch_to_ts(epoch: Column) -> Column:
    """Unix seconds -> TIMESTAMP_NTZ; NULL or out of range -> NULL."""
    seconds = F.when(epoch.between(MIN_EPOCH, MAX_EPOCH), epoch)
    zero = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        zero, zero, zero, seconds.cast("decimal(18,6)")
    )


def ts_to_micros(ts: Column) -> Column:
    """TIMESTAMP_NTZ -> microseconds since 1970."""
    since = ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda name: F.extract(F.lit(name), since).cast("bigint")
    minutes = (part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")
    seconds = F.extract(F.lit("SECOND"), since).cast("decimal(8,6)")
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def ts_to_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, fractions of a second cut off."""
    return F.substring(ts.cast("timestamp_ntz").cast("string"), 1, 19)


def epoch_to_text(epoch: Column) -> Column:
    return ts_to_text(epoch_to_ts(epoch))


def parse_date_text(c: Column) -> Column:
    """A date text of any usual form -> TIMESTAMP_NTZ, anything else, and dates that don't exist, -> NULL.

    Year first, with or without signs; day or month first; month names in any order; then perhaps a time with seconds,
    fraction, am or pm, and a zone, which is brought to UTC. Where two numbers stand before the year, signs decide:
    after a slash the month comes first, after a dash or point the day; but a number over 12 is the day wherever it
    is. Years of two digits are 2000 to 2068 and 1969 to 1999. A text is matched once, whatever its form.
    """
    joined = "|".join(f"${i}" for i in range(1, _GROUPS + 1))
    read = F.when(c.rlike(_DATE_TEXT), F.split(F.regexp_replace(c, _DATE_TEXT, joined), r"\|", -1))
    return let(read, _timestamp)


def _timestamp(g: Column) -> Column:
    def number(*places: int) -> Column:
        return F.coalesce(*[F.get(g, F.lit(i - 1)).try_cast("int") for i in places])

    def word(*places: int) -> Column:
        return F.lower(F.coalesce(*[F.nullif(F.get(g, F.lit(i - 1)), F.lit("")) for i in places]))

    first, sign, second = number(7), word(8), number(9)
    month_first = F.when(first > 12, False).when(second > 12, True).otherwise(sign == "/")
    name = word(12, 14, 18)
    months = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(i))])
    short = number(1, 4, 10, 13, 16, 17)
    digits = F.char_length(word(10, 13))
    year = F.when(digits == 2, F.when(short < 69, short + 2000).otherwise(short + 1900)).otherwise(short)
    month = F.coalesce(number(2, 5), F.when(month_first, first).otherwise(second), months[name])
    day = F.coalesce(number(3, 6), F.when(month_first, second).otherwise(first), number(11, 15, 19))
    hour, half = F.coalesce(number(20, 25), F.lit(0)), word(24, 26)
    on_clock = F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    fraction = F.rpad(F.coalesce(word(23), F.lit("0")), 6, "0")
    second_ = F.concat(F.coalesce(number(22), F.lit(0)).cast("string"), F.lit("."), fraction).try_cast("decimal(8,6)")
    local = F.try_make_timestamp_ntz(year, month, day, on_clock, F.coalesce(number(21), F.lit(0)), second_)
    offset = (F.coalesce(number(28), F.lit(0)) * 60 + F.coalesce(number(29), F.lit(0))) * F.when(word(27) == "-", 1).otherwise(-1)
    zero = F.lit(0)
    return local + F.make_dt_interval(zero, zero, offset, zero.cast("decimal(18,6)"))


def standard_date_text(c: Column) -> Column:
    return ts_to_text(parse_date_text(c))


def repaired_date_text(text: Column, raw_epoch: Column) -> Column:
    """The date text, or the raw epoch column where the text is missing."""
    return F.coalesce(text, epoch_to_text(whole_number(raw_epoch)))


def millis_to_epoch(millis: Column) -> Column:
    """Milliseconds -> whole seconds (floor), missing -> 0."""
    return F.coalesce(F.floor(millis / F.lit(1000)).cast("bigint"), F.lit(0).cast("bigint"))


def run_stamp(ts: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if ts is None else ts, "yyyyMMdd_HHmmss")
