"""Time stamps: tolerant parsing, printing and re-basing. The session time zone must be UTC."""

from pyspark.sql import functions as F

from leakgauge.functions.domain import stripped
from leakgauge.functions.once import bound

_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"
_MILLISECONDS_ABOVE = 1e11
_FIRST_SECOND, _END_SECOND = -62135596800, 253402300800
_CLOCK = r"[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}(?:\.[0-9]{1,6})?\z"
_YEAR_FIRST = rf"^[0-9]{{4}}([-/])[0-9]{{1,2}}\1[0-9]{{1,2}}\s+{_CLOCK}"
_DAY_FIRST = rf"^[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}\s+{_CLOCK}"
_USUAL = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[ T][0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}(?:\.[0-9]{1,6})?Z?\z"
_ISO = (
    r"^(?:([0-9]{4})-([0-9]{2})-([0-9]{2})(?=[^0-9]|\z)|([0-9]{4})([0-9]{2})([0-9]{2})(?=[^0-9]))"
    r"(?:.([0-9]{2})(?:(:?)([0-9]{2})(?:\8([0-9]{2})(?:[.,]([0-9]+))?)?)?"
    r"(?:Z|([+-])([0-9]{2})(?::?([0-9]{2}))?(?::?([0-9]{2}))?(?:\.[0-9]+)?)?)?\z"
)


def _numeric_micros(text):
    value = F.replace(text, F.lit("_"), F.lit("")).try_cast("double")
    seconds = F.when(value > _MILLISECONDS_ABOVE, value / 1000.0).otherwise(value)
    whole = seconds.try_cast("bigint")
    in_range = (seconds >= _FIRST_SECOND) & (seconds < _END_SECOND)
    return F.when(in_range, whole * 1_000_000 + F.rint((seconds - whole) * 1e6).cast("bigint"))


def _plain_micros(text):
    """Year-month-day text that is known to look right; impossible dates become null."""
    return F.unix_micros(F.concat(text, F.lit("Z")).try_cast("timestamp"))


def _iso_micros(text):
    def part(i, default=""):
        found = F.regexp_extract(text, _ISO, i)
        return F.when(found == "", default).otherwise(found) if default else found

    date = F.concat_ws(
        "-", F.concat(part(1), part(4)), F.concat(part(2), part(5)), F.concat(part(3), part(6))
    )
    clock = F.concat_ws(":", part(7, "00"), part(9, "00"), part(10, "00"))
    local = _plain_micros(F.concat(date, F.lit(" "), clock, F.lit("."), part(11, "0")))
    hours, minutes, secs = (part(i, "0").cast("int") for i in (13, 14, 15))
    ahead = (hours * 3600 + minutes * 60 + secs) * F.when(part(12) == "-", -1).otherwise(1)
    possible = (hours < 24) & (minutes < 60) & (secs < 60)
    return F.when(possible, local - ahead.cast("bigint") * 1_000_000)


def parse_epoch_micros(col):
    """Microseconds since 1970 (UTC) for any accepted spelling, else null.

    Numbers come first: seconds, or milliseconds above 1e11. Only the two usual spellings, which no number
    looks like, are settled before them by one pattern.
    """
    return bound(stripped(col.cast("string")), _text_micros)


def _text_micros(text):
    clean = F.replace(F.replace(text, F.lit("Z"), F.lit("")), F.lit("T"), F.lit(" "))
    spaced = F.regexp_replace(F.replace(clean, F.lit("/"), F.lit("-")), r"\s+", " ")
    turned = F.regexp_replace(spaced, r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4}) ", "$3-$2-$1 ")
    return (
        F.when(text.rlike(_USUAL), _plain_micros(F.rtrim(text, F.lit("Z"))))
        .when(text.rlike(_NUMBER), _numeric_micros(text))
        .when(clean.rlike(_YEAR_FIRST), _plain_micros(spaced))
        .when(clean.rlike(_DAY_FIRST), _plain_micros(turned))
        .when(text.rlike(_ISO), _iso_micros(text))
    )


def standard_text(micros):
    """'YYYY-MM-DD HH:MM:SS.mmm', cut (not rounded) to milliseconds."""
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd HH:mm:ss.SSS")


def epoch_seconds(micros):
    return micros / 1e6


def printed_seconds(micros):
    """Epoch seconds with three decimals, rounded the way the exact binary value of the double rounds.

    Only times that end in half a millisecond are in doubt. There the double nearest to the time lies a
    little above or below it; both are compared as integers scaled by 2**42.
    """
    seconds = micros / 1e6
    scaled = ((seconds - F.floor(seconds)) * float(2**42)).cast("bigint") * 1_000_000
    error = scaled - micros % 1_000_000 * 2**42
    millis, rest = F.floor(micros / 1000).cast("bigint"), micros % 1000
    up = (rest > 500) | ((rest == 500) & ((error > 0) | ((error == 0) & (millis % 2 == 1))))
    rounded = millis + up.cast("bigint")
    exact = F.concat(F.floor(rounded / 1000).cast("string"), F.lit("."), F.lpad((rounded % 1000).cast("string"), 3, "0"))
    return F.when(micros >= 1024 * 1_000_000, exact).otherwise(F.format_string("%.3f", seconds))


def rebase(df, start_us, micros="epoch_us"):
    """Move all events so that the first one happens at the given instant; gaps are kept."""
    origin = df.agg(F.min(micros).alias("origin")).scalar()
    return df.withColumn(micros, F.lit(start_us).cast("bigint") + F.col(micros) - origin)
