"""Readable instants out of many spellings of a date, and plain tickers. JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def instant_micros(text: Column) -> Column:
    """Microseconds since the epoch (UTC) of a spelled date or time, null where it is unreadable.

    Read are ISO days and times (`-` or `/`, `T` or space, zone, `Z` or none), yyyyMMdd, epoch seconds of 9 to 11
    digits, `[Fri, ]01 Apr 2011[ 23:46:22 GMT]` and `April 1, 2011`. Without a zone UTC holds, without a time
    00:00:00. The result doesn't depend on the session's time zone.
    """
    # Bound once by a lambda: the branches below would else be repeated in generated code beyond its limits.
    return F.transform(F.array(F.trim(text)), _micros)[0]


def _micros(s: Column) -> Column:
    timed = s.rlike(r"\d:\d")
    zoned = s.rlike(r"(?i)(z|utc|gmt|[+-]\d{2}:?\d{2})$")

    def close(day: Column, rest: Column) -> Column:
        """The canonical form of a day yyyy-MM-dd and what follows it."""
        rest = F.regexp_replace(F.regexp_replace(rest, r"(?i)\s*(utc|gmt)$", "Z"), r"\s*([+-]\d{2}):?(\d{2})$", "$1:$2")
        rest = F.regexp_replace(rest, r"^[ Tt]\s*", "T")
        return F.when(~timed, F.when(rest == "", F.concat(day, F.lit("T00:00:00Z")))).when(zoned, F.concat(day, rest)).otherwise(F.concat(day, rest, F.lit("Z")))

    def spelled(pattern: str, d: int, m: int, y: int, rest: int | None) -> Column:
        part = lambda i: F.regexp_extract(s, pattern, i)
        at = F.call_function("locate", F.lower(F.substring(part(m), 1, 3)), F.lit(MONTHS))
        day = F.when((at > 0) & (at % 3 == 1), F.concat_ws("-", part(y), F.lpad(((at + 2) / 3).cast("int").cast("string"), 2, "0"), F.lpad(part(d), 2, "0")))
        return close(day, part(rest) if rest else F.lit(""))

    plain = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$"
    iso = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})((?:[ Tt].*)?)$"
    dmy = r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3,9})\.?,?\s+(\d{4})((?:\s.*)?)$"
    mdy = r"^([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})$"
    ix = lambda i: F.regexp_extract(s, iso, i)
    canonical = (
        F.when(s.rlike(plain), s)
        .when(s.rlike(iso), close(F.concat_ws("-", ix(1), F.lpad(ix(2), 2, "0"), F.lpad(ix(3), 2, "0")), ix(4)))
        .when(s.rlike(r"^\d{8}$"), F.concat(F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"), F.lit("T00:00:00Z")))
        .when(s.rlike(dmy), spelled(dmy, 1, 2, 3, 4))
        .when(s.rlike(mdy), spelled(mdy, 2, 1, 3, None))
    )
    return F.when(s.rlike(r"^\d{9,11}$"), s.cast("bigint") * 1_000_000).otherwise(F.unix_micros(canonical.try_cast("timestamp")))


def plain_ticker(ticker: Column) -> Column:
    """Upper case, without outer spaces and an exchange prefix before a colon; null where nothing is left."""
    t = F.upper(F.trim(F.regexp_replace(ticker, r"^.*:", "")))
    return F.when(t != "", t)


def utc_day(micros: Column) -> Column:
    """The UTC day of an instant in microseconds, as days since the epoch."""
    return ((micros - F.pmod(micros, F.lit(86_400_000_000))) / F.lit(86_400_000_000)).cast("int")
