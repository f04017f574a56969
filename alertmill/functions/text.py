"""Subjects, alert texts, durations, ids and command arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SUBJECT_PREFIX = "slg"
ALERT_BYTES = 4000
PARSE_MODE_HTML = "HTML"
SALT_RANGE = 1000
ZERO_TIME = "0001-01-01T00:00:00Z"
PROBE_TEMPLATE = "One, Two, Freddy's Coming For You"
# Longest duration a signed 64-bit nanosecond count can hold.
MAX_DURATION_S = 9223372036


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _or_empty(col: Column | str) -> Column:
    return F.coalesce(_c(col).cast("string"), F.lit(""))


def subject(severity, facility, host, prefix: str = SUBJECT_PREFIX) -> Column:
    """``prefix.severity.facility.host``; a missing part is an empty token."""
    return F.concat_ws(".", F.lit(prefix), _or_empty(severity), _or_empty(facility), _or_empty(host))


def message_text(timestamp, host, msg) -> Column:
    """The readable form of a log message."""
    return F.concat(
        F.lit("#syslog message at "), _or_empty(timestamp), F.lit("\n"), _or_empty(host), F.lit("\n"), _or_empty(msg)
    )


def cut_bytes(text, limit: int = ALERT_BYTES) -> Column:
    """First ``limit`` bytes; each byte left over from a split character becomes U+FFFD."""
    raw = F.encode(_c(text), "UTF-8")

    def head(n: int) -> Column:
        return F.substring(raw, 1, n).cast("string")

    cut = head(limit)
    # A character has at most four bytes, so at most three are left over.
    result = F.concat(head(limit - 3), F.lit("\ufffd" * 3))
    for spare in (2, 1):
        part = head(limit - spare)
        result = F.when(F.is_valid_utf8(part), F.concat(part, F.lit("\ufffd" * spare))).otherwise(result)
    result = F.when(F.is_valid_utf8(cut), cut).otherwise(result)
    return F.when(F.octet_length(_c(text)) <= limit, _c(text)).otherwise(result)


def escape_html(text) -> Column:
    out = _c(text)
    # The five escaped characters, ampersand first.
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def html_alert(text) -> Column:
    """Cut, escape and wrap; null for an empty text, which must not be sent."""
    col = _c(text)
    return F.when(
        F.length(col) > 0, F.concat(F.lit("<pre>"), escape_html(cut_bytes(col)), F.lit("</pre>"))
    )


def chat_id(address) -> Column:
    """The address as a 64-bit id; null when it is not one or is zero."""
    text = _c(address).cast("string")
    value = F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))
    return F.when(value != 0, value)


def pattern_id(pattern) -> Column:
    return F.crc32(_c(pattern).cast("binary"))


def batch_id(data, salt: Column | str | None = None, seed: int | None = None) -> Column:
    """CRC32 of ``data.salt`` as text. Give ``salt`` for a repeatable id."""
    if salt is None:
        salt_col = F.floor(F.rand(seed) * SALT_RANGE)
    else:
        salt_col = _c(salt)
    joined = F.concat(_c(data).cast("string"), F.lit("."), salt_col.cast("string"))
    return F.crc32(joined.cast("binary")).cast("string")


def duration_seconds(text) -> Column:
    """Seconds of texts like ``1h30m``; null when the duration is not valid."""
    col = _c(text)

    def total(unit: str, seconds: int) -> Column:
        # Leading zeros carry no value and would only overflow the cast.
        digits = F.regexp_extract_all(col, F.lit(f"([0-9]+){unit}"), 1)
        values = F.transform(
            digits,
            lambda d: F.coalesce(
                F.when(F.length(F.ltrim(d, F.lit("0"))) <= 12, F.concat(F.lit("0"), F.ltrim(d, F.lit("0"))).cast("bigint")),
                F.lit(MAX_DURATION_S + 1),
            ),
        )
        # Capped addends keep the sum inside 64 bits and still above the limit.
        capped = F.transform(values, lambda v: F.least(v * seconds, F.lit(MAX_DURATION_S + 1)))
        return F.aggregate(
            capped,
            F.lit(0).cast("bigint"),
            lambda acc, v: F.least(acc + v, F.lit(MAX_DURATION_S + 1).cast("bigint")),
        )

    seconds = total("h", 3600) + total("m", 60)
    valid = col.rlike(r"\A(?:0|(?:[0-9]+[hm])+)\z")
    return F.when(valid & (seconds <= MAX_DURATION_S), seconds)


def incorrect_duration(text) -> Column:
    return F.concat(F.lit("duration "), _or_empty(text), F.lit(" is incorrect"))


def duration_error(text) -> Column:
    """The reply for an invalid duration; null for a valid one."""
    return F.when(duration_seconds(text).isNull(), incorrect_duration(text))


def expiry(command_ts, seconds) -> Column:
    return F.timestamp_micros(F.unix_micros(_c(command_ts)) + _c(seconds) * 1000000)


def expiry_time(text) -> Column:
    """Parse an RFC 3339 expiry; the zero time means it never expires (null)."""
    col = _c(text)
    return F.when(col != F.lit(ZERO_TIME), F.try_to_timestamp(col))


def probe_text(nonce, template: str = PROBE_TEMPLATE) -> Column:
    return F.concat(_c(nonce).cast("string"), F.lit(", " + template))


def add_args(text, list_name: str | None = None) -> tuple[Column, Column]:
    """(duration, pattern) of an ``add`` command."""
    expr = f"/list {_quoted(list_name)} add ([0-9hm]*) ([^\\n]*)"
    return F.regexp_extract(_c(text), expr, 1), F.regexp_extract(_c(text), expr, 2)


def rm_arg(text, list_name: str | None = None) -> Column:
    """Item id text of an ``rm`` command."""
    return F.regexp_extract(_c(text), f"/list {_quoted(list_name)} rm ([0-9]*)", 1)


def whois_arg(text) -> Column:
    return F.regexp_extract(_c(text), "/whois ([^\\n]*)", 1)


def _quoted(list_name: str | None) -> str:
    from alertmill.functions.regex import to_java

    # List names are spliced into the command pattern as they are.
    return to_java(list_name) if list_name is not None else "[^ ]+"


def list_item_id(text) -> Column:
    """A 32-bit unsigned id above zero, else null."""
    col = _c(text)
    value = F.when(
        col.rlike(r"\A[0-9]+\z") & (F.length(F.ltrim(col, F.lit("0"))) <= 10),
        F.concat(F.lit("0"), F.ltrim(col, F.lit("0"))).cast("bigint"),
    )
    return F.when((value > 0) & (value <= 4294967295), value)
