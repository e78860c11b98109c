"""Scalar functions of texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textveil.config import Config
from textveil.functions.patterns import LOG_EMAIL, LOG_NUMBER


#: White space as str has it: the four separators below U+0020 are none to the expression engine.
_SPACE = r"[\s\x1c-\x1f]"


def stripped(text: Column) -> Column:
    """Without white space at either end; ``trim`` would only take spaces."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def normalize(text: Column) -> Column:
    """Line breaks and tabs as one space, runs of white space as one space, none at the ends; null is empty."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), "[\r\n\t]+", " ")
    return stripped(F.regexp_replace(flat, rf"(?U){_SPACE}{{2,}}", " "))


def redact_for_log(text: Column, most: int = 200) -> Column:
    """One line, cut at ``most`` characters, then without e-mail addresses and long numbers."""
    line = stripped(F.translate(F.coalesce(text, F.lit("")), "\n\r", "  "))
    line = F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("...(truncated)"))).otherwise(line)
    line = F.regexp_replace(line, LOG_EMAIL, "[EMAIL_REDACTED]")
    return F.regexp_replace(line, LOG_NUMBER, "[NUM_REDACTED]")


def card_score(value: Column) -> Column:
    """0.95 for 13 to 19 digits with a right check digit, 0.78 with a wrong one, 0 for other lengths."""
    digits = F.regexp_replace(value, r"(?U)\D", "")
    right = F.call_function("luhn_check", digits)
    return F.when(~F.length(digits).between(13, 19), 0.0).when(right, 0.95).otherwise(0.78).cast("double")


def mask(value: Column, config: Config) -> Column:
    """All of an e-mail address, or all but the last characters of another value, as the mask character."""
    n, keep = F.length(value), config.preserve_last
    hidden = F.when(F.contains(value, F.lit("@")) | (n <= keep), n).otherwise(n - keep)
    return F.concat(F.repeat(F.lit(config.mask_char), hidden), F.when(hidden < n, F.right(value, F.lit(keep))).otherwise(F.lit("")))


def pseudonym(value: Column, config: Config, prefix: str | None = None) -> Column:
    """The prefix and 12 hex digits of the SHA-256 of value and salt."""
    digest = F.sha2(F.concat(value, F.lit(config.salt)).cast("binary"), 256)
    return F.concat(F.lit(f"{prefix or config.prefix}_"), F.substring(digest, 1, 12))


def run_id(ts: Column, prefix: str | None = None) -> Column:
    """A time in UTC as ``yyyymmdd_HHMMSS``, behind a prefix if there is one."""
    stamp = F.date_format(F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone()), "yyyyMMdd_HHmmss")
    return F.concat(F.lit(f"{prefix}_"), stamp) if prefix else stamp
