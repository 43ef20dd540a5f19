"""String features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_col


def utf8_bytes(s) -> Column:
    """UTF-8 bytes of a string as signed ints (-128..127), the JVM `byte` view."""
    s = as_col(s)
    h = F.hex(F.encode(s, "UTF-8"))
    n = F.octet_length(s)
    raw = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.conv(F.substring(h, i * 2 + 1, 2), 16, 10).cast("int"),
    )
    signed = F.transform(raw, lambda b: F.when(b >= 128, b - 256).otherwise(b))
    # sequence(0, -1) counts down, so the empty string needs its own branch
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(signed)


def levenshtein(a, b) -> Column:
    """Edit distance with unit costs (code points)."""
    return F.levenshtein(as_col(a), as_col(b))


def normalized_levenshtein(a, b) -> Column:
    """Edit distance / max(len a, len b, 1); two empty strings are at distance 0."""
    a, b = as_col(a), as_col(b)
    denom = F.greatest(F.char_length(a), F.char_length(b), F.lit(1))
    return F.levenshtein(a, b).cast("double") / denom.cast("double")


def longer_term(a, b) -> Column:
    """The longer of two strings; on equal length the second one."""
    a, b = as_col(a), as_col(b)
    return F.when(F.char_length(a) > F.char_length(b), a).otherwise(b)


def shorter_term(a, b) -> Column:
    """The shorter of two strings; on equal length the second one."""
    a, b = as_col(a), as_col(b)
    return F.when(F.char_length(a) < F.char_length(b), a).otherwise(b)


def longest_term_agg(term) -> Column:
    """Aggregate: the longest term of a group, ties broken by the larger term so the
    result does not depend on the order rows arrive in."""
    t = as_col(term)
    return F.max_by(t, F.struct(F.char_length(t), t))
