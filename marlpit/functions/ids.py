"""Identifier and hash expressions (Column to Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that may stand in or around a user id besides its letters and digits: blanks of any kind and hyphens.
_NOISE = r"[\s\p{Z}\p{Cf}\p{Pd}]+"


def canonical_user(col: Column | str) -> Column:
    """One spelling per user: lower case, without blanks and hyphens; a null or empty id is null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.lower(F.regexp_replace(c, _NOISE, "")), F.lit(""))


def hash_hex(*parts: Column | str) -> Column:
    """The first 16 hex digits of SHA-256 over the parts joined by ``:``; text order equals unsigned 64-bit order."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def hash_bucket(n: int, *parts: Column | str) -> Column:
    """A bucket 0..n-1 of the unsigned 64-bit SHA-256 prefix."""
    return F.pmod(F.conv(hash_hex(*parts), 16, 10).cast("decimal(20,0)"), F.lit(n)).cast("int")


def hash_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of SHA-256; the same value in any engine with IEEE doubles."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
