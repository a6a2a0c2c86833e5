"""Perceptual hash codecs and cache keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_bits(encoded: Column) -> Column:
    """The first eight bytes of a base64 text, big-endian, as a signed long.

    Trailing ``=`` are optional; fewer than eight bytes give null, and so does the
    empty string; characters outside the alphabet count as zero bits (``A``).
    """
    core = F.regexp_replace(F.regexp_replace(encoded, "=+$", ""), "[^A-Za-z0-9+/]", "A")
    whole = F.substring(F.rpad(core, 12, "A"), 1, 12)
    bits = F.conv(F.hex(F.substring(F.unbase64(whole), 1, 8)), 16, -10).cast("long")
    return F.when(F.length(core) * 6 >= 64, bits)


def null_if_empty(encoded: Column) -> Column:
    return F.when(encoded != "", encoded)


def cache_key(path: Column, size: Column) -> Column:
    """File name of a cached thumbnail; stable across runs."""
    return F.concat(F.substring(F.md5(F.concat_ws(":", path, size.cast("string"))), 1, 16), F.lit(".png"))
