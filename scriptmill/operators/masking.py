"""Masking that keeps equal values equal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pseudonym(value: Column, salt: str) -> Column:
    """Salted SHA-256; the same value gives the same text, so masked columns still join."""
    return F.sha2(F.concat(F.lit(salt), value.cast("string")), 256)


def partial_mask(value: Column, keep: int) -> Column:
    """All but the last ``keep`` characters masked, letters as X/x and digits as n."""
    cut = F.greatest(F.length(value) - keep, F.lit(0))
    return F.concat(F.mask(F.substring(value, F.lit(1), cut)), F.substring(value, cut + 1, F.lit(keep)))
