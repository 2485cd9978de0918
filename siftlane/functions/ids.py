"""Identifiers: UUID spellings and parsed log positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def uuid_or_null(col: Column | str) -> Column:
    """The UUID in its canonical spelling, null if ``col`` is none.

    Accepted: upper or lower case, with hyphens or without, in braces, with ``urn:uuid:``.
    """
    low = F.lower(F.col(col) if isinstance(col, str) else col)
    bare = F.concat_ws("-", F.substring(low, 1, 8), F.substring(low, 9, 4), F.substring(low, 13, 4), F.substring(low, 17, 4), F.substring(low, 21, 12))
    body = (
        F.when(F.length(low) == 36, low)
        .when(F.length(low) == 38, F.substring(low, 2, 36))
        .when((F.length(low) == 45) & low.startswith("urn:uuid:"), F.substring(low, 10, 36))
        .when(F.length(low) == 32, bare)
    )
    return F.when(body.rlike(_SHAPE), body)


def uuid_key(col: Column | str) -> Column:
    """A value to compare identifiers by: the canonical UUID, else the text as it stands; null for null and empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c != "", F.coalesce(uuid_or_null(c), c))


def position(tx: str = "transaction_id", offset: str = "log_offset") -> Column:
    """A log position as a struct; structs compare lexicographically and numerically."""
    return F.struct(F.col(tx).cast("decimal(20,0)").alias("tx"), F.col(offset).cast("bigint").alias("off"))


def position_text_after(tx: Column, off: Column, than_tx: Column, than_off: Column) -> Column:
    """Whether position (tx, off) lies after another; transaction ids are texts, and any that is no number gives false."""
    a, b = tx.try_cast("decimal(20,0)"), than_tx.try_cast("decimal(20,0)")
    return F.coalesce((a > b) | ((a == b) & (off > than_off)), F.lit(False))
