"""Small column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c: Column | str) -> Column:
    """True for null and for texts of white space only (Unicode)."""
    c = col_of(c)
    return c.isNull() | c.rlike(r"(?U)^\s*$")


def strip(c: Column | str) -> Column:
    """Without outer Unicode white space."""
    return F.regexp_replace(col_of(c), r"(?U)^\s+|\s+$", "")


def canonical_id(c: Column | str) -> Column:
    """One spelling per UUID: lower case, no outer blanks, braces or ``urn:uuid:``; blank becomes null.

    The plain spelling, the common case, is taken as it is.
    """
    c = col_of(c)
    plain = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
    bare = F.regexp_replace(F.lower(strip(c)), r"^urn:uuid:|^\{|\}$", "")
    hyphenated = F.regexp_replace(bare, r"^([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})$", "$1-$2-$3-$4-$5")
    return F.when(c.rlike(plain), c).otherwise(F.nullif(hyphenated, F.lit("")))


def let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds or replaces columns whose expressions are not copied into those that use them later.

    A generator of one row stands between: the optimizer doesn't merge projections across it.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))).alias("_settled")).select(*kept, "_settled.*")
