"""Code columns compared as the source tables declare them: without regard to case and to trailing blanks.

A collated column carries its comparison along: joins, groups, distinct, ``=``, ``IN`` and sorts of it all follow.
Spark runs them on a key derived from the text, so a join on codes stays a shuffled or broadcast equi-join and a
group or distinct one shuffle; what it adds is that key for each row, and sorted in place of hashed groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: For codes: ``'a1 '`` and ``'A1'`` are the same. For texts that are searched in: blanks count.
CODES, TEXTS = "UTF8_LCASE_RTRIM", "UTF8_LCASE"


def as_codes(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns collated as codes."""
    return df.withColumns({c: F.collate(c, CODES) for c in columns})


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns compared byte by byte again, in lower case and without trailing blanks: of the spellings that
    a group has, Spark shows any one."""
    return df.withColumns({c: F.rtrim(F.lower(F.collate(c, "UTF8_BINARY"))) for c in columns})


def like_code(column: str | Column, pattern: str) -> Column:
    """LIKE without regard to case."""
    return F.collate(column, TEXTS).like(pattern)


def replace_text(column: str | Column, old: str, new: str) -> Column:
    """REPLACE of every spelling of ``old``."""
    return F.collate(F.replace(F.collate(column, TEXTS), F.lit(old), F.lit(new)), "UTF8_BINARY")
