"""Text functions with the semantics of the original reports, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def concat(*parts) -> Column:
    """Null if any part is null."""
    return F.concat(*[_col(p) for p in parts])


def charindex(needle: str, text, start: int = 1) -> Column:
    return F.locate(needle, _col(text), start)


def patindex(regex: str, text) -> Column:
    """1-based position of the first match, 0 if none."""
    return F.regexp_instr(_col(text), F.lit(regex))


def text_len(text) -> Column:
    """Length without trailing spaces."""
    return F.length(F.rtrim(_col(text)))


def data_length(text) -> Column:
    return F.octet_length(_col(text))


def stuff(text, start: int, length: int, insert: str) -> Column:
    return F.overlay(_col(text), F.lit(insert), start, length)


def zero_pad(number, width: int) -> Column:
    """Zeros in front up to ``width``; a longer number keeps all its digits."""
    text = _col(number).cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def collapse_spaces(text) -> Column:
    return F.regexp_replace(_col(text), " +", " ")


def scrub_phone(text) -> Column:
    return F.translate(_col(text), "-.()", "")


def token(text, sep: str, n: int) -> Column:
    """Nth part of a delimited text, empty if there are fewer."""
    return F.split_part(_col(text), F.lit(sep), F.lit(n))


def split_rows(df: DataFrame, text, sep: str, position: str = "pos", item: str = "item") -> DataFrame:
    """One row per part, with its 1-based position. A null text gives no row."""
    return (df.select("*", F.posexplode(F.split(_col(text), re.escape(sep))).alias("_p", item))
            .withColumn(position, F.col("_p") + 1).drop("_p"))


def extract_between(text, start: str, stop: str) -> Column:
    """Text after the first ``start`` and before the next ``stop``; empty if not there."""
    return F.regexp_extract(_col(text), f"{re.escape(start)}(.*?){re.escape(stop)}", 1)


def query_param(text, name: str) -> Column:
    """Value of one parameter of a query string or URL, null if absent."""
    return F.nullif(F.regexp_extract(_col(text), rf"(?:^|[?&]){re.escape(name)}=([^&#]*)", 1), F.lit(""))


def first_path_part(url) -> Column:
    """First folder of a path or URL."""
    return F.regexp_extract(_col(url), r"^(?:[a-z]+://[^/]*)?/([^/?]*)", 1)


def kv(text, key: str) -> Column:
    """Value of ``key=value`` in an error message, null if absent."""
    return F.nullif(F.regexp_extract(_col(text), rf"\b{re.escape(key)}\s*=\s*'?([^,;'\s]+)", 1), F.lit(""))


def sql_literal(value) -> Column:
    """A value rendered as text, NULL for null, quotes doubled."""
    value = _col(value)
    return F.coalesce(F.concat(F.lit("'"), F.replace(value.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")),
                      F.lit("NULL"))
