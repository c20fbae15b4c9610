"""Permanent identifiers: PREFIX-YYYY-MM-NNN, the number three digits or more."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^([A-Z]{2,4})-(\d{4})-(0[1-9]|1[0-2])-(\d{3,})$"


def format_id(prefix: Column, year: Column, month: Column, sequence: Column) -> Column:
    digits = sequence.cast("string")
    return F.concat_ws("-", prefix, F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(digits, F.greatest(F.length(digits), F.lit(3)), F.lit("0")))


def parse_id(ident: Column) -> Column:
    """A struct of prefix, year, month, sequence, month_key and subpath; null where the identifier is malformed."""
    get = lambda k: F.regexp_extract(ident, PATTERN, k)
    month_key = F.concat(get(2), F.lit("-"), get(3))
    return F.when(
        ident.rlike(PATTERN),
        F.struct(
            get(1).alias("prefix"),
            get(2).try_cast("int").alias("year"),
            get(3).try_cast("int").alias("month"),
            get(4).try_cast("long").alias("sequence"),
            month_key.alias("month_key"),
            F.concat(get(2), F.lit("/"), get(3), F.lit("/"), ident).alias("subpath"),
        ),
    )


def short_key(key: Column) -> Column:
    """What a person types of a key: the first 12 characters of its digest."""
    return F.substring(F.regexp_replace(key, "^[^:]*:", ""), 1, 12)
