"""Cleansing of text columns of a ledger extract."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date formats in the order in which they are tried.
DATE_FORMATS = ("yyyy-M-d", "d.M.yyyy", "d/M/yyyy", "M/d/yyyy", "yyyyMMdd")
#: Separators of the formats but for "-", which may also be the sign of a year.
SEPARATORS = (".", "/")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def to_date_any(c: Column) -> Column:
    """The first format that reads the trimmed text; null if none does. A format is only tried on texts that hold its separator, and no other: a failure costs more than all else."""
    t = F.trim(c)
    held = lambda f: reduce(lambda a, s: a & (t.contains(s) if s in f else ~t.contains(s)), SEPARATORS, F.lit(True))
    return F.coalesce(*[F.when(held(f), F.try_to_date(t, f)) for f in DATE_FORMATS])


def to_amount(c: Column) -> Column:
    """1.234,56 and 12,5 as well as 12.5 and 1 234.50; null if unreadable."""
    t = F.trim(c)
    tidy = F.when(t.rlike(r"^[-+]?\d{1,3}(\.\d{3})+,\d{2}$"), F.translate(F.translate(t, ".", ""), ",", ".")).when(t.contains(",") & ~t.contains("."), F.translate(t, ",", ".")).otherwise(F.translate(t, "  ", ""))
    return tidy.try_cast("decimal(18,2)")


def like_any(c: Column, patterns: Sequence[str]) -> Column:
    """Case-insensitive wildcard match; ``*`` stands for any run of characters, ``_`` for any one.

    All patterns are one expression, so the text is made and lowered once a row; with one each, the compiled step grew past what the JVM compiles.
    """
    wild = {"*": ".*", "%": ".*", "_": "."}
    any_of = "|".join("".join(wild.get(x) or re.escape(x) for x in p.lower()) for p in patterns)
    return F.lower(c).rlike(rf"(?s)\A(?:{any_of})\z") if patterns else F.lit(False)


def is_manual(entry_type: Column, user: Column, manual: Sequence[str], system: Sequence[str]) -> Column:
    """By the row's entry type if there is one, else by the user's name."""
    return F.when(blank_to_null(entry_type).isNotNull(), F.lower(F.trim(entry_type)).isin(*manual)).otherwise(user.isNotNull() & ~like_any(F.coalesce(user, F.lit("")), system))


def type_source(entry_type: Column) -> Column:
    return F.when(blank_to_null(entry_type).isNotNull(), "source").otherwise("derived")
