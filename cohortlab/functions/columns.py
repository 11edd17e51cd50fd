"""Column -> Column helpers. All built-in Spark expressions (whole-stage codegen, no UDFs)."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlab.functions.fixed import GUEST_IDS

SECONDS_PER_DAY = 86400


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div_or_zero(a, b) -> Column:
    """a / b with b == 0 (or null) -> 0, as ``x / y.replace(0, nan)`` followed by ``fillna(0)``."""
    return F.coalesce(F.try_divide(col_(a).cast("double"), col_(b).cast("double")), F.lit(0.0))


def div_or_null(a, b) -> Column:
    return F.try_divide(col_(a).cast("double"), col_(b).cast("double"))


def elapsed_seconds(later, earlier) -> Column:
    return F.expr(f"timestampdiff(SECOND, {earlier}, {later})") if isinstance(later, str) and isinstance(earlier, str) \
        else F.timestamp_diff("SECOND", col_(earlier), col_(later))


def floor_days(later, earlier) -> Column:
    """Elapsed time floored to whole days (pandas ``.dt.days``), not a calendar-day difference."""
    return F.floor(F.timestamp_diff("SECOND", col_(earlier), col_(later)) / F.lit(SECONDS_PER_DAY)).cast("long")


def month_index(ts) -> Column:
    return (F.year(col_(ts)) * 12 + F.month(col_(ts))).cast("int")


def year_month(ts) -> Column:
    return F.date_format(col_(ts), "yyyy-MM")


def quarter_label(ts) -> Column:
    return F.concat(F.lit("Q"), F.quarter(col_(ts)).cast("string"))


def norm_id(c) -> Column:
    return F.lower(F.trim(col_(c).cast("string")))


def is_guest(c) -> Column:
    """Null or one of the guest spellings (case-insensitive, trimmed)."""
    return col_(c).isNull() | norm_id(c).isin(*GUEST_IDS)


def is_blank(c) -> Column:
    """Missing text: null, empty after trim, or the text ``nan``."""
    t = F.trim(col_(c).cast("string"))
    return t.isNull() | (t == "") | (F.lower(t) == "nan")


def blank_to_null(c) -> Column:
    return F.when(is_blank(c), F.lit(None)).otherwise(F.trim(col_(c).cast("string")))


def text_true(c) -> Column:
    """Boolean parsed from text: only ``true`` (any case, trimmed) is true."""
    return F.coalesce(F.lower(F.trim(col_(c).cast("string"))) == F.lit("true"), F.lit(False))


def money(c, scale: int = 3) -> Column:
    """Exact decimal for order-independent sums."""
    return col_(c).cast(f"decimal(18,{scale})")


def sanitize(c, fill=None) -> Column:
    """NaN / +inf / -inf -> ``fill`` (null by default)."""
    x = col_(c)
    bad = F.isnan(x) | (x == F.lit(float("inf"))) | (x == F.lit(float("-inf")))
    return F.when(bad, F.lit(fill)).otherwise(x)


def any_contains(text: Column, needles: list[str]) -> Column:
    if not needles:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def accent_table() -> tuple[str, str]:
    """Characters whose canonical decomposition is one ASCII letter plus combining marks.

    Built from a rule (Unicode NFD over Latin-1 Supplement and Latin Extended-A) rather than
    listed: the equivalent of ``normalize('NFD')`` followed by dropping U+0300..U+036F.
    """
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        ch = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFD", ch) if not 0x0300 <= ord(x) <= 0x036F)
        if len(base) == 1 and base.isascii() and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTS_FROM, ACCENTS_TO = accent_table()


def normalize_text(c) -> Column:
    """lower -> strip accents -> non-word (except apostrophe) to space -> collapse spaces -> trim."""
    x = F.lower(col_(c))
    x = F.translate(x, ACCENTS_FROM, ACCENTS_TO)
    x = F.regexp_replace(x, r"[\x{0300}-\x{036F}]", "")
    x = F.regexp_replace(x, r"[^A-Za-z0-9_\s']", " ")
    x = F.regexp_replace(x, r"\s+", " ")
    return F.trim(x)
