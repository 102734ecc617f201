"""Scalar functions as Spark ``Column`` expressions.

All are built-in expressions (code-generated, no Python per row).
Display formats round on the exact decimal value, half up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: display thresholds and labels -----------------------------
MONTH_ABBR = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
NA = "N/A"
# ----------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------------ C1
def key_to_date(key) -> Column:
    """``YYYYMMDD`` int/string or ISO text (``YYYY-MM-DD``, a time may follow)
    -> DATE; ``0``/blank/invalid -> NULL."""
    s = F.trim(_c(key).cast("string"))
    iso = s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}($|[T ])")
    return (F.when((s == "") | (s == "0"), F.lit(None).cast("date"))
             .when(iso, F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))
             .otherwise(F.try_to_date(s, "yyyyMMdd")))


def date_to_key(d) -> Column:
    d = _c(d)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def key_to_iso(key) -> Column:
    """``YYYYMMDD`` -> ``YYYY-MM-DD`` text."""
    return F.date_format(key_to_date(key), "yyyy-MM-dd")


def iso_to_key(text) -> Column:
    """ISO text -> ``YYYYMMDD`` int; anything else -> NULL."""
    return date_to_key(key_to_date(text))


# ------------------------------------------------------------------------ C3
def to_amount(col, strict: bool = False) -> Column:
    """Text amount -> double; ``'NULL'`` -> NULL.

    ``strict=False``: unparsable -> NULL (the composite then fills 0);
    ``strict=True``: unparsable raises under ANSI mode (the totals path).
    """
    c = _c(col).cast("string")
    cleaned = F.when(c.isNull() | (c == "NULL"), F.lit(None).cast("string")).otherwise(c)
    return cleaned.cast("double") if strict else cleaned.try_cast("double")


# ------------------------------------------------------------------------ C4
def safe_change(cur, prior) -> Column:
    p = _c(prior).cast("double")
    return F.when(p.isNull() | (p == 0), F.lit(None).cast("double")).otherwise(
        F.try_divide(_c(cur).cast("double"), p) - 1)


# ------------------------------------------------------------------------ C5
def finite(col) -> Column:
    """NaN and +-Infinity -> NULL."""
    c = _c(col).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast("double")).otherwise(c)


# ------------------------------------------------------------------------ C8
def _fixed(x: Column, places: int) -> Column:
    """Decimal text with ``places`` digits, half up on the exact value."""
    return x.cast(f"decimal(38,{places})").cast("string")


def human_number(col, style: str = "table") -> Column:
    """Compact numbers.

    table: ``1.23M`` / ``4.56K`` / ``7.89`` (strict ``>`` thresholds), NULL -> ``N/A``
    chart: ``1.2B`` / ``3.4M`` / ``5.6K`` / plain (strict ``>``)
    range: ``$1.0M`` / ``$2.5K`` / ``$999`` (``>=`` thresholds)
    usd:   ``$1,234,567`` (no decimals, thousands separators)
    compact: ``$1.2K`` / ``$3.4M`` / ``$1B`` / ``$2T`` (one decimal, no ``.0``)
    """
    x = _c(col).cast("decimal(38,6)")
    a = F.abs(x)
    if style == "table":
        return (F.when(x.isNull(), F.lit(NA))
                 .when(a > 1000000, F.concat(_fixed(x / 1000000, 2), F.lit("M")))
                 .when(a > 1000, F.concat(_fixed(x / 1000, 2), F.lit("K")))
                 .otherwise(_fixed(x, 2)))
    if style == "chart":
        plain = F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")) \
                 .otherwise(F.regexp_replace(x.cast("string"), "0+$", ""))
        return (F.when(a > 1000000000, F.concat(_fixed(x / 1000000000, 1), F.lit("B")))
                 .when(a > 1000000, F.concat(_fixed(x / 1000000, 1), F.lit("M")))
                 .when(a > 1000, F.concat(_fixed(x / 1000, 1), F.lit("K")))
                 .otherwise(plain))
    if style == "range":
        plain = F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")) \
                 .otherwise(F.regexp_replace(x.cast("decimal(38,3)").cast("string"), "0+$", ""))
        return (F.when(x >= 1000000, F.concat(F.lit("$"), _fixed(x / 1000000, 1), F.lit("M")))
                 .when(x >= 1000, F.concat(F.lit("$"), _fixed(x / 1000, 1), F.lit("K")))
                 .otherwise(F.concat(F.lit("$"), plain)))
    if style == "usd":
        whole = F.abs(x.cast("decimal(38,0)"))
        body = F.concat(F.lit("$"), F.format_number(whole, 0))
        return F.when(x < 0, F.concat(F.lit("-"), body)).otherwise(body)
    if style == "compact":
        text = lambda unit, mark: F.concat(F.regexp_replace(_fixed(a / unit, 1), "[.]0$", ""), F.lit(mark))
        # a unit starts where the smaller one would be rounded to 1000
        body = (F.when(a >= F.lit("999950000000").cast("decimal(20,2)"), text(1000000000000, "T")).when(a >= 999950000, text(1000000000, "B"))
                 .when(a >= 999950, text(1000000, "M")).when(a >= F.lit("999.95").cast("decimal(10,2)"), text(1000, "K"))
                 .otherwise(text(1, "")))
        return F.concat(F.when(x < 0, F.lit("-$")).otherwise(F.lit("$")), body)
    raise ValueError(f"unknown style {style!r}")


def range_label(lo, hi) -> Column:
    """``$1.0M - $2.0M`` for a commitment range."""
    return F.concat(human_number(lo, "range"), F.lit(" - "), human_number(hi, "range"))


# ------------------------------------------------------------------------ C9
def percent_text(col) -> Column:
    """Ratio -> ``12.34%``; NULL/NaN -> ``N/A``."""
    c = _c(col).cast("double")
    return F.when(c.isNull() | F.isnan(c), F.lit(NA)).otherwise(
        F.concat(_fixed((c * 100).cast("decimal(38,10)"), 2), F.lit("%")))


def sign_class(col) -> Column:
    """``positive`` (>= 0), ``negative``, or ``none`` for NULL/NaN."""
    c = _c(col).cast("double")
    return F.when(c.isNull() | F.isnan(c), F.lit("none")).when(c >= 0, F.lit("positive")).otherwise(F.lit("negative"))


# ----------------------------------------------------------------------- C10
def _month_abbr(d: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_ABBR]), F.month(d))


def date_label(key, style: str = "long") -> Column:
    """``long``: ``Jan 31, 2024``; ``short``: ``Jan 24``; ``month``: ``January 2024``;
    ``month_short``: ``Jan 2024``.  Key ``0``/blank -> ``N/A``."""
    d = key_to_date(key)
    if style == "long":
        out = F.concat(_month_abbr(d), F.lit(" "), F.dayofmonth(d).cast("string"), F.lit(", "),
                       F.year(d).cast("string"))
    elif style == "short":
        out = F.concat(_month_abbr(d), F.lit(" "), F.lpad((F.year(d) % 100).cast("string"), 2, "0"))
    elif style == "month":
        out = F.concat(F.date_format(d, "MMMM"), F.lit(" "), F.year(d).cast("string"))
    elif style == "month_short":
        out = F.concat(_month_abbr(d), F.lit(" "), F.year(d).cast("string"))
    else:
        raise ValueError(f"unknown style {style!r}")
    return F.when(d.isNull(), F.lit(NA)).otherwise(out)


# ----------------------------------------------------------------------- C11
def freshness(latest_key, as_of) -> Column:
    """``Fresh`` if the latest period is on or after ``as_of`` minus one
    month (clamped to month end), ``Stale`` otherwise, ``No data`` if NULL."""
    d = key_to_date(latest_key)
    limit = F.add_months(F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of, -1)
    return F.when(d.isNull(), F.lit("No data")).when(d >= limit, F.lit("Fresh")).otherwise(F.lit("Stale"))


# ------------------------------------------------------------------------ C12/13
def to_double(col) -> Column:
    return _c(col).cast("double")


def key_text(col, zero_as: str = "0") -> Column:
    """Keys as strings, NULL/0 prior as ``'0'``."""
    c = _c(col)
    return F.when(c.isNull() | (c == 0), F.lit(zero_as)).otherwise(c.cast("bigint").cast("string"))
