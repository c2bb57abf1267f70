"""Column functions: all built-in expressions, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings that the input format reads as missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def missing_to_null(c: Column) -> Column:
    return F.when(c.isin(MISSING), F.lit(None)).otherwise(c)


def parse_year(year: Column, fallback_date: Column) -> Column:
    """First four characters of the year, else the year of the fallback date, else NULL.

    Full-width digits count as digits. The date may be yyyy-MM-dd, yyyy/MM/dd, yyyyMMdd, or
    anything that Spark casts to a timestamp.
    """
    digits = F.translate(F.trim(F.substring(year, 1, 4)), "０１２３４５６７８９", "0123456789")
    number = F.when(digits.rlike(r"^[+-]?\d+$"), digits.try_cast("int"))
    dates = [F.try_to_timestamp(fallback_date, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")]
    return F.coalesce(number, *[F.year(d) for d in dates], F.year(fallback_date.try_cast("timestamp"))).cast("int")


def concat_text(parts: Sequence[Column]) -> Column:
    """Parts in order without a separator, NULL as the empty string."""
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in parts]) if parts else F.lit("")


def retro_idf(n_prior: Column, df_prior: Column) -> Column:
    """ln(N / (1 + df)) over strictly earlier years; 0 where there is none; may be negative."""
    return F.when(F.coalesce(n_prior, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.log(n_prior / (F.lit(1.0) + F.coalesce(df_prior, F.lit(0)))))


def year_of_name(name: Column) -> Column:
    """Year in a file name such as term_df_year=2010.json, 0 where there is none."""
    found = F.regexp_extract(name, r"year=(\d+)", 1)
    return F.when(found == "", F.lit(0)).otherwise(found.try_cast("int"))
