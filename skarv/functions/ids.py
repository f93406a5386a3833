"""Organisation numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mod-11 weights of a nine-digit organisation number.
WEIGHTS = (3, 2, 7, 6, 5, 4, 3, 2)


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def nine_digits(value: Column) -> Column:
    """The nine digits in ``value``; null where there aren't exactly nine."""
    digits = only_digits(value)
    return F.when(F.length(digits) == 9, digits)


def mod11_valid(value: Column) -> Column:
    """Whether ``value`` is nine digits whose last is the mod-11 check digit; never null."""
    digit = [F.substring(value, i + 1, 1).try_cast("int") for i in range(9)]
    rest = sum((d * w for d, w in zip(digit, WEIGHTS)), F.lit(0)) % 11
    check = F.when(rest == 0, F.lit(0)).otherwise(11 - rest)
    return F.coalesce(value.rlike("^[0-9]{9}$") & (check == digit[8]), F.lit(False))
