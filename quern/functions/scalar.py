"""Scalar semantics that differ from Spark's, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.types import Type


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; raises on zero."""
    return ((a % b) + b) % b


def floor_divide(a: Column, b: Column) -> Column:
    """Integer quotient rounded down; raises on zero."""
    return F.call_function("div", a - modulo(a, b), b)


def matches(s: Column, pattern: Column) -> Column:
    """Whether the pattern matches at the start, not necessarily up to the end."""
    return F.rlike(s, F.concat(F.lit("^(?:"), pattern, F.lit(")")))


def iso_text(ts: Column) -> Column:
    """ISO 8601 with a T, with microseconds only where there are some."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def float_text(x: Column) -> Column:
    """Shortest text that reads back as the same number: plain from 1e-4 below 1e16, else with an exponent of two digits or more."""
    java = x.cast("string")
    size = F.abs(x)
    digits = F.regexp_replace(java.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
    mantissa = F.regexp_replace(F.regexp_extract(java, r"^(.*)E", 1), r"\.0$", "")
    power = F.regexp_extract(java, r"E(-?\d+)$", 1)
    sign = F.when(F.startswith(power, F.lit("-")), F.lit("e-")).otherwise(F.lit("e+"))
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(size == float("inf"), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when((size == 0) | ((size >= 1e-4) & (size < 1e16)), F.when(size == 0, java).otherwise(plain))
        .otherwise(F.concat(mantissa, sign, F.lpad(F.regexp_replace(power, "-", ""), F.greatest(F.lit(2), F.length(F.regexp_replace(power, "-", ""))), F.lit("0"))))
    )


def cast(c: Column, source: Type, to: Type) -> Column:
    """A cast that the type system allows."""
    if source is to:
        return c
    if to is Type.VARCHAR:
        if source is Type.DATETIME:
            return iso_text(c)
        if source is Type.BOOLEAN:
            return F.when(c, F.lit("True")).when(~c, F.lit("False"))
        return float_text(c) if source is Type.FLOAT else c.cast("string")
    return c.cast(to.spark())
