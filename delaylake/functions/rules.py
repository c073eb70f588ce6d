"""Scalar rules of the silver and gold layers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
SHORT_BELOW = 300
MEDIUM_BELOW = 800
ONTIME_UP_TO = 15
AIRPORT_WIDTH, AIRPORT_DEFAULT = 3, "UNK"
AIRLINE_WIDTH, AIRLINE_DEFAULT = 10, "UNKNOWN"


def as_date(text: Column) -> Column:
    """ISO date; text that is not a date gives NULL, with ANSI mode on or off."""
    return text.try_cast("date")


def as_number(text: Column) -> Column:
    """Double; text that is not a number gives NULL, with ANSI mode on or off.

    Empty text is common and set apart, since each failing cast costs an exception.
    """
    return F.nullif(text, F.lit("")).try_cast("double")


def one_if(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, 1).otherwise(0)


def cancelled_flag(text: Column) -> Column:
    return one_if(as_number(text) == 1.0)


def distance_bucket(distance: Column) -> Column:
    """Unknown distances (NULL, NaN) count as LONG."""
    return (
        F.when(distance < SHORT_BELOW, "SHORT")
        .when(distance < MEDIUM_BELOW, "MEDIUM")
        .otherwise("LONG")
    )


def delay_bucket(delay: Column) -> Column:
    """NULL is UNKNOWN; NaN is above every number, so DELAYED."""
    return (
        F.when(delay.isNull(), "UNKNOWN")
        .when(delay <= ONTIME_UP_TO, "ONTIME")
        .otherwise("DELAYED")
    )


def standardize(text: Column, width: int, default: str) -> Column:
    """First ``width`` characters; the default replaces NULL only, not the empty string."""
    return F.coalesce(F.substring(text, 1, width), F.lit(default))


def airport_code(text: Column) -> Column:
    return standardize(text, AIRPORT_WIDTH, AIRPORT_DEFAULT)


def airline_name(text: Column) -> Column:
    return standardize(text, AIRLINE_WIDTH, AIRLINE_DEFAULT)


#: Fixed value: the number of values that ``hash_bits`` can have.
HASH_VALUES = 1 << 32


def hash_bits(*keys: Column) -> Column:
    """32 bits from the md5 of the keys: the same on every run and partitioning."""
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
