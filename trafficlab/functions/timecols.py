"""Epoch arithmetic that does not depend on the session time zone.

Packet times arrive as TIMESTAMP_NTZ (wall clock, no zone).  Casting them to
TIMESTAMP would apply the session time zone, shift every epoch by its
offset and even reorder times around a daylight-saving change; the epoch of
an NTZ value is therefore taken as its distance from 1970-01-01 00:00 on the
same clock.  Zoned TIMESTAMP values (streams) use ``unix_micros``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(c: Column, ntz: bool = True) -> Column:
    """Microseconds since the epoch of ``c`` (NTZ or zoned TIMESTAMP)."""
    if ntz:
        return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), c)
    return F.unix_micros(c)


def millis(c: Column, ntz: bool = True) -> Column:
    """Milliseconds since the epoch (truncated, like ``unix_millis``)."""
    return F.floor(micros(c, ntz) / F.lit(1000)).cast("long")


def is_ntz(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.TimestampNTZType)


def col_micros(df: DataFrame, name: str) -> Column:
    """Epoch microseconds of column ``name`` of ``df`` (type-aware)."""
    return micros(F.col(name), is_ntz(df, name))
