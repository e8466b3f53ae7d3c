"""Times: parsing, minute labels, cut-offs and ages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

AsOf = str | dt.datetime | None


def parse_iso(column: str | Column) -> Column:
    """ISO text to a timestamp, null where it is not one."""
    return F.try_to_timestamp(F.col(column) if isinstance(column, str) else column)


def minute(column: str | Column) -> Column:
    return F.date_trunc("minute", column)


def minute_label(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm")


def moment(df: DataFrame, column: str, as_of: AsOf) -> Column:
    """`as_of` (now, if none) in the type of the column, so that a comparison with it can
    be handed to the scan."""
    kind = df.schema[column].dataType
    if as_of is None:
        return F.current_timestamp().cast(kind)
    return F.lit(str(as_of)).cast(kind)


def minutes_before(point: Column, minutes: float) -> Column:
    return point - F.make_dt_interval(secs=F.lit(round(minutes * 60, 6)))


def age_minutes(latest: Column, now: Column) -> Column:
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(latest.cast("timestamp"))
    return micros / F.lit(60e6)
