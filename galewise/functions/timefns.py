"""Forecast and observation time stamps.

Forecast times are UTC strings ``FyyyyMMddHH``; stations report local hours
``yyMMddHH`` at +08:00.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text formats of the forecast and station data.
FORECAST_FORMAT = "'F'yyyyMMddHH"
STATION_FORMAT = "yyMMddHH"
STATION_OFFSET_HOURS = 8


def parse_forecast_time(text: Column) -> Column:
    return F.to_timestamp_ntz(text, F.lit(FORECAST_FORMAT))


def format_forecast_time(ts: Column) -> Column:
    return F.date_format(ts, FORECAST_FORMAT)


def add_hours(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours.cast("int"))


def station_to_forecast_time(text: Column) -> Column:
    """Station local hour to the forecast's UTC time string."""
    local = F.to_timestamp_ntz(text, F.lit(STATION_FORMAT))
    return format_forecast_time(add_hours(local, F.lit(-STATION_OFFSET_HOURS)))


def shift_forecast_time(text: Column, hours: Column) -> Column:
    """Forecast time string moved back by ``hours``."""
    return format_forecast_time(add_hours(parse_forecast_time(text), -hours.cast("int")))


def render_in_zone(ts_utc: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts_utc, zone), "yyyyMMddHHmm")


def epoch_seconds(ts_utc: Column) -> Column:
    """Seconds since 1970, whatever the time zone of the session."""
    return F.unix_seconds(F.from_utc_timestamp(ts_utc.cast("timestamp"), F.current_timezone()))


def lead_labels(first: int = 3, last: int = 72, step: int = 3) -> Column:
    """``['003', '006', …]``."""
    return F.transform(
        F.sequence(F.lit(first), F.lit(last), F.lit(step)),
        lambda x: F.lpad(x.cast("string"), 3, "0"),
    )
