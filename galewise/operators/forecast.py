"""Gridded forecast → feature arrays, station readings → labels, and their time joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galewise.functions.timefns import shift_forecast_time, station_to_forecast_time
from galewise.sources.files import with_name_parts

# The forecast grid, the box around the stations, channels and station ids.
LON_RANGE = (121.875, 122.125)
LAT_RANGE = (29.25, 29.625)
DEGREES_PER_CELL = 0.125
LON_START = 60.0
LAT_START = 60.0
CHANNELS = ["fg310", "t2", "u10", "v10", "u100", "v100"]
STATIONS = ["K2931", "K2942", "K2962"]
LEAD_RANGE = (3, 72)
NEAREST_CELL = 4


def lon_cells(lon: tuple[float, float] = LON_RANGE) -> range:
    first, last = (int((x - LON_START) / DEGREES_PER_CELL) for x in lon)
    return range(first, last + 1)


def lat_cells(lat: tuple[float, float] = LAT_RANGE) -> range:
    """Rows of the grid; latitude falls as the row number rises."""
    first, last = (int((LAT_START - x) / DEGREES_PER_CELL) for x in reversed(lat))
    return range(first, last + 1)


def lead_filter(named: DataFrame, leads: tuple[int, int] = LEAD_RANGE) -> DataFrame:
    """Keep the leads of interest, judged by the file name alone.

    On a grid from :func:`store_grid` the lead is a partition, so other leads are not read.
    """
    lead = F.col("lead") if "lead" in named.columns else F.col("gap").cast("int")
    return named.where(lead.between(*leads))


def store_grid(grid: DataFrame, path: str) -> DataFrame:
    """Store decoded cells by lead, sorted so that the box filter can skip row groups.

    Leads differ little in size; a larger one is split by Spark's rebalancing.
    """
    named = with_name_parts(grid, "file_name").withColumn("lead", F.col("gap").cast("int"))
    (
        named.hint("rebalance", F.col("lead"))
        .sortWithinPartitions("lead", "variable", "lat_idx", "lon_idx")
        .write.partitionBy("lead")
        .parquet(path)
    )
    return grid.sparkSession.read.parquet(path)


def forecast_features(
    grid: DataFrame,
    leads: tuple[int, int] = LEAD_RANGE,
    channels: list[str] | None = None,
    lat: range | None = None,
    lon: range | None = None,
    compat_10m: bool = False,
) -> DataFrame:
    """The box of every channel as one array per file: ``(gap, F_time, input)``.

    Channels follow each other, rows before columns. ``compat_10m`` puts the 10 m winds
    in the place of the 100 m winds. The box filter reaches the scan, and each array
    position is its own aggregate, so partial results are one row per file.
    """
    channels = channels or CHANNELS
    lat, lon = lat or lat_cells(), lon or lon_cells()
    cells = len(lat) * len(lon)
    source = {"u100": "u10", "v100": "v10"} if compat_10m else {}
    reads = [source.get(c, c) for c in channels]
    needed = sorted(set(reads))
    in_box = F.col("lat_idx").between(lat[0], lat[-1]) & F.col("lon_idx").between(lon[0], lon[-1])
    boxed = grid.where(in_box & F.col("variable").isin(needed))
    channel = F.array_position(F.array(*[F.lit(c) for c in needed]), F.col("variable")) - 1
    cell = (F.col("lat_idx") - lat[0]) * len(lon) + (F.col("lon_idx") - lon[0])
    named = boxed if "lead" in boxed.columns else with_name_parts(boxed, "file_name")
    at = lead_filter(named, leads).select(
        "gap", "F_time", (channel * cells + cell).cast("int").alias("pos"), "value"
    )
    per_file = at.groupBy("gap", "F_time").agg(
        *[F.max(F.when(F.col("pos") == k, F.col("value"))).alias(f"p{k}") for k in range(len(needed) * cells)]
    )
    order = [needed.index(c) * cells + k for c in reads for k in range(cells)]
    return per_file.select("gap", "F_time", F.array(*[F.col(f"p{k}") for k in order]).alias("input"))


def station_labels(obs: DataFrame, stations: list[str] | None = None) -> DataFrame:
    """Readings per hour as a list of ``(station, gust)``, ordered by station and gust.

    Every reading counts; ``stations`` limits the list to some of them.
    """
    rows = obs if stations is None else obs.where(F.col("StationNum").isin(stations))
    readings = rows.select(
        "StationNum",
        station_to_forecast_time(F.col("ObservTimes")).alias("F_time"),
        (F.col("ExMaxWindV") * F.lit(0.1)).alias("ExMaxWindV"),
    ).where("F_time is not null")
    return readings.groupBy("F_time").agg(
        F.array_sort(F.collect_list(F.struct("StationNum", "ExMaxWindV"))).alias("label")
    )


def last_reading(label: Column) -> Column:
    """Reading of the highest station present in the hour."""
    return F.element_at(label, -1)["ExMaxWindV"]


def join_valid_time(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Forecasts with the readings at the hour they are valid for."""
    return features.join(labels, "F_time")


def samples_without_lag(features: DataFrame, labels: DataFrame) -> DataFrame:
    joined = join_valid_time(features, labels)
    return joined.select("gap", "F_time", "input", last_reading(F.col("label")).alias("label"))


def samples_with_lag(features: DataFrame, labels: DataFrame, lag_hours: int | None = None) -> DataFrame:
    """Samples whose input ends with an earlier reading: ``(gap, F_time, input, label)``.

    ``lag_hours`` back from the valid hour, or back to the issue time when it is None.
    """
    lag = F.col("gap").cast("int") if lag_hours is None else F.lit(lag_hours)
    current = join_valid_time(features, labels.withColumnRenamed("label", "label_x"))
    earlier = labels.select(F.col("F_time").alias("lag_time"), F.col("label").alias("label_y"))
    both = current.withColumn("lag_time", shift_forecast_time(F.col("F_time"), lag)).join(
        earlier, "lag_time"
    )
    return both.select(
        "gap",
        "F_time",
        F.concat("input", F.array(last_reading(F.col("label_y")))).alias("input"),
        last_reading(F.col("label_x")).alias("label"),
    )


def wind_components(obs: DataFrame) -> DataFrame:
    """Speed in tenths and direction in degrees to the (u, v) wind vector."""
    angle = F.radians(F.col("WindDirect10").cast("double"))
    speed = F.col("WindVelocity10").cast("double")
    return obs.select(
        "StationNum",
        "ObservTimes",
        (-speed * F.sin(angle) * F.lit(0.1)).alias("u10"),
        (-speed * F.cos(angle) * F.lit(0.1)).alias("v10"),
    )
