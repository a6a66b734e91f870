"""GTFS feeds as DataFrames: reading, writing, and the fixed schemas of the six tables."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tramline.functions import columns as C

WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
STOPS = "stop_id string, stop_name string, stop_lat double, stop_lon double, parent_station string"
TRIPS = "route_id string, direction_id int, trip_id string, service_id string, trip_headsign string"
CALENDAR = "service_id string, " + ", ".join(f"{d} boolean" for d in WEEKDAYS) + ", start_date string, end_date string"
STOP_TIMES = "trip_id string, stop_id string, stop_sequence int, arrival int, departure int"
ROUTES = "route_id string, route_short_name string, route_long_name string, route_color string, route_text_color string"
DIRECTIONS = "route_id string, direction_id int, direction string"


@dataclass(frozen=True)
class GtfsFeed:
    """The tables of a feed; a filtered day has no calendar. Times are seconds since the service day began."""

    stops: DataFrame
    trips: DataFrame
    calendar: DataFrame | None
    stop_times: DataFrame
    routes: DataFrame
    directions: DataFrame

    @staticmethod
    def of(stops, trips, calendar, stop_times, routes, directions=None, strict=True) -> GtfsFeed:
        """A feed from raw tables, whose times are texts and whose optional columns may be missing."""
        trips = conform(trips, TRIPS)
        return GtfsFeed(
            stops=conform(stops, STOPS).withColumn("parent_station", F.nullif("parent_station", F.lit(""))),
            trips=trips,
            calendar=None if calendar is None else conform(calendar, CALENDAR),
            stop_times=parsed_stop_times(stop_times, strict),
            routes=conform(routes, ROUTES),
            directions=directions_of(trips) if directions is None else conform(directions, DIRECTIONS),
        )

    def with_(self, **tables) -> GtfsFeed:
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: t for f in fields(self) if (t := getattr(self, f.name)) is not None}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of schema in order, cast; missing text columns are ''."""
    wanted = T._parse_datatype_string(schema)
    columns = []
    for f in wanted.fields:
        if f.name not in df.columns:
            columns.append(F.lit("").cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.BooleanType) and isinstance(df.schema[f.name].dataType, T.StringType):
            columns.append((F.trim(f.name) == "1").alias(f.name))
        elif isinstance(f.dataType, T.StringType):  # an empty field is '', as readers of CSV give null for it
            columns.append(F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias(f.name))
        else:
            columns.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*columns)


def parsed_stop_times(raw: DataFrame, strict: bool = True) -> DataFrame:
    """stop_times in seconds; rows with a blank time are skipped, other bad times raise unless not strict.

    Times come out of a generator, so that a filter on them asks for the seconds and isn't
    put in terms of the texts, whose expressions would be evaluated again wherever the parser names them.
    """
    blank = (F.coalesce(F.trim("arrival_time"), F.lit("")) == "") | (F.coalesce(F.trim("departure_time"), F.lit("")) == "")
    times = F.struct(C.parse_time(F.col("arrival_time"), strict).alias("arrival"), C.parse_time(F.col("departure_time"), strict).alias("departure"))
    return raw.select("trip_id", "stop_id", F.col("stop_sequence").cast("int").alias("stop_sequence"), F.inline(F.when(~blank, F.array(times))))


def rejected_stop_times(raw: DataFrame) -> DataFrame:
    """Rows whose times are neither blank nor times."""
    bad = lambda c: (F.trim(c) != "") & C.parse_time(F.col(c), strict=False).isNull()
    return raw.filter(bad("arrival_time") | bad("departure_time"))


def directions_of(trips: DataFrame) -> DataFrame:
    """Directions where a feed has no such table: the commonest head sign, the first of equals, with * if there are others."""
    counted = trips.groupBy("route_id", "direction_id", "trip_headsign").agg(F.count("*").alias("n"))
    by = Window.partitionBy("route_id", "direction_id")
    ranked = counted.withColumn("r", F.row_number().over(by.orderBy(F.desc("n"), "trip_headsign"))).withColumn("of", F.count("*").over(by))
    return ranked.filter("r = 1").select("route_id", "direction_id", F.concat("trip_headsign", F.when(F.col("of") > 1, "*").otherwise("")).alias("direction"))


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, quote='"', escape='"', inferSchema=False, ignoreLeadingWhiteSpace=True)


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return _read_csv(spark, f"{folder}/{name}.txt")


def has_table(spark: SparkSession, folder: str, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.txt")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def load_feed(spark: SparkSession, folder: str, strict: bool = True) -> GtfsFeed:
    """The feed in a folder of GTFS files. Only the six tables are read; directions.txt is optional."""
    read = lambda name: load_table(spark, folder, name)
    directions = read("directions") if has_table(spark, folder, "directions") else None
    return GtfsFeed.of(read("stops"), read("trips"), read("calendar"), read("stop_times"), read("routes"), directions, strict)


def load_day(spark: SparkSession, folder: str) -> GtfsFeed:
    """A feed that was filtered to a day and saved. Its calendar must be empty."""
    found = load_feed(spark, folder)
    if not found.calendar.isEmpty():
        raise ValueError("a filtered day has an empty calendar")
    return found.with_(calendar=None)


def csv_tables(feed: GtfsFeed) -> dict[str, DataFrame]:
    """The tables as they are written: coordinates with six decimals, times as text."""
    stops = feed.stops.select("stop_id", "stop_name", *[F.format_string("%.6f", F.col(c)).alias(c) for c in ("stop_lat", "stop_lon")], F.coalesce("parent_station", F.lit("")).alias("parent_station"))
    times = feed.stop_times.select("trip_id", "stop_id", "stop_sequence", C.format_time(F.col("arrival")).alias("arrival_time"), C.format_time(F.col("departure")).alias("departure_time"))
    calendar = feed.stops.sparkSession.createDataFrame([], CALENDAR) if feed.calendar is None else feed.calendar
    calendar = calendar.select("service_id", *[F.col(d).cast("int").alias(d) for d in WEEKDAYS], "start_date", "end_date")
    return {"stops": stops, "trips": feed.trips, "calendar": calendar, "stop_times": times, "routes": feed.routes, "directions": feed.directions}


def save_feed(feed: GtfsFeed, folder: str) -> None:
    """Write each table as a folder of CSV parts named <table>.txt; an empty one is not left there, but for the calendar.

    Tables are computed once: whether one is empty is looked up in what was written.
    """
    spark = feed.stops.sparkSession
    for name, df in csv_tables(feed).items():
        path = f"{folder}/{name}.txt"
        # Empty texts stay empty fields; texts are quoted where they hold quotes or commas.
        df.write.mode("overwrite").csv(path, header=True, emptyValue="", escape='"')
        if name != "calendar" and spark.read.schema(df.schema).csv(path, header=True, quote='"', escape='"').isEmpty():
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
