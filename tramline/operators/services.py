"""Service patterns of dates, and dates that pose the same problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import columns as C
from tramline.operators.lineage import cut, small
from tramline.sources.gtfs import WEEKDAYS


def date_range(spark, start: str, days: int) -> DataFrame:
    """(date) for consecutive days."""
    return spark.range(days).select(C.offset_date(F.lit(start), F.col("id").cast("int")).alias("date"))


def active_on(calendar: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, service_id): services that run on each of the dates."""
    days = F.array(*[F.col(d) for d in (WEEKDAYS[6], *WEEKDAYS[:6])])
    on = (F.col("date") >= F.col("start_date")) & (F.col("date") <= F.col("end_date")) & F.element_at(days, C.day_of_week(F.col("date")) + 1)
    return calendar.join(small(cut(dates.distinct())), on).select("date", "service_id").distinct()


def day_services(active: DataFrame, starts: DataFrame, later: int) -> DataFrame:
    """(date, day, services): sorted services of each day of the span of 1 + later days from each date; [] where none runs."""
    spans = starts.select("date", F.explode(F.sequence(F.lit(0), F.lit(later))).alias("day")).withColumn("at", C.offset_date(F.col("date"), F.col("day")))
    found = active.groupBy(F.col("date").alias("at")).agg(F.array_sort(F.collect_set("service_id")).alias("services"))
    return spans.join(found, "at", "left").select("date", "day", F.coalesce("services", F.array().cast("array<string>")).alias("services"))


def patterns(services: DataFrame) -> DataFrame:
    """(date, days, pattern): the services of a span's days as one array of arrays."""
    rows = services.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("day", "services"))).alias("rows"))
    return rows.select("date", F.size("rows").alias("days"), F.transform("rows", lambda r: r["services"]).alias("pattern"))


def pattern_text(pattern):
    """a,b|c|: services by comma, days by bar."""
    return F.array_join(F.transform(pattern, lambda day: F.array_join(day, ",")), "|")


def duplicates(found: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """found (keys, date, pattern) with duplicate_of: the first earlier date of an equal pattern, else null."""
    first = F.min("date").over(Window.partitionBy(*keys, "pattern"))
    return found.withColumn("duplicate_of", F.when(first < F.col("date"), first))


def used_services(paths: DataFrame, trips: DataFrame) -> DataFrame:
    """(day, services): services of the rides of paths (legs), by service day; trip ids carry their day."""
    legs = paths.select(F.explode("legs").alias("leg")).filter("not leg.is_flex").select("leg.trip_id").distinct()
    found = legs.join(trips.select("trip_id", "service_id"), "trip_id", "left").withColumn("day", C.service_day(F.col("trip_id")))
    return found.groupBy("day").agg(F.array_sort(F.collect_set("service_id")).alias("services"))


def to_json(found: DataFrame) -> DataFrame:
    """(date, document): {"sd-0": [...], ...} of each pattern."""
    entries = F.transform("pattern", lambda day, i: F.struct(F.concat(F.lit("sd-"), i.cast("string")).alias("k"), day.alias("v")))
    return found.select("date", F.to_json(F.map_from_entries(entries)).alias("document"))


def from_json(documents: DataFrame) -> DataFrame:
    """(date, pattern); raises where the days are not sd-0, sd-1, ... without a gap."""
    m = F.from_json("document", "map<string,array<string>>")
    keys = F.transform(F.sequence(F.lit(0), F.size("m") - 1), lambda i: F.concat(F.lit("sd-"), i.cast("string")))
    whole = F.when(F.size("m") == 0, F.array().cast("array<string>")).otherwise(keys)
    good = F.size(F.array_except(whole, F.map_keys("m"))) == 0
    pattern = F.transform(whole, lambda k: F.col("m")[k])
    return documents.withColumn("m", m).select("date", F.when(good, pattern).otherwise(F.raise_error(F.lit("days of a pattern must be consecutive")).cast("array<array<string>>")).alias("pattern"))
