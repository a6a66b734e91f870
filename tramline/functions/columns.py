"""Column expressions: times, dates, labels, coordinates, ids and step arithmetic.

Times are whole seconds since the start of a service day. They may pass 24:00 and
may be negative, so they are never timestamps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
METRES_PER_DEGREE = 111_000.0
#: Reference latitude whose cosine scales longitudes to metres.
REFERENCE_LATITUDE = 37.0


def parse_time(text: Column, strict: bool = True) -> Column:
    """Seconds of a text that begins HH:MM:SS; what follows is ignored. Others raise, or give null if not strict."""
    digits = lambda at: F.substring(text, at, 2).cast("int")
    good = text.rlike(r"^[0-9]{2}:[0-9]{2}:[0-9]{2}")
    number = digits(1) * 3600 + digits(4) * 60 + digits(7)
    if strict:
        return F.when(text.isNull(), F.lit(None).cast("int")).when(good, number).otherwise(F.raise_error(F.concat(F.lit("not a time: "), text)).cast("int"))
    return F.when(good, number)


def format_time(seconds: Column) -> Column:
    """HH:MM:SS of seconds that are not negative; hours pass 24."""
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    hours, rest = _div(seconds, 3600), [F.lit(":"), two(_div(seconds, 60) % 60), F.lit(":"), two(seconds % 60)]
    # Formatting by a pattern takes several times as long; it is left with what has more than two digits.
    return F.when((seconds >= 0) & (seconds < 360_000), F.concat(two(hours), *rest)).otherwise(F.format_string("%02d:%02d:%02d", hours, _div(seconds, 60) % 60, seconds % 60))


def format_signed_time(seconds: Column) -> Column:
    return F.concat(F.when(seconds < 0, "-").otherwise(""), format_time(F.abs(seconds)))


def clock_label(seconds: Column) -> Column:
    """HH:MM, hours pass 24."""
    return F.format_string("%02d:%02d", _div(seconds, 3600), _div(seconds, 60) % 60)


def duration_label(seconds: Column) -> Column:
    """h:mm:ss."""
    return F.format_string("%d:%02d:%02d", _div(seconds, 3600), _div(seconds, 60) % 60, seconds % 60)


def short_duration(seconds: Column) -> Column:
    """5h55m or 34m; minutes are rounded half up."""
    minutes = F.floor((seconds + 30) / 60).cast("int")
    return F.when(minutes >= 60, F.format_string("%dh%dm", _div(minutes, 60), minutes % 60)).otherwise(F.format_string("%dm", minutes))


def elapsed_label(seconds: Column) -> Column:
    """3.1s below a minute, else 10m14s; seconds are rounded half up."""
    tenths, whole = F.floor(seconds * 10 + 0.5).cast("long"), F.floor(seconds + 0.5).cast("long")
    return F.when(tenths < 600, F.format_string("%d.%ds", _div(tenths, 10), tenths % 10)).otherwise(F.format_string("%dm%ds", _div(whole, 60), whole % 60))


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def day_of_week(date: Column) -> Column:
    """0 for Sunday to 6 for Saturday, of a YYYYMMDD text."""
    return F.dayofweek(F.to_date(date, "yyyyMMdd")) - 1


def offset_date(date: Column, days: Column | int) -> Column:
    return F.date_format(F.date_add(F.to_date(date, "yyyyMMdd"), days), "yyyyMMdd")


def weekday_label(date: Column) -> Column:
    """Fri 07-18."""
    return F.concat(F.date_format(F.to_date(date, "yyyyMMdd"), "E"), F.lit(" "), F.substring(date, 5, 2), F.lit("-"), F.substring(date, 7, 2))


def with_service_day(trip_id: Column, day: Column | int) -> Column:
    return F.concat(trip_id, F.lit(":sd-"), (day if isinstance(day, Column) else F.lit(day)).cast("string"))


def service_day(trip_id: Column, strict: bool = True) -> Column:
    """The day of the last :sd-<digits> suffix; ids without one raise, or give null if not strict."""
    found = F.regexp_extract(trip_id, r"^.*:sd-([0-9]+)$", 1)
    day = F.when(found != "", found.cast("int"))
    if strict:
        return F.when(trip_id.isNotNull() & (found == ""), F.raise_error(F.concat(F.lit("no service day: "), trip_id)).cast("int")).otherwise(day)
    return day


def without_service_day(trip_id: Column) -> Column:
    return F.regexp_replace(trip_id, r":sd-[0-9]+$", "")


def metres_x(lon: Column, latitude: float = REFERENCE_LATITUDE) -> Column:
    return lon * METRES_PER_DEGREE * F.cos(F.radians(F.lit(latitude)))


def metres_y(lat: Column) -> Column:
    return lat * METRES_PER_DEGREE


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def walk_seconds(metres: Column, speed: float) -> Column:
    """Whole seconds, cut off."""
    return F.floor(metres / F.lit(float(speed))).cast("int")


def route_description(short_name: Column, direction: Column, trip_id: Column) -> Column:
    return F.when(short_name.isNotNull() & direction.isNotNull(), F.concat(short_name, F.lit(" "), direction)).otherwise(trip_id)


def walk_description(origin: Column, destination: Column) -> Column:
    return F.concat(F.lit("Walk from "), origin, F.lit(" to "), destination)


def duration(dep: Column, arr: Column) -> Column:
    return arr - dep


def stop_label(name: Column, stop_id: Column) -> Column:
    """name (id), or the id alone."""
    return F.when(name.isNotNull(), F.concat(name, F.lit(" ("), stop_id, F.lit(")"))).otherwise(stop_id)


def partition_label(name: Column, partition: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("unnamed("), partition.cast("string"), F.lit(")")))


def time_bucket(seconds: Column, width: int = 120, low: int = -32_768, high: int = 32_767) -> Column:
    """The bucket of a departure, checked to fit 16 bits."""
    bucket = F.floor(seconds / width).cast("int")
    return F.when(bucket.between(low, high), bucket.cast("short")).otherwise(F.raise_error(F.lit("time outside the range of buckets")).cast("short"))


def is_slug(text: Column) -> Column:
    return text.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$")


def is_date_id(text: Column) -> Column:
    return text.rlike(r"^[0-9]{8}$")


def composite_id(*parts: Column) -> Column:
    return F.concat_ws("-", *parts)


def undirected(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def step_label(o: Column, d: Column, dep: Column, arr: Column, trip_id: Column, is_flex: Column) -> Column:
    """o -> d dep-arr (trip), or o -> d walk of n s."""
    return F.when(is_flex, F.concat(o, F.lit(" -> "), d, F.lit(" walk "), (arr - dep).cast("string"), F.lit("s"))).otherwise(
        F.concat(o, F.lit(" -> "), d, F.lit(" "), format_signed_time(dep), F.lit("-"), format_signed_time(arr), F.lit(" ("), trip_id, F.lit(")"))
    )


def merged_step(is_flex1: Column, dep1: Column, arr1: Column, is_flex2: Column, dep2: Column, arr2: Column) -> tuple[Column, Column, Column]:
    """(is_flex, dep, arr) of a step followed by another one.

    Two walks add up from 0; a walk before a ride leaves earlier by its length; a
    walk after a ride arrives later by its length.
    """
    both = is_flex1 & is_flex2
    dep = F.when(both, F.lit(0)).when(is_flex1, dep2 - (arr1 - dep1)).otherwise(dep1)
    arr = F.when(both, (arr1 - dep1) + (arr2 - dep2)).when(is_flex2, arr1 + (arr2 - dep2)).otherwise(arr2)
    return both, dep, arr
