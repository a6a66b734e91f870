"""Filters, combination and reports of feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import columns as C
from tramline.operators import steps
from tramline.operators.lineage import cut, small, written
from tramline.sources.gtfs import WEEKDAYS, GtfsFeed

KEYS = {"stops": ["stop_id"], "trips": ["trip_id"], "stop_times": ["trip_id", "stop_sequence"], "routes": ["route_id"], "directions": ["route_id", "direction_id"]}


def active_services(calendar: DataFrame, date: str) -> DataFrame:
    """(service_id) of services that run on a YYYYMMDD date."""
    if len(date) != 8 or not date.isdigit():
        raise ValueError(f"not a date: {date}")
    days = F.array(*[F.col(d) for d in (WEEKDAYS[6], *WEEKDAYS[:6])])
    runs = F.element_at(days, C.day_of_week(F.lit(date)) + 1)
    return calendar.filter((F.col("start_date") <= date) & (F.col("end_date") >= date) & runs).select("service_id").distinct()


def prune(feed: GtfsFeed) -> GtfsFeed:
    """Drop trips without stop times, then routes and directions without trips."""
    trips = feed.trips.join(feed.stop_times.select("trip_id").hint("merge"), "trip_id", "left_semi")
    return feed.with_(trips=trips, **_of_trips(feed, trips))


def _of_trips(feed: GtfsFeed, trips: DataFrame) -> dict[str, DataFrame]:
    return {"routes": feed.routes.join(trips, "route_id", "left_semi"), "directions": feed.directions.join(trips, ["route_id", "direction_id"], "left_semi")}


def on_date(feed: GtfsFeed, date: str, prefixes: list[str] = ()) -> GtfsFeed:
    """The day of a date: trips of its services, what they use, and all stops. prefixes: only trips whose id starts with one of them."""
    trips, times = feed.trips, feed.stop_times
    if prefixes:
        trips, times = [x.filter(starts_with_any(F.col("trip_id"), prefixes)) for x in (trips, times)]
    trips = trips.join(active_services(feed.calendar, date), "service_id", "left_semi").select(*feed.trips.columns)
    times = times.join(trips, "trip_id", "left_semi")
    return feed.with_(trips=trips, calendar=None, stop_times=times, **_of_trips(feed, trips))


def with_trips(feed: GtfsFeed, trips: DataFrame) -> GtfsFeed:
    """Only the given trips (trip_id), what they use, and the stops they serve with all their ancestors."""
    return _with_kept(feed, feed.trips.join(trips.select("trip_id"), "trip_id", "left_semi"))


def _with_kept(feed: GtfsFeed, kept: DataFrame) -> GtfsFeed:
    """with_trips() for rows of the feed's own trips."""
    times = feed.stop_times.join(kept, "trip_id", "left_semi")
    stops = feed.stops.join(ancestors(feed.stops, times.select("stop_id")), "stop_id", "left_semi")
    calendar = None if feed.calendar is None else feed.calendar.join(kept, "service_id", "left_semi")
    return feed.with_(trips=kept, stop_times=times, stops=stops, calendar=calendar, **_of_trips(feed, kept))


def by_prefixes(feed: GtfsFeed, prefixes: list[str]) -> GtfsFeed:
    """Trips whose id starts with any of the prefixes; all trips if there is none."""
    if not prefixes:
        return feed
    named = starts_with_any(F.col("trip_id"), prefixes)
    # Stop times of other trips go before they are parsed and joined.
    return _with_kept(feed.with_(stop_times=feed.stop_times.filter(named)), feed.trips.filter(named))


def starts_with_any(text, prefixes: list[str]):
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes], F.lit(False))


def by_routes(day: GtfsFeed, include: list[str] | None = None, exclude: list[str] | None = None) -> GtfsFeed:
    """Only the routes included, without those excluded, pruned."""
    trips = day.trips
    if include:
        trips = trips.filter(F.col("route_id").isin(include))
    if exclude:
        trips = trips.filter(~F.col("route_id").isin(exclude))
    return prune(with_trips(day, trips))


def stops_served(feed: GtfsFeed, prefix: str) -> DataFrame:
    """(stop_id) of stops at which trips with a prefix stop."""
    return feed.stop_times.filter(F.col("trip_id").startswith(prefix)).select("stop_id").distinct()


def root_stops(stops: DataFrame) -> DataFrame:
    """(stop_id, root_id): the ultimate parent. A stop on a cycle, or above which one lies, is its own root; an unknown parent is the root.

    Parents are few levels up, so their ids are carried along level by level; stations
    form short chains, and rounds stop when nothing moves.
    """
    up = stops.select(F.col("stop_id").alias("child"), F.col("parent_station").alias("parent"))
    at = stops.select("stop_id", F.col("stop_id").alias("at"), F.array("stop_id").alias("seen"), F.lit(False).alias("cycle"))
    while True:
        joined = at.join(up, at["at"] == up["child"], "left")
        moves = F.col("parent").isNotNull() & ~F.col("cycle")
        loop = F.array_contains("seen", F.col("parent"))
        at = cut(joined.select(
            "stop_id", F.when(moves & ~loop, F.col("parent")).otherwise(F.col("at")).alias("at"), F.when(moves & ~loop, F.concat("seen", F.array("parent"))).otherwise(F.col("seen")).alias("seen"),
            (F.col("cycle") | F.coalesce(moves & loop, F.lit(False))).alias("cycle"), F.coalesce(moves & ~loop, F.lit(False)).alias("moved"),
        ))
        if at.filter("moved").isEmpty():
            return at.select("stop_id", F.when(F.col("cycle"), F.col("stop_id")).otherwise(F.col("at")).alias("root_id"))
        at = at.drop("moved")


def ancestors(stops: DataFrame, used: DataFrame) -> DataFrame:
    """(stop_id): the used stops and all their ancestors. Levels are gone up over the stops alone, so used is read once, by what asks for the result."""
    up = stops.filter("parent_station is not null").select("stop_id", F.col("parent_station").alias("above")).distinct()
    found = cut(up)
    front = found
    parents = up.select(F.col("stop_id").alias("above"), F.col("above").alias("next"))
    while not front.isEmpty():
        higher = front.join(parents.hint("merge"), "above").select("stop_id", F.col("next").alias("above")).distinct()
        front = cut(higher.join(found.hint("merge"), ["stop_id", "above"], "left_anti"))
        found = found.unionByName(front)
    used = used.select("stop_id").distinct()
    return used.join(found.hint("merge"), "stop_id", "left").select(F.explode(F.array("stop_id", F.coalesce("above", "stop_id"))).alias("stop_id")).distinct()


#: Stops with their roots that are sent to all tasks at most; a row has about 60 bytes.
ROOTS = 500_000


def normalized(day: GtfsFeed, roots: DataFrame | None = None) -> GtfsFeed:
    """Stop times moved to the ultimate parents; stops that have a parent are removed. roots: root_stops() of these or more stops, if at hand."""
    roots = root_stops(day.stops) if roots is None else roots
    times = day.stop_times.join(small(roots, ROOTS), "stop_id", "left").withColumn("stop_id", F.coalesce("root_id", "stop_id")).select(*day.stop_times.columns)
    stops = day.stops.join(roots.filter("stop_id = root_id"), "stop_id", "left_semi")
    return day.with_(stops=stops.withColumn("parent_station", F.lit(None).cast("string")), stop_times=times)


def network(day: GtfsFeed) -> tuple[DataFrame, DataFrame]:
    """(rides, walks) between the root stops that a day serves. Its stop times are gone through once, and written with the stops they lead to."""
    roots = root_stops(day.stops)
    by = Window.partitionBy("trip_id").orderBy("stop_sequence")
    times = day.stop_times.join(small(roots, ROOTS), "stop_id", "left").withColumn("o", F.coalesce("root_id", "stop_id"))
    rows = written(times.select("stop_id", "o", F.lead("o").over(by).alias("d"), F.col("departure").alias("dep"), F.lead("arrival").over(by).alias("arr"), "trip_id", F.lit(False).alias("is_flex")), "steps")
    served = day.stops.join(ancestors(day.stops, rows), "stop_id", "left_semi").join(roots.filter("stop_id = root_id"), "stop_id", "left_semi")
    return rows.filter("d is not null").drop("stop_id"), steps.walking(served)


def unknown_stop_times(feed: GtfsFeed) -> DataFrame:
    """Stop times whose stop the feed does not have."""
    return feed.stop_times.join(feed.stops, "stop_id", "left_anti")


def combine(days: list[GtfsFeed]) -> GtfsFeed:
    """The union of days; of rows with one key the first day's stays."""
    tables = {}
    for name, keys in KEYS.items():
        all_days = reduce(DataFrame.unionByName, [getattr(d, name).withColumn("_day", F.lit(i)) for i, d in enumerate(days)])
        first = F.row_number().over(Window.partitionBy(*keys).orderBy("_day"))
        tables[name] = all_days.withColumn("_r", first).filter("_r = 1").drop("_r", "_day")
    return GtfsFeed(calendar=None, **tables)


def shifted(day: GtfsFeed, number: int) -> GtfsFeed:
    """A day as the number-th of a span: times later by whole days, trip ids with their service day."""
    name = lambda df: df.withColumn("trip_id", C.with_service_day(F.col("trip_id"), number))
    times = name(day.stop_times).withColumn("arrival", F.col("arrival") + number * C.DAY).withColumn("departure", F.col("departure") + number * C.DAY)
    return day.with_(trips=name(day.trips), stop_times=times)


def cut_last_day(day: GtfsFeed) -> GtfsFeed:
    """Without stop times at or after 24:00, then pruned."""
    return prune(day.with_(stop_times=day.stop_times.filter(F.col("arrival") < C.DAY)))


def service_days(feed: GtfsFeed, date: str, subsequent: int, keep: bool = False) -> GtfsFeed:
    """A date and the days after it as one span; the last of the later days ends at 24:00.

    Each trip is given the days it runs on and its stop times are dealt to them, so they are gone through once for all days.
    keep: what was dealt is written, for those who ask for stop times and for trips, which are the ones with stop times.
    """
    if subsequent < 0:
        raise ValueError("the number of later days is negative")
    dates = feed.stops.sparkSession.range(1).select(*[C.offset_date(F.lit(date), n).alias(str(n)) for n in range(subsequent + 1)]).first()
    runs = reduce(DataFrame.unionByName, [active_services(feed.calendar, at).withColumn("_day", F.lit(n)) for n, at in enumerate(dates)])
    runs = small(cut(runs.groupBy("service_id").agg(F.collect_set("_day").alias("_days"))))
    trips = feed.trips.join(runs, "service_id").select(*feed.trips.columns, "_days")
    last = (F.col("_day") == subsequent) if subsequent else F.lit(False)
    dealt = lambda df, columns: df.select(*columns, F.explode("_days").alias("_day"))
    one = lambda df, *keys: df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))).filter("_r = 1").drop("_r")
    times = dealt(feed.stop_times.join(trips.select("trip_id", "_days").hint("merge"), "trip_id"), feed.stop_times.columns)
    # Days are told apart by the names of their trips, so only rows of one day can have one key; they lie together by trip here.
    times = one(times.filter(~last | (F.col("arrival") < C.DAY)), "trip_id", "stop_sequence", "_day")
    times = written(times, "span") if keep else times
    trips = one(dealt(trips, feed.trips.columns), "trip_id", "_day")
    if subsequent:
        ended = times.filter(last).select("trip_id", "_day").hint("merge")
        trips = trips.filter(~last).unionByName(trips.filter(last).join(ended, ["trip_id", "_day"], "left_semi").select(*trips.columns))
    name, moved = C.with_service_day(F.col("trip_id"), F.col("_day")), F.col("_day") * C.DAY
    trips = trips.withColumn("trip_id", name).drop("_day")
    times = times.withColumn("trip_id", name).withColumn("arrival", F.col("arrival") + moved).withColumn("departure", F.col("departure") + moved).drop("_day")
    used = _of_trips(feed, trips)
    return feed.with_(stops=one(feed.stops, "stop_id"), trips=trips, calendar=None, stop_times=times, routes=one(used["routes"], "route_id"), directions=one(used["directions"], "route_id", "direction_id"))


def world(feed: GtfsFeed, date: str, prefixes: list[str] = (), subsequent: int = 0, keep: bool = False) -> GtfsFeed:
    """Prefix filter, then the span of days (service_days()), which keeps stop times of its trips alone and asks the calendar for services of trips alone."""
    found = by_prefixes(feed, list(prefixes))
    if prefixes:
        found = found.with_(stop_times=feed.stop_times.filter(starts_with_any(F.col("trip_id"), prefixes)), calendar=feed.calendar)
    return service_days(found, date, subsequent, keep)


def trip_descriptions(day: GtfsFeed) -> DataFrame:
    """(trip_id, description): short name and direction of a trip's route, or the trip's id."""
    return trip_routes(day).select("trip_id", C.route_description(F.col("route_short_name"), F.col("direction"), F.col("trip_id")).alias("description"))


def trip_routes(feed: GtfsFeed) -> DataFrame:
    """Each trip with its route and direction; null where the feed hasn't got them."""
    named = feed.trips.join(small(feed.routes.select("route_id", "route_short_name", "route_long_name")), "route_id", "left")
    return named.join(small(feed.directions), ["route_id", "direction_id"], "left")


def repeated(day: GtfsFeed, days: int) -> GtfsFeed:
    """A day run on so many days in a row: times later by 24 hours a day, trip ids with their service day."""
    later = lambda df: df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    name = lambda df: df.withColumn("trip_id", C.with_service_day(F.col("trip_id"), F.col("_k")))
    times = later(day.stop_times).withColumn("arrival", F.col("arrival") + F.col("_k") * C.DAY).withColumn("departure", F.col("departure") + F.col("_k") * C.DAY)
    return day.with_(trips=name(later(day.trips)).drop("_k"), stop_times=name(times).drop("_k"))


def day_problems(trips: DataFrame, days: int) -> DataFrame:
    """(trip_id, problem): trips without a service day in their id, or with one at or after the end of a span of so many days."""
    day = C.service_day(F.col("trip_id"), strict=False)
    problem = F.when(day.isNull(), "malformed").when(day >= days, "beyond the span")
    return trips.select("trip_id", problem.alias("problem")).filter("problem is not null")


def summary(feed: GtfsFeed) -> DataFrame:
    """(name, rows) of each table."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, t in feed.tables().items()])


def stop_routes(day: GtfsFeed) -> DataFrame:
    """(stop_id, stop_name, routes): the routes at a stop, with directions in brackets where it hasn't all of the route's."""
    at = day.stop_times.join(day.trips.select("trip_id", "route_id", "direction_id"), "trip_id").select("stop_id", "route_id", "direction_id").distinct()
    of_route = day.trips.groupBy("route_id").agg(F.countDistinct("direction_id").alias("of"))
    here = at.join(day.directions, ["route_id", "direction_id"], "left").groupBy("stop_id", "route_id").agg(F.countDistinct("direction_id").alias("n"), F.array_join(F.array_sort(F.collect_set("direction")), ", ").alias("names"))
    label = F.when(F.col("n") < F.col("of"), F.concat("route_short_name", F.lit(" ["), "names", F.lit("]"))).otherwise(F.col("route_short_name"))
    rows = here.join(of_route, "route_id").join(day.routes, "route_id").select("stop_id", label.alias("label"))
    joined = rows.groupBy("stop_id").agg(F.array_join(F.array_sort(F.collect_list("label")), "; ").alias("routes"))
    return joined.join(day.stops.select("stop_id", "stop_name"), "stop_id").select("stop_id", "stop_name", "routes")


def route_directions(feed: GtfsFeed) -> DataFrame:
    """(route_id, route_short_name, directions)."""
    found = feed.directions.groupBy("route_id").agg(F.array_join(F.array_sort(F.collect_list("direction")), ", ").alias("directions"))
    return feed.routes.join(found, "route_id", "left").select("route_id", "route_short_name", F.coalesce("directions", F.lit("")).alias("directions"))


def stops_by_name(stops: DataFrame) -> DataFrame:
    """(stop_name, stop_ids, n): ids of stops that share a name; a look-up by name must find n = 1."""
    return stops.groupBy("stop_name").agg(F.array_join(F.array_sort(F.collect_list("stop_id")), ",").alias("stop_ids"), F.count("*").alias("n"))


def dense_ids(df: DataFrame, key: str, name: str = "id") -> DataFrame:
    """(key, name): numbers from 1 in the order of the key.

    Keys are dealt by range; each range is numbered on its own and moved by the
    counts of those before it.
    """
    part = f"part of {key}"
    keys = cut(df.select(key).distinct().repartitionByRange(key).withColumn(part, F.spark_partition_id()))
    counts = keys.groupBy(part).agg(F.count("*").alias("n"))  # a row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(part), before.alias("rows before"))
    own = F.row_number().over(Window.partitionBy(part).orderBy(key))
    return keys.join(F.broadcast(offsets), part).select(key, (own + F.col("rows before")).cast("int").alias(name))
