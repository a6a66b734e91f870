"""The networks of many specs and dates, prepared in one job.

specs: (spec_id, prefixes array<string>, later int, max_walk double, speed double, until int): the trips
whose ids begin with one of the prefixes (all, if there is none), over the date and so many
later days; departures count from 00:00 of the date to until, in seconds.
required: (spec_id, stop_id). Every frame carries (spec_id, date), so trips, steps,
walks, closure and reduction of all networks run in the same joins and rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import columns as C
from tramline.operators import profiles, services, steps
from tramline.operators.feed import ROOTS, root_stops
from tramline.operators.lineage import cut, small, written
from tramline.sources.gtfs import GtfsFeed

NET = ["spec_id", "date"]


def trips_of_specs(specs: DataFrame, trips: DataFrame) -> DataFrame:
    """(spec_id, trip_id, service_id): the trips of each spec. Only the distinct prefixes, which are counted, are held against every trip."""
    wanted = cut(specs.select("spec_id", F.explode(F.when(F.size("prefixes") == 0, F.array(F.lit(""))).otherwise(F.col("prefixes"))).alias("prefix")).distinct())
    named = trips.select("trip_id", "service_id").join(small(wanted.select("prefix").distinct()), F.col("trip_id").startswith(F.col("prefix")))
    return named.join(small(wanted), "prefix").select("spec_id", "trip_id", "service_id").distinct()


def spec_days(specs: DataFrame, dates: DataFrame) -> DataFrame:
    """(spec_id, date, day, at): each service day of the span of each spec and date (date)."""
    spans = specs.select("spec_id", "later", F.explode(F.sequence(F.lit(0), "later")).alias("day"))
    return spans.crossJoin(small(dates.select("date").distinct())).select("spec_id", "date", "day", "later", C.offset_date(F.col("date"), F.col("day")).alias("at"))


def patterns(specs: DataFrame, dates: DataFrame, feed: GtfsFeed) -> DataFrame:
    """(spec_id, date, pattern, duplicate_of): which of the spec's services run on each day of the span.

    Of dates of a spec with one pattern all but the first are duplicates: their network is the first one's.
    """
    own = cut(trips_of_specs(specs, feed.trips).select("spec_id", "service_id").distinct())
    days = cut(spec_days(specs, dates))
    active = services.active_on(feed.calendar, days.select(F.col("at").alias("date")))
    running = days.join(active.withColumnRenamed("date", "at").hint("merge"), "at").join(own.hint("merge"), ["spec_id", "service_id"], "left_semi")
    running = running.groupBy("spec_id", "date", "day").agg(F.array_sort(F.collect_set("service_id")).alias("services"))
    every = days.join(running.hint("merge"), ["spec_id", "date", "day"], "left").select("spec_id", "date", "day", F.coalesce("services", F.array().cast("array<string>")).alias("services"))
    rows = every.groupBy("spec_id", "date").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "services"))), lambda r: r["services"]).alias("pattern"))
    return services.duplicates(rows, ("spec_id",))


def keyed_steps(found: DataFrame, specs: DataFrame, feed: GtfsFeed) -> DataFrame:
    """(spec_id, date, o, d, dep, arr, trip_id, is_flex): rides and walks of the networks (spec_id, date, pattern).

    Steps are made once a trip and covered once a spec and service: what another step of the same service replaces,
    it replaces on every day that the service runs. Only the rest is dealt to the networks and days, moved by 24 hours a
    day; on the last of later days what arrives from 24:00 on is cut. Walks join the stations that a
    network's trips serve, as far as the spec's max_walk allows.
    """
    roots = cut(root_stops(feed.stops))
    by = Window.partitionBy("trip_id").orderBy("stop_sequence")
    times = feed.stop_times.join(small(roots, ROOTS), "stop_id", "left").withColumn("o", F.coalesce("root_id", "stop_id"))
    times = times.select("trip_id", "o", F.lead("o").over(by).alias("d"), F.col("departure").alias("dep"), F.lead("arrival").over(by).alias("arr"), F.col("arrival").alias("here"))
    times = written(times.join(trips_of_specs(specs, feed.trips).hint("merge"), "trip_id"), "steps")
    runs = found.select(*NET, F.posexplode("pattern").alias("day", "services")).select(*NET, "day", F.explode("services").alias("service_id"))
    last = specs.select("spec_id", F.when(F.col("later") > 0, F.col("later")).alias("last"))
    runs, service = small(cut(runs.join(small(last), "spec_id"))), ["spec_id", "service_id"]
    kept = F.coalesce(F.col("day") != F.col("last"), F.lit(True)) | (F.col("arr") < C.DAY)
    moved = F.col("day") * C.DAY
    # Of equal rides the last by its name with the service day stays, as in the covers of the networks.
    rides = times.filter("d is not null").select(*service, "o", "d", "dep", "arr", "trip_id", F.lit(False).alias("is_flex"), C.with_service_day(F.col("trip_id"), 0).alias("_named"))
    rides = cut(steps.minimal_cover(rides, (*service, "o", "d"), ("_named",)).drop("_named")).join(runs, service).filter(kept)
    rides = rides.select(*NET, "o", "d", (F.col("dep") + moved).alias("dep"), (F.col("arr") + moved).alias("arr"), C.with_service_day(F.col("trip_id"), F.col("day")).alias("trip_id"), "is_flex")
    served = times.groupBy(*service, F.col("o").alias("stop_id")).agg(F.min("here").alias("arr")).join(runs, service).filter(kept).select(*NET, "stop_id").distinct()
    return rides.unionByName(keyed_walks(cut(served), specs, feed.stops.join(roots.filter("stop_id = root_id").hint("merge"), "stop_id", "left_semi")))


def keyed_walks(served: DataFrame, specs: DataFrame, stations: DataFrame) -> DataFrame:
    """Walks of each network between the stations it serves (spec_id, date, stop_id): pairs within the longest limit, found once for all."""
    longest = specs.agg(F.max("max_walk")).first()[0] or 0.0
    pairs = steps.near_pairs(steps.positions(stations), max(longest, 1e-9))
    limits = small(specs.select("spec_id", "max_walk", "speed").filter("speed > 0"))
    pairs = cut(pairs.join(limits, F.col("metres") <= F.col("max_walk")).select("spec_id", "o", "d", F.floor(F.col("metres") / F.col("speed")).cast("int").alias("arr")))
    end = lambda name: served.withColumnRenamed("stop_id", name).hint("merge")
    walks = pairs.join(end("o"), ["spec_id", "o"]).join(end("d"), [*NET, "d"], "left_semi")
    return walks.select(*NET, "o", "d", F.lit(0).alias("dep"), "arr", F.concat(F.lit("walk:"), "o", F.lit(":"), "d").alias("trip_id"), F.lit(True).alias("is_flex"))


def solved(specs: DataFrame, required: DataFrame, dates: DataFrame, feed: GtfsFeed, complete: bool = False, hours: int = 6) -> tuple[DataFrame, DataFrame]:
    """(instances, networks): instances (spec_id, date, pattern, duplicate_of), and the reduced networks of those that are no duplicates."""
    specs = cut(specs)
    instances = cut(patterns(specs, dates, feed))
    own = instances.filter("duplicate_of is null")
    ends, keys = small(specs.select("spec_id", "until")), (*NET, "until")
    stops = own.select(*NET).join(small(cut(required.select("spec_id", "stop_id").distinct())), "spec_id").join(ends, "spec_id")
    every = cut(keyed_steps(own, specs, feed).join(ends, "spec_id"))
    return instances, profiles.reduced(every, cut(stops), "until", complete, keys=keys, width=hours * 3600).drop("until")


def prepared_networks(specs: DataFrame, required: DataFrame, dates: DataFrame, feed: GtfsFeed, complete: bool = False) -> DataFrame:
    """(spec_id, date, duplicate_of, o, d, dep, arr, is_flex, legs): the reduced network of each spec and date; duplicates have that of the date they repeat."""
    instances, networks = solved(specs, required, dates, feed, complete)
    to = cut(instances.select("spec_id", F.col("date").alias("for"), F.coalesce("duplicate_of", "date").alias("date"), "duplicate_of"))
    return networks.join(small(to), NET).select("spec_id", F.col("for").alias("date"), "duplicate_of", "o", "d", "dep", "arr", "is_flex", "legs")
