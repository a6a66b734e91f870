"""Tables of specifications, runs and solutions: dates, statuses, grids, differences, synchronisation and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import columns as C

STATUSES = ["solved", "infeasible", "timeout", "duplicate", "failed"]


def spec_dates(specs: DataFrame, default_start: str, days: int) -> DataFrame:
    """(spec_id, service_date): consecutive dates from a spec's start_service_date, or from the given day."""
    start = F.coalesce(F.col("start_service_date"), F.lit(default_start))
    return specs.select("spec_id", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("n"), start.alias("_s")).select("spec_id", C.offset_date(F.col("_s"), F.col("n")).alias("service_date"))


def outcome(exit_code, duplicate_of, duration):
    """The status of an instance."""
    return F.when(duplicate_of.isNotNull(), "duplicate").when(exit_code == 124, "timeout").when(exit_code != 0, "failed").when(duration.isNull(), "infeasible").otherwise("solved")


def with_copied_results(instances: DataFrame) -> DataFrame:
    """Duplicates take the duration of the date that they repeat: instances (spec_id, service_date, duplicate_of, duration)."""
    source = instances.select("spec_id", F.col("service_date").alias("duplicate_of"), F.col("duration").alias("_copied"))
    joined = instances.join(source, ["spec_id", "duplicate_of"], "left")
    return joined.withColumn("duration", F.coalesce("duration", "_copied")).select(*instances.columns)


def listing(instances: DataFrame, specs: DataFrame, targets: DataFrame) -> DataFrame:
    """Instances with their spec and target set, by spec and date."""
    return instances.join(specs, "spec_id").join(targets, "target_id").orderBy("spec_id", "service_date")


def grid(instances: DataFrame, spec_ids: list) -> DataFrame:
    """Dates down, specs across: the shortest duration of each; duplicates are left out."""
    shown = instances.filter(F.col("status") != "duplicate")
    return shown.groupBy("service_date").pivot("spec_id", spec_ids).agg(F.min("duration"))


def newest_runs(runs: DataFrame, keep: int = 5) -> DataFrame:
    """The newest runs of each source: runs (source_id, run_id, fetched_at)."""
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("fetched_at"), F.desc("run_id")))
    return runs.withColumn("_r", rank).filter(F.col("_r") <= keep).drop("_r")


def neighbours(runs: DataFrame) -> DataFrame:
    """Runs with the older, newer and newest run of their source."""
    by = Window.partitionBy("source_id").orderBy("fetched_at", "run_id")
    newest = F.last("run_id").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return runs.select("*", F.lag("run_id").over(by).alias("older"), F.lead("run_id").over(by).alias("newer"), newest.alias("newest"))


def landing_cell(instances: DataFrame, spec_id, service_date) -> DataFrame:
    """The cell to open: the one asked for, else one of that date, else the first."""
    rank = F.when((F.col("spec_id") == spec_id) & (F.col("service_date") == service_date), 0).when(F.col("service_date") == service_date, 1).otherwise(2)
    return instances.withColumn("_p", rank).orderBy("_p", "service_date", "spec_id").limit(1).drop("_p")


def sync_actions(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, action, changed): what makes stored equal wanted, and which columns differ."""
    columns = [c for c in wanted.columns if c != key]
    a = wanted.select(key, F.struct(*columns).alias("_w"))
    b = stored.select(key, F.struct(*columns).alias("_s"))
    both = a.join(b, key, "full")
    changed = F.filter(F.array(*[F.when(~F.col(f"_w.{c}").eqNullSafe(F.col(f"_s.{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    action = F.when(F.col("_s").isNull(), "inserted").when(F.col("_w").isNull(), "deleted").when(F.size(changed) > 0, "updated").otherwise("unchanged")
    return both.select(key, action.alias("action"), F.when(action == "updated", F.array_join(changed, ",")).otherwise("").alias("changed"))


def action_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def dangling(specs: DataFrame, targets: DataFrame) -> DataFrame:
    """Specs whose target set is missing."""
    return specs.join(targets.select("target_id"), "target_id", "left_anti")


def path_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(o, d, status, only_a, only_b) of two path sets (o, d, dep, arr): pairs in one, equal or different, by end times."""
    key = ["o", "d", "dep", "arr"]
    n = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    both = n(a, "na").join(n(b, "nb"), key, "full").na.fill(0, ["na", "nb"])
    pairs = both.groupBy("o", "d").agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"), F.sum(F.greatest(F.col("na") - F.col("nb"), F.lit(0))).alias("only_a"), F.sum(F.greatest(F.col("nb") - F.col("na"), F.lit(0))).alias("only_b"))
    status = F.when(F.col("tb") == 0, "only in a").when(F.col("ta") == 0, "only in b").when((F.col("only_a") == 0) & (F.col("only_b") == 0), "match").otherwise("mismatch")
    return pairs.select("o", "d", status.alias("status"), "only_a", "only_b")


def first_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(o, d, dep): for pairs whose paths (o, d, dep, arr) differ in two sets, the first departure at which they do."""
    key = ["o", "d", "dep", "arr"]
    n = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    return n(a, "na").join(n(b, "nb"), key, "full").filter(~F.col("na").eqNullSafe(F.col("nb"))).groupBy("o", "d").agg(F.min("dep").alias("dep"))


def specs_of_source(specs: DataFrame, targets: DataFrame, source: str) -> DataFrame:
    """Specs (spec_id, target_id) whose target set (target_id, source, ...) comes from a source."""
    return specs.join(targets.filter(F.col("source") == source), "target_id")


def prepared(specs: DataFrame, active: DataFrame, trips: DataFrame) -> DataFrame:
    """(spec_id, date, trips): how many trips each spec (spec_id, prefix) has on each date: active (date, service_id).

    Trips are counted by service and prefix first, so that their number doesn't grow by specs and dates.
    """
    counted = trips.groupBy("service_id", F.substring_index("trip_id", ":", 1).alias("prefix")).agg(F.count("*").alias("n"))
    found = counted.join(active, "service_id").groupBy("prefix", "date").agg(F.sum("n").alias("trips"))
    return specs.join(found, "prefix").select("spec_id", "date", "trips")


def copied_from(instances: DataFrame, source: DataFrame) -> DataFrame:
    """instances (spec_id, dup, duration, ...): duplicates take the duration of their spec's solved day: source (spec_id, duration)."""
    have = source.select("spec_id", F.col("duration").alias("_copied"))
    return instances.join(have, "spec_id", "left").withColumn("duration", F.when(F.col("dup"), F.col("_copied")).otherwise(F.col("duration"))).select(*instances.columns)


def with_cascade(actions: DataFrame, owned: DataFrame, key: str) -> DataFrame:
    """actions with instances: how many rows of owned (key) go stale because what they belong to changes or goes."""
    n = owned.groupBy(key).agg(F.count("*").alias("_n"))
    stale = F.when(F.col("action").isin("updated", "deleted"), F.coalesce("_n", F.lit(0))).otherwise(0).cast("long")
    return actions.join(n, key, "left").select(*actions.columns, stale.alias("instances"))


CATALOGUE = ["sources", "targets", "specs", "instances", "runs"]


def save_catalogue(tables: dict[str, DataFrame], folder: str, mode: str = "append") -> None:
    """Write the five tables of a catalogue; rows are added to what is there unless mode says otherwise."""
    for name in CATALOGUE:
        tables[name].write.mode(mode).parquet(f"{folder}/{name}")


def load_catalogue(spark, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in CATALOGUE}


def append_partial(solutions: DataFrame, folder: str) -> None:
    """Add partial solutions (run_id, iteration, ...) to a table laid out by iteration."""
    solutions.write.mode("append").partitionBy("iteration").parquet(folder)


def loaded_reductions(spark, a: str, b: str) -> DataFrame:
    """(o, d, a, b): how many paths two saved reductions (o, d, ...) have for each pair."""
    both = spark.read.parquet(a).select("o", "d", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(spark.read.parquet(b).select("o", "d", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy("o", "d").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def span_positions(spans: DataFrame) -> DataFrame:
    """Spans (run_id, start, duration) with left and width as percent of their run's whole length."""
    by = Window.partitionBy("run_id")
    first, last = F.min("start").over(by), F.max(F.col("start") + F.col("duration")).over(by)
    whole = F.greatest(last - first, F.lit(1e-9))
    return spans.select("*", ((F.col("start") - first) * 100 / whole).alias("left"), (F.col("duration") * 100 / whole).alias("width"))


def shifted_spans(spans: DataFrame, parents: DataFrame) -> DataFrame:
    """Spans moved by the start of their run's parent span: parents (run_id, parent_start)."""
    return spans.join(parents, "run_id").withColumn("start", F.col("start") + F.col("parent_start")).drop("parent_start")


def flattened_trace(documents: DataFrame, depth: int = 64) -> DataFrame:
    """(run_id, path, depth, name, start, duration) of nested spans {name, start, duration, children} in a JSON text.

    Level by level, until no span has children; more than depth levels raise. path orders them depth first.
    """
    kind = "struct<name:string,start:double,duration:double,children:string>"
    now = documents.select("run_id", F.lit("").alias("path"), F.from_json("document", kind).alias("s"))
    rows = None
    for level in range(depth):
        here = now.select("run_id", "path", F.lit(level).alias("depth"), "s.name", "s.start", "s.duration")
        rows = here if rows is None else rows.unionByName(here)
        if now.filter("s.children is not null").isEmpty():
            return rows
        inner = now.filter("s.children is not null").select("run_id", "path", F.posexplode(F.from_json("s.children", f"array<{kind}>")).alias("i", "s"))
        now = inner.select("run_id", F.concat("path", F.lit("/"), F.lpad(F.col("i").cast("string"), 4, "0")).alias("path"), "s")
    raise RuntimeError(f"spans are nested deeper than {depth} levels")
