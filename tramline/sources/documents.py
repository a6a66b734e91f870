"""Configurations and documents as rows: TOML texts, JSON with fields that pass through, networks and traces as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORLD = "name string, input_dir string, date string, prefixes array<string>"


def parsed_toml(texts: DataFrame) -> DataFrame:
    """(name, fields, problem): the top-level entries of TOML texts (name, text) as texts; lists as JSON."""
    schema = "name string, fields map<string,string>, problem string"

    def parse(batches):
        import json
        import tomllib

        for pdf in batches:
            rows = []
            for name, text in zip(pdf["name"], pdf["text"], strict=True):
                try:
                    found = {k: v if isinstance(v, str) else json.dumps(v) for k, v in tomllib.loads(text or "").items()}
                    rows.append((name, found, None))
                except tomllib.TOMLDecodeError as e:
                    rows.append((name, {}, str(e)))
            yield type(pdf)(rows, columns=["name", "fields", "problem"])

    return texts.select("name", "text").mapInPandas(parse, schema)


def worlds(texts: DataFrame, folder: str) -> DataFrame:
    """World configurations (name, text) as (name, input_dir, date, prefixes); a relative folder is taken from where the text lies."""
    f = parsed_toml(texts).filter("problem is null")
    at = F.col("fields")["input_dir"]
    full = F.when(at.startswith("/") | at.contains("://"), at).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), at))
    return f.select("name", full.alias("input_dir"), F.col("fields")["date"].alias("date"), F.coalesce(F.from_json(F.col("fields")["prefixes"], "array<string>"), F.array().cast("array<string>")).alias("prefixes"))


def required_stops(texts: DataFrame) -> DataFrame:
    """(name, stop_id, rep): required stops of configurations with stop_ids and stop_groups; the first of a group stands for it."""
    f = parsed_toml(texts).filter("problem is null")
    ids, groups = F.from_json(F.col("fields")["stop_ids"], "array<string>"), F.from_json(F.col("fields")["stop_groups"], "array<array<string>>")
    listed = f.select("name", F.explode(ids).alias("stop_id"))
    grouped = f.select("name", F.explode(groups).alias("g")).select("name", F.explode("g").alias("stop_id"), F.col("g")[0].alias("rep"))
    return listed.join(grouped, ["name", "stop_id"], "left").select("name", "stop_id", F.coalesce("rep", "stop_id").alias("rep"))


def config_rows(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Each text of a directory as a row: name (of its folder or file), the named columns, and the rest as JSON in `data`."""
    texts = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.regexp_extract(F.input_file_name(), r"/config=([^/]+)/", 1).alias("name"), F.col("value").alias("text"))
    return rows_of_configs(texts, columns)


def rows_of_configs(texts: DataFrame, columns: list[str]) -> DataFrame:
    """config_rows() of texts (name, text), many of which lie in one file: a file a text costs more than its row does."""
    f = parsed_toml(texts).filter("problem is null")
    rest = F.map_filter("fields", lambda k, v: ~k.isin(columns))
    return f.select("name", *[F.col("fields")[c].alias(c) for c in columns], F.to_json(F.map_from_entries(F.array_sort(F.map_entries(rest)))).alias("data"))


def config_problems(configs: DataFrame, known: list[str], sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(name, problem) of configurations (name, fields): unknown keys, a source or target that doesn't exist, a date that is none."""
    f = configs.select("name", "fields")
    key = f.select("name", F.explode(F.map_keys("fields")).alias("k")).filter(~F.col("k").isin(known)).select("name", F.concat(F.lit("unknown key "), "k").alias("problem"))
    source = f.select("name", F.col("fields")["source"].alias("source_id")).filter("source_id is not null").join(sources.select("source_id").distinct(), "source_id", "left_anti").select("name", F.concat(F.lit("unknown source "), "source_id").alias("problem"))
    target = f.select("name", F.col("fields")["target"].alias("target_id")).filter("target_id is not null").join(targets.select("target_id").distinct(), "target_id", "left_anti").select("name", F.concat(F.lit("unknown target "), "target_id").alias("problem"))
    date = f.select("name", F.col("fields")["date"].alias("date")).filter(~F.col("date").rlike(r"^[0-9]{8}$")).select("name", F.concat(F.lit("not a date "), "date").alias("problem"))
    return key.unionByName(source).unionByName(target).unionByName(date)


def with_rest(documents: DataFrame, known: str) -> DataFrame:
    """JSON texts (id, document) with their known fields as columns; the text itself passes through unchanged."""
    return documents.select("id", F.from_json("document", known).alias("f"), "document").select("id", "f.*", "document")


def named_and_rest(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """rows (id, map) with the named entries as columns and the rest as JSON in `data`, keys sorted."""
    rest = F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(column, lambda k, v: ~k.isin(names)))))
    return rows.select("id", *[F.col(column)[n].alias(n) for n in names], F.to_json(rest).alias("data"))


def pairs_of_map(rows: DataFrame, column: str) -> DataFrame:
    """rows with a map as a JSON array of {key, value}, whose keys need not be texts."""
    return rows.withColumn(column, F.to_json(F.map_entries(column)))


def map_of_pairs(rows: DataFrame, column: str, kind: str = "array<struct<key:string,value:int>>") -> DataFrame:
    return rows.withColumn(column, F.map_from_entries(F.from_json(column, kind)))


def network_documents(steps: DataFrame) -> DataFrame:
    """(stop, document): the steps that leave each stop, as a JSON array in order."""
    rows = F.array_sort(F.collect_list(F.struct("d", "dep", "arr", "trip_id", "is_flex")))
    return steps.groupBy(F.col("o").alias("stop")).agg(F.to_json(rows).alias("document"))


def network_of_documents(documents: DataFrame) -> DataFrame:
    kind = "array<struct<d:string,dep:int,arr:int,trip_id:string,is_flex:boolean>>"
    return documents.select(F.col("stop").alias("o"), F.explode(F.from_json("document", kind)).alias("x")).select("o", "x.*")


def tagged_steps(steps: DataFrame) -> DataFrame:
    """(trip_id, document): steps as tagged objects, a ride with times or a walk with its length."""
    ride = F.to_json(F.struct(F.lit("ride").alias("kind"), "o", "d", "dep", "arr"))
    walk = F.to_json(F.struct(F.lit("walk").alias("kind"), "o", "d", (F.col("arr") - F.col("dep")).alias("seconds")))
    return steps.select("trip_id", F.when(F.col("is_flex"), walk).otherwise(ride).alias("document"))


def span_tree(spans: DataFrame, depth: int) -> DataFrame:
    """(run_id, document): the spans (run_id, span_id, parent_id, depth, name, start, duration) of each run as one nested JSON text.

    Levels are nested from the deepest up, at most depth of them; children stand in the order of their start and id.
    """
    own = F.to_json(F.struct("name", "start", "duration"))
    below = None
    for level in range(depth - 1, -1, -1):
        here = spans.filter(F.col("depth") == level).select("run_id", "span_id", "parent_id", "start", own.alias("own"))
        if below is None:
            whole = here.withColumn("document", F.col("own"))
        else:
            joined = here.join(below, ["run_id", "span_id"], "left")
            inner = F.concat(F.expr("substr(own, 1, length(own) - 1)"), F.lit(',"children":['), F.array_join(F.transform("children", lambda x: x["document"]), ","), F.lit("]}"))
            whole = joined.withColumn("document", F.when(F.col("children").isNull(), F.col("own")).otherwise(inner))
        below = whole.groupBy("run_id", F.col("parent_id").alias("span_id")).agg(F.array_sort(F.collect_list(F.struct("start", F.col("span_id").alias("k"), "document"))).alias("children"))
    return whole.select("run_id", "document")


def gaps_in_days(documents: DataFrame) -> DataFrame:
    """(id, keys): documents (id, document) whose service days aren't sd-0, sd-1, ... without a gap."""
    m = F.map_keys(F.from_json("document", "map<string,array<string>>"))
    want = F.when(F.size(m) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.concat(F.lit("sd-"), i.cast("string"))))
    return documents.select("id", F.array_sort(m).alias("keys"), F.array_sort(want).alias("want")).filter("keys <> want").select("id", F.array_join("keys", ",").alias("keys"))
