"""Networks of many specs and dates, and profiles over windows, with their DuckDB texts unrolled by rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import feed as feeds
from tramline.operators import networks, profiles, services
from tramline.plans import demo
from tramline.plans.demo import sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Rounds of the unrolled closure: more than any path of the derived timetable has changes.
ROUNDS = 9


def query(name: str, text: str | None = None, *more: tuple[str, str]):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, demo.feed(spark, sf_dir))
        if text:
            ORACLE_SQL[name] = sql(text, *more)
        return f

    return add


#: (spec_id, prefixes, later days, walking limit in metres, metres a second, end of the departures in seconds) and required stations.
SPECS = [(0, ["BA:"], 0, 500.0, 1.0, 36 * 3600), (1, ["CT:"], 0, 400.0, 2.0, 36 * 3600), (2, ["SC:"], 1, 350.0, 1.0, 28 * 3600)]
REQUIRED = {0: ["N0", "N4", "N11", "N17", "N23"], 1: ["N1", "N5", "N12", "N20"], 2: ["N2", "N9", "N18"]}
FIRST, DAYS = "20250714", 7


def specs_of(spark):
    return spark.createDataFrame(SPECS, "spec_id int, prefixes array<string>, later int, max_walk double, speed double, until int")


def required_of(spark):
    return spark.createDataFrame([(k, s) for k, stops in REQUIRED.items() for s in stops], "spec_id int, stop_id string")


def rows(values) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in v) + ")" for v in values)


_RUNS = "CASE dow WHEN 0 THEN sunday WHEN 1 THEN monday WHEN 2 THEN tuesday WHEN 3 THEN wednesday WHEN 4 THEN thursday WHEN 5 THEN friday ELSE saturday END"
_NETS = [
    ("nspec", f"SELECT * FROM (VALUES {rows((k, p[0], n, w, v, u) for k, p, n, w, v, u in SPECS)}) v(spec_id, prefix, later, max_walk, speed, until)"),
    ("nreq", f"SELECT * FROM (VALUES {rows((k, s) for k, x in REQUIRED.items() for s in x)}) v(spec_id, stop_id)"),
    ("ndate", f"SELECT i, strftime(DATE '2025-07-14' + CAST(i AS INTEGER), '%Y%m%d') AS date, dayofweek(DATE '2025-07-14' + CAST(i AS INTEGER)) AS dow FROM range({DAYS + 1}) r(i)"),
    ("nrun", f"SELECT i, service_id FROM ndate JOIN g_calendar ON date BETWEEN start_date AND end_date AND {_RUNS}"),
    ("ntrip", "SELECT spec_id, trip_id, service_id FROM g_trips JOIN nspec ON starts_with(trip_id, prefix)"),
    ("nday", f"SELECT spec_id, d.i, d.date, later, t.k AS sday, d.i + t.k AS at_i FROM nspec, ndate d, range(2) t(k) WHERE d.i < {DAYS} AND t.k <= later"),
    ("nserv", "SELECT DISTINCT n.spec_id, n.i, n.date, sday, service_id FROM nday n LEFT JOIN (SELECT r.i, t.spec_id, r.service_id FROM nrun r JOIN (SELECT DISTINCT spec_id, service_id FROM ntrip) t USING (service_id)) r ON r.i = n.at_i AND r.spec_id = n.spec_id"),
    ("npat", "SELECT spec_id, i, date, string_agg(concat(CAST(sday AS STRING), coalesce(service_id, '')), ',' ORDER BY sday, service_id) AS pattern FROM nserv GROUP BY ALL"),
    ("ninst", "SELECT *, min(date) OVER (PARTITION BY spec_id, pattern) AS net_date FROM npat"),
    ("nnet_m", "SELECT DISTINCT n.spec_id, n.date, sday, later, service_id, concat(CAST(n.spec_id AS STRING), '/', n.date) AS k FROM nserv n JOIN ninst i ON i.spec_id = n.spec_id AND i.date = n.date AND i.net_date = n.date JOIN nspec s ON s.spec_id = n.spec_id WHERE service_id IS NOT NULL"),
    ("nst0", "SELECT trip_id, root_id AS stop_id, stop_sequence, arrival, departure FROM st JOIN roots USING (stop_id)"),
    ("nstep_m", "SELECT * FROM (SELECT trip_id, stop_id AS o, lead(stop_id) OVER w AS d, departure AS dep, lead(arrival) OVER w AS arr FROM nst0 WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)) WHERE d IS NOT NULL"),
    ("ndealt_m", "SELECT n.k, n.spec_id, n.sday, n.later, t.trip_id FROM nnet_m n JOIN ntrip t ON t.spec_id = n.spec_id AND t.service_id = n.service_id"),
    ("nride_m", "SELECT k, o, d, dep + sday * 86400 AS dep, arr + sday * 86400 AS arr FROM ndealt_m JOIN nstep_m USING (trip_id) WHERE o <> d AND (later = 0 OR sday < later OR arr < 86400)"),
    ("nserved_m", "SELECT DISTINCT k, spec_id, stop_id FROM ndealt_m JOIN nst0 USING (trip_id) WHERE later = 0 OR sday < later OR arrival < 86400"),
    ("nwalk_m", "SELECT DISTINCT p.k, a.stop_id AS o, b.stop_id AS d, CAST(floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / speed) AS INT) AS seconds FROM nserved_m p JOIN nserved_m q ON q.k = p.k JOIN nspec s ON s.spec_id = p.spec_id JOIN roots_at a ON a.stop_id = p.stop_id JOIN roots_at b ON b.stop_id = q.stop_id WHERE a.stop_id <> b.stop_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= max_walk"),
    ("nkey_m", "SELECT DISTINCT k, n.spec_id, until FROM nnet_m n JOIN nspec s ON s.spec_id = n.spec_id"),
    ("nkreq_m", "SELECT k, stop_id FROM nkey_m JOIN nreq USING (spec_id)"),
]


def closed(rides: str, walks: str, starts: str, required: str | None, bounds: str, rounds: int = ROUNDS, name: str = "np") -> list[tuple[str, str]]:
    """The common tables of a keyed closure: paths (k, o, d, dep, arr, f, thru, n) of up to 1, 2, ... changes.

    rides (k, o, d, dep, arr) and walks (k, o, d, seconds); starts (k, stop_id); required (k, stop_id);
    bounds: (k, lb, ub), the departures that count.
    """
    # Every path is marked with whether its last stop is a required one, so that going on needs no look-up.
    at_required = f"SELECT x.*, r.stop_id IS NOT NULL AS req FROM (SELECT p.* FROM {{body}} p) x LEFT JOIN {required} r ON r.k = x.k AND r.stop_id = x.d" if required else "SELECT x.*, false AS req FROM {body} x"
    seen = lambda keys, tie, body: (
        f"SELECT *, min(CASE WHEN NOT f THEN arr END) OVER (PARTITION BY {keys} ORDER BY dep, arr DESC, {tie} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later, min(CASE WHEN f THEN arr - dep END) OVER (PARTITION BY {keys}) AS walk, "
        f"row_number() OVER (PARTITION BY {keys} ORDER BY f DESC, arr - dep, thru DESC, fresh, n) AS r FROM ({body})"
    )
    good = "(NOT f AND (later IS NULL OR arr < later) AND (walk IS NULL OR arr - dep < walk)) OR (f AND r = 1)"
    out = [
        (f"{name}edge_m", f"SELECT k, o, d, dep, arr, f FROM ({seen('k, o, d', 'n', f'SELECT k, o, d, dep, arr, false AS f, false AS thru, 0 AS fresh, 1 AS n FROM {rides} UNION ALL SELECT k, o, d, 0, seconds, true, false, 0, 1 FROM {walks}')}) WHERE {good}"),
        (f"{name}ride_m", f"SELECT k, o, d, dep, min(arr) AS arr FROM {name}edge_m WHERE NOT f GROUP BY ALL"),
        (f"{name}ends_m", f"SELECT DISTINCT k, o, d FROM {name}ride_m"),
        (f"{name}0_m", f"SELECT e.k, o, d, dep, arr, f, false AS thru, 1 AS n FROM {name}edge_m e JOIN {bounds} b ON b.k = e.k WHERE EXISTS (FROM {starts} s WHERE s.k = e.k AND s.stop_id = e.o) AND (f OR (dep >= lb AND dep < ub))"),
    ]
    for i in range(1, rounds + 1):
        p = f"({at_required.format(body=f'{name}{i - 1}_m')})"
        asked = f"SELECT p.k, p.o, p.d AS via, e.d AS xd, p.dep, p.arr AS at_s, thru OR req AS thru, n FROM {p} p JOIN {name}ends_m e ON e.k = p.k AND e.o = p.d WHERE NOT p.f AND e.d <> p.o"
        every = (
            f"SELECT k, o, d, dep, arr, f, thru, n, 0 AS fresh FROM {name}{i - 1}_m UNION ALL SELECT q.k, q.o, q.xd, q.dep, b.arr, false, q.thru, q.n + 1, 1 FROM ({asked}) q ASOF JOIN {name}ride_m b ON q.k = b.k AND q.via = b.o AND q.xd = b.d AND q.at_s <= b.dep"
            f" UNION ALL SELECT p.k, p.o, e.d, CASE WHEN e.f THEN 0 ELSE e.dep - (p.arr - p.dep) END, CASE WHEN e.f THEN p.arr - p.dep + e.arr - e.dep ELSE e.arr END, e.f, thru OR req, n + 1, 1 FROM (FROM {p} WHERE f) p JOIN {name}edge_m e ON e.k = p.k AND e.o = p.d WHERE e.d <> p.o"
            f" UNION ALL SELECT p.k, p.o, w.d, p.dep, p.arr + w.arr, false, thru OR req, n + 1, 1 FROM (FROM {p} WHERE NOT f) p JOIN (FROM {name}edge_m WHERE f) w ON w.k = p.k AND w.o = p.d WHERE w.d <> p.o"
        )
        inside = f"SELECT x.* FROM ({every}) x JOIN {bounds} b ON b.k = x.k WHERE f OR (dep >= lb AND dep < ub)"
        out.append((f"{name}{i}_m", f"SELECT k, o, d, dep, arr, f, thru, n FROM ({seen('k, o, d', 'thru, -fresh, -n', inside)}) WHERE {good}"))
    return out


_TIMES = "CAST(dep AS INT) AS dep, CAST(arr AS INT) AS arr, f AS is_flex"
_SOLVED = [*_NETS, ("nbound_m", "SELECT k, 0 AS lb, until AS ub FROM nkey_m"), *closed("nride_m", "nwalk_m", "nkreq_m", "nkreq_m", "nbound_m")]


@query(
    "n2_network_of_each_date",
    f"SELECT i.spec_id, i.date, CASE WHEN net_date < i.date THEN net_date END AS duplicate_of, o, d, {_TIMES} FROM np{ROUNDS}_m p JOIN ninst i ON p.k = concat(CAST(i.spec_id AS STRING), '/', i.net_date) WHERE NOT thru AND EXISTS (FROM nkreq_m r WHERE r.k = p.k AND r.stop_id = p.d)",
    *_SOLVED,
)
def _(spark, g):
    """Three specs over a week: 21 reduced networks, equal days solved once."""
    found = networks.prepared_networks(specs_of(spark), required_of(spark), services.date_range(spark, FIRST, DAYS), g)
    return found.select("spec_id", "date", "duplicate_of", "o", "d", "dep", "arr", "is_flex")


@query("n2_instances", f"SELECT spec_id, date, CASE WHEN net_date < date THEN net_date END AS duplicate_of FROM ninst WHERE i < {DAYS}", *_NETS)
def _(spark, g):
    return networks.patterns(specs_of(spark), services.date_range(spark, FIRST, DAYS), g).select("spec_id", "date", "duplicate_of")
