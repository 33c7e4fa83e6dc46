"""Registered queries of the time-series engine and their SQL.

The series come from the star schema: a gauge for each event type (hourly steps), counters made of
event ids, a gauge of order prices for each priority (daily steps).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.rpn import Expression, Grid
from .operators import admin, consolidate, fetch, forecast, ingest, vdef
from .plans.script import Script, Source
from .schema import Archive, Database, DataSource
from .sources import archives, dump, exports, rrd
from .streaming import readings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR, DAY, HEARTBEAT = 3600, 86400, 14400
#: The window of most queries: the thirty days of the events.
START, END = 1704067200, 1706659200
INF = float("inf")


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return keep


# readings


def events(spark: SparkSession, sf_dir: str, v: str = "value") -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000))
    return e.select(F.col("event_type").alias("series"), ts.alias("ts"), F.expr(v).alias("v"), F.col("event_id").alias("seq"))


def readings_sql(v: str = "value") -> str:
    return f"SELECT event_type AS series, CAST(floor(epoch(ts)) AS BIGINT) AS ts, arg_min({v}, event_id) AS v FROM events GROUP BY ALL"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderpriority").alias("series"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq"))


ORDERS_SQL = "SELECT o_orderpriority AS series, CAST(epoch(o_orderdate) AS BIGINT) AS ts, arg_min(o_totalprice, o_orderkey) AS v FROM orders GROUP BY ALL"

AMOUNTS = {
    "GAUGE": ("v * i", "v"),
    "ABSOLUTE": ("v", "v / i"),
    "COUNTER": ("CASE WHEN d >= 0 THEN d WHEN d + 4294967295 >= 0 THEN d + 4294967295 ELSE d + 4294967295 + 18446744069414584320 END", None),
    "DERIVE": ("CASE WHEN (v < 0) = (old < 0) THEN d END", None),
    "DCOUNTER": ("CASE WHEN NOT ((d < 0 AND v > 0) OR (d > 0 AND v < 0)) THEN d END", None),
    "DDERIVE": ("d", None),
}


def pdp_sql(readings: str, kind: str = "GAUGE", step: int = HOUR, heartbeat: int = HEARTBEAT, low: float | None = None, high: float | None = None) -> str:
    """Common table expressions up to pdp(series, ts, v), from readings of whole seconds."""
    amount, rate = AMOUNTS[kind]
    rate = rate or f"({amount}) / i"
    bounds = "".join(f" AND {rate} {op} {x}" for op, x in ((">=", low), ("<=", high)) if x is not None)
    return f"""
rd AS ({readings}),
p_prev AS (SELECT series, ts, v::DOUBLE AS v, lag(ts) OVER w AS prev, lag(v::DOUBLE) OVER w AS old FROM rd WINDOW w AS (PARTITION BY series ORDER BY ts)),
p_step AS (SELECT *, (ts - prev)::DOUBLE AS i, v - old AS d FROM p_prev WHERE prev IS NOT NULL),
p_amount AS (SELECT series, ts, prev, ts - prev AS i, CASE WHEN i <= {heartbeat}{bounds} THEN {amount} END::DOUBLE AS a FROM p_step),
p_rate AS (SELECT *, a / i AS r, ts // {step} - prev // {step} AS n, prev // {step} AS b0, ts // {step} AS b1 FROM p_amount),
p_parts AS (SELECT series, b1 AS b, sum(CASE WHEN n = 0 THEN a ELSE r * (ts - b1 * {step}) END) AS k,
  sum(CASE WHEN a IS NULL THEN CASE WHEN n = 0 THEN i ELSE ts - b1 * {step} END END) AS u FROM p_rate GROUP BY ALL),
p_opened AS (SELECT series, min(prev) AS f FROM p_rate GROUP BY ALL),
p_close AS (SELECT b.series, b.b0, b.n, b.r, b.i, b.b1 * {step} - b.prev AS w, (b.b1 * {step} - b.prev) % {step} AS lead, p.k,
  coalesce(p.u, 0) + CASE WHEN f // {step} = b.b0 THEN f % {step} ELSE 0 END AS u
  FROM p_rate b JOIN p_opened USING (series) LEFT JOIN p_parts p ON p.series = b.series AND p.b = b.b0 WHERE b.n > 0),
p_part AS (SELECT *, CASE WHEN n = 1 OR lead < 1 THEN w ELSE lead END AS part, CASE WHEN n = 1 OR lead >= 1 THEN {step} ELSE n * {step} END AS len,
  CASE WHEN n > 1 AND lead >= 1 THEN lead > {heartbeat} ELSE i > {heartbeat} END AS late FROM p_close),
p_value AS (SELECT *, CASE WHEN 2 * u <= {step} AND NOT late AND len - u - CASE WHEN r IS NULL THEN part ELSE 0 END > 0 THEN
  CASE WHEN r IS NULL THEN k ELSE coalesce(k, 0) + r * part END / (len - u - CASE WHEN r IS NULL THEN part ELSE 0 END) END AS v FROM p_part),
pdp AS (SELECT series, (b0 + j + 1) * {step} AS ts, CASE WHEN j = 0 THEN v ELSE r END AS v FROM p_value, unnest(range(n)) AS t(j))"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.pdps(events(spark, sf_dir), DataSource("v", "GAUGE", HEARTBEAT), HOUR)


HOURLY = pdp_sql(readings_sql())


def out(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ingestion

for _kind, _v in (("GAUGE", "value"), ("ABSOLUTE", "value"), ("COUNTER", "cast(event_id % 5000 as string)"), ("DERIVE", "cast((event_id * 7919) % 2001 - 1000 as string)"), ("DCOUNTER", "cast(event_id % 5000 as double)"), ("DDERIVE", "value")):

    def _pdp(spark: SparkSession, sf_dir: str, kind: str = _kind, v: str = _v) -> DataFrame:
        return out(ingest.pdps(events(spark, sf_dir, v), DataSource("v", kind, HEARTBEAT), HOUR))

    query(f"WITH {pdp_sql(readings_sql(_v), _kind)} SELECT series, ts, round(v, 9) AS v FROM pdp", f"{_kind.lower()}_{'pdp' if _kind in ('GAUGE', 'ABSOLUTE') else 'rate'}")(_pdp)


@query(f"WITH {pdp_sql(readings_sql(), heartbeat=1800)} SELECT series, ts, round(v, 9) AS v FROM pdp")
def heartbeat_gap(spark, sf_dir):
    return out(ingest.pdps(events(spark, sf_dir), DataSource("v", "GAUGE", 1800), HOUR))


@query(f"WITH {pdp_sql(readings_sql(), low=10, high=80)} SELECT series, ts, round(v, 9) AS v FROM pdp")
def minmax_range(spark, sf_dir):
    return out(ingest.pdps(events(spark, sf_dir), DataSource("v", "GAUGE", HEARTBEAT, 10, 80), HOUR))


@query(f"WITH {HOURLY}, w AS (SELECT ts, max(v) FILTER (series = 'click') AS a, max(v) FILTER (series = 'view') AS b FROM pdp GROUP BY ts) SELECT 'all' AS series, 'c' AS ds, ts, round(a + b * 2, 9) AS v FROM w")
def compute_ds(spark, sf_dir):
    pdp = hourly(spark, sf_dir).select(F.lit("all").alias("series"), F.col("series").alias("ds"), "ts", "v")
    return out(ingest.computed(pdp, "c", "click,view,2,*,+"))


@query("WITH rd AS (" + readings_sql() + "), m AS (SELECT series, max(ts) AS last FROM rd GROUP BY series) SELECT series, last, round(v, 9) AS reading FROM m JOIN rd USING (series) WHERE rd.ts = m.last")
def last_update(spark, sf_dir):
    first = events(spark, sf_dir).groupBy("series", "ts").agg(F.min_by("v", "seq").alias("v"))
    return out(fetch.last_updates(first))


@query(
    f"""WITH rd AS ({readings_sql()}), x AS (SELECT series, ts, v, lag(ts) OVER (PARTITION BY series ORDER BY ts) AS prev FROM rd),
p AS (SELECT series, prev, ts, ts - prev AS i, CASE WHEN ts - prev <= 1800 THEN v END AS r, unnest(range(prev // 3600, (ts - 1) // 3600 + 1)) AS b FROM x WHERE prev IS NOT NULL),
q AS (SELECT *, least(ts, (b + 1) * 3600) - greatest(prev, b * 3600) AS o FROM p),
e AS (SELECT series, max(ts) AS last FROM q GROUP BY series),
s AS (SELECT series, b, sum(r * o) AS k, sum(o) FILTER (r IS NOT NULL) AS n, bool_or(i > 1800) AS gap FROM q GROUP BY ALL)
SELECT series, (b + 1) * 3600 AS ts, round(CASE WHEN NOT gap AND 2 * coalesce(n, 0) >= 3600 THEN k / n END, 9) AS v FROM s JOIN e USING (series) WHERE (b + 1) * 3600 <= last"""
)
def native_gauge(spark, sf_dir):
    return out(ingest.native_pdps(events(spark, sf_dir), HOUR, 1800))


# consolidation


def rra_sql(cf: str, k: int, rows: int, xff: float = 0.5, base: str = HOURLY) -> str:
    f = {"AVERAGE": "avg(v)", "MIN": "min(v)", "MAX": "max(v)", "LAST": "CASE WHEN max(ts) FILTER (v IS NOT NULL) = max(ts) THEN arg_max(v, ts) END"}[cf]
    slot = k * HOUR
    return f"""{base}, e AS (SELECT series, max(ts) // {slot} * {slot} AS last FROM pdp GROUP BY series),
s AS (SELECT series, (ts + {slot - 1}) // {slot} * {slot} AS te, {f} AS v, count(v) AS known FROM pdp GROUP BY series, te),
rra AS (SELECT s.series, te AS ts, CASE WHEN {k} - known <= {xff} * {k} THEN v END AS v FROM s JOIN e USING (series) WHERE te <= last AND te > last - {rows * slot})"""


def _rra(cf: str, k: int = 6, rows: int = 100, xff: float = 0.5, heartbeat: int = HEARTBEAT):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        pdp = ingest.pdps(events(spark, sf_dir), DataSource("v", "GAUGE", heartbeat), HOUR)
        return out(consolidate.archive_rows(pdp, Archive(cf, xff, k, rows), HOUR))

    return f


PICK = " SELECT series, ts, round(v, 9) AS v FROM rra"
for _cf in ("AVERAGE", "MIN", "MAX", "LAST"):
    query(f"WITH {rra_sql(_cf, 6, 100)}{PICK}", f"rra_{_cf.lower()}")(_rra(_cf))
query(f"WITH {rra_sql('AVERAGE', 6, 100, 0.2, pdp_sql(readings_sql(), heartbeat=1800))}{PICK}", "xff_gate")(_rra("AVERAGE", 6, 100, 0.2, 1800))
query(f"WITH {rra_sql('AVERAGE', 1, 48)}{PICK}", "retention")(_rra("AVERAGE", 1, 48))


@query(f"WITH {pdp_sql(ORDERS_SQL, step=DAY, heartbeat=10 * DAY)} SELECT series, ts, round(v, 6) AS v FROM pdp")
def orders_daily(spark, sf_dir):
    pdp = ingest.pdps(orders(spark, sf_dir), DataSource("v", "GAUGE", 10 * DAY), DAY)
    return pdp.select("series", "ts", F.round("v", 6).alias("v"))


# fetching and scripts

ARCHIVES = (Archive("AVERAGE", 0.5, 1, 1000), Archive("AVERAGE", 0.5, 6, 400), Archive("MAX", 0.5, 24, 60), Archive("LAST", 0.5, 1, 1000))


def ingested(spark: SparkSession, sf_dir: str) -> Source:
    """The events as one database: a data source for each event type, four archives."""
    readings, steps = events(spark, sf_dir), f"{archives.shared_folder(spark)}/steps"
    hourly(spark, sf_dir).write.parquet(steps)  # made once: each archive reads them, and storing reads each twice
    pdp = spark.read.parquet(steps)
    names, last = readings.agg(F.sort_array(F.collect_set("series")), F.max("ts")).first()  # types of events are few
    db = Database(HOUR, tuple(DataSource(n, "GAUGE", HEARTBEAT) for n in names), ARCHIVES, None, int(last))
    return Source(db, consolidate.consolidate(pdp, list(ARCHIVES), HOUR).drop("cf"))


#: Stored databases by application and input.
_STORED: dict[tuple[str, str], str] = {}


def database(spark: SparkSession, sf_dir: str) -> Source:
    """That database as fetches find it: its archives are made of the readings once in a session and
    stored; each fetch then reads the rows of its archive and window."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORED:
        source, folder = ingested(spark, sf_dir), archives.shared_folder(spark)
        archives.store(source.points, source.db, folder)
        _STORED[key] = folder
    return archives.load(spark, _STORED[key])


def script(spark: SparkSession, sf_dir: str, *elements: str, step: int = 1) -> Script:
    return Script(START, END, {"events": database(spark, sf_dir)}, step, now=END).run(*elements)


def series_sql(name: str, step: int = HOUR) -> str:
    """Rows of the window of one series, end + 1 step as fetched; from pdp or rra of the name."""
    table = "pdp" if step == HOUR else "rra"
    return f"(SELECT t AS ts, v FROM range({START + step}, {END + step + 1}, {step}) AS r(t) LEFT JOIN (SELECT ts, v FROM {table} WHERE series = '{name}') p ON p.ts = t)"


AB = f"{HOURLY}, a AS {series_sql('click')}, b AS {series_sql('view')}, w AS (SELECT a.ts, a.v AS a, b.v AS b FROM a JOIN b USING (ts))"


@query(f"WITH {HOURLY}, n AS (SELECT DISTINCT series FROM pdp) SELECT n.series, t AS ts, round(p.v, 9) AS v FROM n, range({START + HOUR}, {END + HOUR + 1}, {HOUR}) AS r(t) LEFT JOIN pdp p ON p.series = n.series AND p.ts = t")
def fetch_grid(spark, sf_dir):
    s = database(spark, sf_dir)
    return out(fetch.fetch(s.points, s.db, "AVERAGE", START, END, series=s.names())[0])


@query("SELECT * FROM (VALUES ('AVERAGE', 1, 0), ('AVERAGE', 21600, 1), ('MAX', 1, 0), ('MAX', 86400, 2), ('MIN', 86400, 0), ('LAST', 1, 0)) AS t(cf, step, rra)")
def archive_choice(spark, sf_dir):
    db = database(spark, sf_dir).db
    rows = [(cf, step, fetch.choose_archive(db, cf, START, END, step)) for cf, step in (("AVERAGE", 1), ("AVERAGE", 21600), ("MAX", 1), ("MAX", 86400), ("MIN", 86400), ("LAST", 1))]
    return spark.createDataFrame(rows, "cf string, step int, rra int")


@query("WITH l AS (SELECT max(CAST(floor(epoch(ts)) AS BIGINT)) AS t FROM events) " + " UNION ALL ".join(f"SELECT {i} AS rra, t // {a.pdp_per_row * HOUR} * {a.pdp_per_row * HOUR} - {(a.rows - 1) * a.pdp_per_row * HOUR} AS first FROM l" for i, a in enumerate(ARCHIVES)))
def first_update(spark, sf_dir):
    db = database(spark, sf_dir).db
    return spark.createDataFrame([(i, fetch.first_time(db, i)) for i in range(len(db.archives))], "rra int, first long")


def rpn(name: str, sql: str, *expressions: str, grid: bool = True) -> None:
    """A query of several expressions over click (a) and view (b): columns e0, e1, ...; a zero has no
    sign."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = script(spark, sf_dir, "DEF:a=events:click:AVERAGE", "DEF:b=events:view:AVERAGE")
        rows = s.aligned(["a", "b"], s.series["a"].start, s.series["a"].end, HOUR).withColumn("series", F.lit("x"))
        g = Grid(step=HOUR, now=END)
        columns = [Expression.parse(e).column({"a": F.col("a"), "b": F.col("b")}, g) for e in expressions]
        return rows.select("ts", *[(F.round(c, 9) + F.lit(0.0)).alias(f"e{i}") for i, c in enumerate(columns)])

    made = ", ".join(f"round(({x.strip()})::DOUBLE, 9) + 0 AS e{i}" for i, x in enumerate(sql.split(";")))
    query(f"WITH {AB} SELECT ts, {made} FROM w", name)(f)


rpn("rpn_arith", "a + b; a - b; a * b; CASE WHEN b <> 0 THEN a / b END; CASE WHEN b <> 0 THEN fmod(a, b) END; pow(a, 2); atan2(a, b)", "a,b,+", "a,b,-", "a,b,*", "a,b,/", "a,b,%", "a,2,POW", "a,b,ATAN2")
rpn("rpn_addnan", "coalesce(CASE WHEN a > 50 THEN a END + b, CASE WHEN a > 50 THEN a END, b)", "a,50,GT,a,UNKN,IF,b,ADDNAN")
rpn("rpn_compare_if", "(a < b)::INT; (a <= b)::INT; (a > b)::INT; (a >= b)::INT; (a = b)::INT; (a <> b)::INT; CASE WHEN a > b THEN a ELSE b END; (CASE WHEN a >= 50 THEN a END IS NULL)::INT; 1", "a,b,LT", "a,b,LE", "a,b,GT", "a,b,GE", "a,b,EQ", "a,b,NE", "a,b,GT,a,b,IF", "a,50,INF,LIMIT,UN", "NEGINF,ISINF")
rpn("rpn_limit", "CASE WHEN a BETWEEN 20 AND 70 THEN a END; CASE WHEN b BETWEEN 40 AND 60 THEN b END", "a,20,70,LIMIT", "b,40,60,LIMIT")
rpn("rpn_minmax_nan", "least(a, b); greatest(a, b); least(CASE WHEN a > 50 THEN a END, b); greatest(CASE WHEN a > 50 THEN a END, b); CASE WHEN a > 50 THEN least(a, b) END", "a,b,MIN", "a,b,MAX", "a,50,INF,LIMIT,b,MINNAN", "a,50,INF,LIMIT,b,MAXNAN", "a,50,INF,LIMIT,b,MIN")
rpn("rpn_math", "sin(a); cos(a); ln(abs(a)); exp(a / 100); atan(a); sqrt(abs(a)); abs(a - b); a * 0.0174532952; a * 57.29577951", "a,SIN", "a,COS", "a,ABS,LOG", "a,100,/,EXP", "a,ATAN", "a,ABS,SQRT", "a,b,-,ABS", "a,DEG2RAD", "a,RAD2DEG")
rpn("rpn_rounding", "floor(a); ceil(a); sign(a - b) * floor(abs(a - b) + 0.5)", "a,FLOOR", "a,CEIL", "a,b,-,ROUND")
rpn("rpn_stack", "a + a; b - a; a; 2; a + b + a + b; a; b * 10 + a", "a,DUP,+", "a,b,EXC,-", "a,b,POP", "a,b,DEPTH,EXC,POP,EXC,POP", "a,b,2,COPY,+,+,+", "a,b,2,INDEX,EXC,POP,EXC,POP", "b,10,*,a,+")
rpn("rpn_sort_rev", "least(a, b, 50) + 10 * (a + b + 50 - least(a, b, 50) - greatest(a, b, 50)) + 100 * greatest(a, b, 50); 50 + 10 * b + 100 * a", "a,b,50,3,SORT,100,*,EXC,10,*,+,+", "a,b,50,3,REV,100,*,EXC,10,*,+,+")
rpn("rpn_setops", "list_avg([a, b, 30.0]); list_min([a, b, 30.0]); list_max([a, b, 30.0]); list_median([a, b, 30.0]); list_stddev_samp([a, b, 30.0])", "a,b,30,3,AVG", "a,b,30,3,SMIN", "a,b,30,3,SMAX", "a,b,30,3,MEDIAN", "a,b,30,3,STDEV")
rpn("rpn_percent", "list_sort([a, b, 30.0, 70.0], 'ASC', 'NULLS FIRST')[2]; list_sort([a, b, 30.0, 70.0], 'ASC', 'NULLS FIRST')[4]", "a,b,30,70,50,4,PERCENT", "a,b,30,70,95,4,PERCENT")
rpn("rpn_calendar", f"ts; {END}; 3600; (ts % 86400 < 3600)::INT; ((ts + 345600) // 604800 <> (ts - 3600 + 345600) // 604800)::INT; (month(to_timestamp(ts) AT TIME ZONE 'UTC') <> month(to_timestamp(ts - 3600) AT TIME ZONE 'UTC'))::INT; ts", "TIME", "NOW", "STEPWIDTH", "NEWDAY", "NEWWEEK", "NEWMONTH", "LTIME")
rpn("rpn_roll", "3 + 10 * 1 + 100 * a; 2 + 10 * b", "b,7,a,3,1,ROLL,EXC,10,*,+,EXC,100,*,+", "a,b,2,0,ROLL,10,*,+")
rpn("rpn_count", "row_number() OVER (ORDER BY ts)", "COUNT")
rpn("rpn_prev_of", "a - lag(a) OVER (ORDER BY ts)", "a,PREV(a),-")
rpn("rpn_prev_sum", "sum(a) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)", "a,PREV,ADDNAN")
rpn("rpn_trend", "CASE WHEN row_number() OVER (ORDER BY ts) >= 4 AND count(a) OVER t = 4 THEN avg(a) OVER t END".replace("OVER t", "OVER (ORDER BY ts ROWS 3 PRECEDING)"), "a,14400,TREND")
rpn("rpn_trendnan", "CASE WHEN row_number() OVER (ORDER BY ts) >= 4 THEN avg(CASE WHEN a BETWEEN 40 AND 60 THEN a END) OVER (ORDER BY ts ROWS 3 PRECEDING) END", "a,40,60,LIMIT,14400,TRENDNAN")
#: Offsets 24, 25, 48 and 49, each only from the row on whose index (from 0) is above it.
_SAMPLES = "list_filter([" + ", ".join(f"CASE WHEN row_number() OVER (ORDER BY ts) - 1 > {o} THEN lag(a, {o - 1}) OVER (ORDER BY ts) END" for o in (24, 25, 48, 49)) + "], lambda x: x IS NOT NULL)"
rpn("rpn_predict", f"list_avg({_SAMPLES})", "86400,172800,2,3600,a,PREDICT")
rpn("rpn_predictsigma", f"CASE WHEN len({_SAMPLES}) > 1 THEN list_stddev_samp({_SAMPLES}) END", "86400,172800,2,3600,a,PREDICTSIGMA")
rpn("rpn_predictperc", f"CASE WHEN len({_SAMPLES}) > 0 THEN list_aggregate({_SAMPLES}, 'quantile_cont', 0.9) END", "86400,172800,2,3600,90,a,PREDICTPERC")


_LOCAL = "to_timestamp(ts) AT TIME ZONE 'America/New_York'"


@query(
    f"""WITH {pdp_sql(ORDERS_SQL, step=DAY, heartbeat=10 * DAY)}, t AS (SELECT DISTINCT series, ts, {_LOCAL} AS l, to_timestamp(ts - 86400) AT TIME ZONE 'America/New_York' AS p FROM pdp)
SELECT series, ts, (ts + CASE WHEN month(l) = 12 AND day(l) = 31 THEN 172800 ELSE 0 END + epoch(l) - ts)::DOUBLE AS ltime, (year(l) <> year(p))::INT::DOUBLE AS newyear, (month(l) <> month(p))::INT::DOUBLE AS newmonth FROM t"""
)
def rpn_calendar_years(spark, sf_dir):
    """The calendar of daily order series over the years, in a zone with summer time."""
    rows = ingest.pdps(orders(spark, sf_dir), DataSource("v", "GAUGE", 10 * DAY), DAY)
    g = Grid(step=DAY, zone="America/New_York")
    e = {n: Expression.parse(n.upper()).column({}, g) for n in ("ltime", "newyear", "newmonth")}
    return rows.select("series", "ts", *[c.alias(n) for n, c in e.items()])


# aggregates over series

FINITE = f"WITH {HOURLY}, n AS (SELECT DISTINCT series FROM pdp), s AS (SELECT n.series, t AS ts, p.v FROM n, range({START + HOUR}, {END + HOUR + 1}, {HOUR}) AS r(t) LEFT JOIN pdp p ON p.series = n.series AND p.ts = t), i AS (SELECT *, (ts - {START + HOUR}) / 3600.0 AS x FROM s WHERE v IS NOT NULL)"
VDEFS = {
    "MAXIMUM": "max(v) AS value, (arg_max(-ts, v) * -1) AS time", "MINIMUM": "min(v) AS value, arg_min(ts, v) AS time", "AVERAGE": "avg(v) AS value, NULL AS time", "STDEV": "stddev_pop(v) AS value, NULL AS time",
    "LAST": "arg_max(v, ts) AS value, max(ts) AS time", "FIRST": "arg_min(v, ts) AS value, min(ts) - 3600 AS time", "TOTAL": "sum(v) * 3600 AS value, NULL AS time",
    "LSLSLOPE": "regr_slope(v, x) AS value, NULL AS time", "LSLINT": "regr_intercept(v, x) AS value, NULL AS time", "LSLCORREL": "corr(v, x) AS value, NULL AS time",
}


def _vdef(function: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = database(spark, sf_dir)
        rows = fetch.fetch(s.points, s.db, "AVERAGE", START, END, series=s.names())[0]
        return out(vdef.vdef(rows, function, HOUR, 95 if function.startswith("PERCENT") else None), 4 if function == "TOTAL" else 9)

    return f


for _f in vdef.FUNCTIONS:
    if _f.startswith("PERCENT"):
        _only = " WHERE v IS NOT NULL" if _f == "PERCENTNAN" else ""
        _sql = f", k AS (SELECT series, v, row_number() OVER (PARTITION BY series ORDER BY v NULLS FIRST) - 1 AS k, count(*) OVER (PARTITION BY series) AS c FROM s{_only}) SELECT series, round(v, 9) AS value, NULL::BIGINT AS time FROM k WHERE k = floor(95 * (c - 1) / 100 + 0.5)"
    else:
        _sql = f", r AS (SELECT series, {VDEFS[_f]} FROM i GROUP BY series) SELECT n.series, round(value, {4 if _f == 'TOTAL' else 9}) AS value, time::BIGINT AS time FROM n LEFT JOIN r USING (series)"
    query(FINITE + _sql, f"vdef_{_f.lower()}")(_vdef(_f))


# scripts

SIX = rra_sql("AVERAGE", 6, 400)


@query(f"WITH {SIX}, a AS {series_sql('click')}, b AS {series_sql('view', 6 * HOUR)} SELECT a.ts, round(a.v + b.v, 9) AS c FROM a LEFT JOIN b ON b.ts = (a.ts + 21599) // 21600 * 21600 WHERE a.ts <= {END}")
def cdef_mixed_step(spark, sf_dir):
    return out(script(spark, sf_dir, "DEF:a=events:click:AVERAGE", "DEF:b=events:view:AVERAGE:step=21600", "CDEF:c=a,b,+", "XPORT:c").export())


#: Hours (a) beside samples of six hours (b), k counting b's samples from 1; 0 stands before the first.
OWN = f"""WITH {SIX}, a AS {series_sql('click')}, b AS {series_sql('view', 6 * HOUR)},
k AS (SELECT row_number() OVER (ORDER BY ts) AS k, ts, v FROM b UNION ALL SELECT 0, {START}, NULL),
w AS (SELECT a.ts, a.v AS a, k.k, row_number() OVER (ORDER BY a.ts) AS i FROM a JOIN k ON k.ts = a.ts // 21600 * 21600)"""


@query(
    f"""{OWN}, t AS (SELECT k, CASE WHEN count(v) OVER r + greatest(2 - k, 0) = 2 THEN coalesce(sum(v) OVER r, 0) / 2 END AS v FROM k WINDOW r AS (ORDER BY k ROWS 1 PRECEDING))
SELECT w.ts, round(CASE WHEN i >= 2 THEN a * 0 + t.v END, 9) AS c FROM w JOIN t USING (k) WHERE w.ts <= {END}"""
)
def trend_mixed_step(spark, sf_dir):
    """A trend over the samples of a variable that is coarser than the grid."""
    return out(script(spark, sf_dir, "DEF:a=events:click:AVERAGE", "DEF:b=events:view:AVERAGE:step=21600", "CDEF:c=a,0,*,b,43200,TREND,+", "XPORT:c").export())


@query(
    f"""{OWN}, o AS (SELECT unnest([1, 2, 2, 3]) AS o), q AS (SELECT w.ts, CASE WHEN w.k - o < 0 THEN 0 ELSE k.v END AS v FROM w JOIN o ON o < i - 1 LEFT JOIN k ON k.k = w.k - o + 1)
SELECT w.ts, round(a * 0 + m.v, 9) AS c FROM w LEFT JOIN (SELECT ts, avg(v) AS v FROM q GROUP BY ts) m USING (ts) WHERE w.ts <= {END}"""
)
def predict_mixed_step(spark, sf_dir):
    return out(script(spark, sf_dir, "DEF:a=events:click:AVERAGE", "DEF:b=events:view:AVERAGE:step=21600", "CDEF:c=a,0,*,21600,43200,2,21600,b,PREDICT,+", "XPORT:c").export())


@query(
    f"""WITH {HOURLY}, n AS (SELECT DISTINCT series FROM pdp), s AS (SELECT n.series AS host, t AS ts, p.v FROM n, range({START + HOUR}, {END + HOUR + 1}, {HOUR}) AS r(t) LEFT JOIN pdp p ON p.series = n.series AND p.ts = t),
m AS (SELECT host, avg(v) AS m FROM s GROUP BY host), t AS (SELECT *, CASE WHEN count(v) OVER w = 4 THEN avg(v) OVER w END AS t FROM s WINDOW w AS (PARTITION BY host ORDER BY ts ROWS 3 PRECEDING))
SELECT host, ts, round(v - t + m, 9) AS d FROM t JOIN m USING (host) WHERE ts <= {END}"""
)
def fleet_script(spark, sf_dir):
    """One script over a fleet of databases: every event type is a host with one data source."""
    points = hourly(spark, sf_dir).select(F.col("series").alias("host"), F.lit("v").alias("series"), F.lit(0).alias("rra"), "ts", "v")
    last = int(points.agg(F.max("ts")).first()[0])
    db = Database(HOUR, (DataSource("v", "GAUGE", HEARTBEAT),), (Archive("AVERAGE", 0.5, 1, 1000),), None, last)
    s = Script(START, END, {"fleet": Source(db, points)}, now=END, keys=("host",))
    return out(s.run("DEF:x=fleet:v:AVERAGE", "CDEF:c=x,x,14400,TREND,-", "VDEF:m=x,AVERAGE", "CDEF:d=c,m,+", "XPORT:d").export())


@query(f"WITH {HOURLY}, a AS {series_sql('click')} SELECT t AS ts, round(a.v, 9) AS a FROM range({START + HOUR}, {END + 1}, {HOUR}) AS r(t) LEFT JOIN a ON a.ts = t - 7200 WHERE true")
def shift(spark, sf_dir):
    return out(script(spark, sf_dir, "DEF:a=events:click:AVERAGE", "SHIFT:a:9000", "XPORT:a").export())


@query(f"WITH {HOURLY}, a AS {series_sql('click')}, g AS (SELECT (ts + 14399) // 14400 * 14400 AS te, max(v) AS v FROM a GROUP BY te) SELECT te AS ts, round(CASE WHEN te <= {END} THEN v END, 9) AS a FROM g WHERE te <= {-(-END // 14400) * 14400}")
def def_reduce(spark, sf_dir):
    s = database(spark, sf_dir)
    rows, first, last, slot = fetch.fetch(s.points.where("series = 'click'"), s.db, "AVERAGE", START, END, series=["click"])
    rows, _ = consolidate.reduced(rows, slot, 4 * HOUR, "MAX", first, END)
    return out(rows.where(F.col("ts") <= END).select("ts", F.col("v").alias("a")))


@query(f"WITH {HOURLY}, a AS {series_sql('click')}, b AS {series_sql('view')} SELECT a.ts, round(a.v, 9) AS click, round(b.v * 2, 9) AS doubled FROM a JOIN b USING (ts) WHERE a.ts <= {END}")
def xport_grid(spark, sf_dir):
    return out(script(spark, sf_dir, "DEF:a=events:click:AVERAGE", "DEF:b=events:view:AVERAGE", "CDEF:c=b,2,*", "XPORT:a:click", "XPORT:c:doubled").export())


@query(f"WITH {HOURLY}, a AS {series_sql('click')} SELECT ts, round(v - (SELECT avg(v) FROM a), 9) AS c FROM a WHERE ts <= {END}")
def vdef_in_cdef(spark, sf_dir):
    return out(script(spark, sf_dir, "DEF:a=events:click:AVERAGE", "VDEF:m=a,AVERAGE", "CDEF:c=a,m,-", "XPORT:c").export())


@query(f"WITH {AB} SELECT ts, round(a, 9) AS a, round(a + b, 9) AS b FROM w WHERE ts <= {END}")
def stack_columns(spark, sf_dir):
    return out(script(spark, sf_dir, "DEF:a=events:click:AVERAGE", "DEF:b=events:view:AVERAGE", "AREA:a#ff0000", "STACK:b#00ff00").stacked())


@query(f"WITH {HOURLY}, a AS {series_sql('click')} SELECT 0 AS place, 'HRULE' AS kind, 50.0::DOUBLE AS at UNION ALL SELECT 1, 'HRULE', round(avg(v), 9) FROM a UNION ALL SELECT 2, 'VRULE', arg_min(ts, -v)::DOUBLE FROM a")
def rules(spark, sf_dir):
    """Lines across a picture at a number, at an average and at the time of a maximum."""
    return out(script(spark, sf_dir, "DEF:a=events:click:AVERAGE", "VDEF:m=a,AVERAGE", "VDEF:top=a,MAXIMUM", "HRULE:50#ff0000", "HRULE:m#00ff00:mean", "VRULE:top#0000ff").ruled())


@query(f"WITH {HOURLY}, a AS {series_sql('click')} SELECT ts, round(v, 9) AS v FROM a WHERE v BETWEEN 45 AND 55")
def tick_marks(spark, sf_dir):
    return out(script(spark, sf_dir, "DEF:a=events:click:AVERAGE", "CDEF:t=a,45,55,LIMIT", "TICK:t#ff0000").ticks("t"))


@query(f"WITH {HOURLY}, a AS {series_sql('click')} SELECT round(avg(v), 9) AS average, round(min(v), 9) AS least, round(max(v), 9) AS most FROM a")
def print_values(spark, sf_dir):
    s = script(spark, sf_dir, "DEF:a=events:click:AVERAGE", "PRINT:a:AVERAGE:%lf", "PRINT:a:MIN:%lf", "PRINT:a:MAX:%lf")
    rows = [p.select(F.col("value").alias(n)) for (p, _), n in zip(s.prints, ("average", "least", "most"))]
    return out(rows[0].crossJoin(rows[1]).crossJoin(rows[2]))  # one row each


@query(
    f"""WITH RECURSIVE {HOURLY}, a AS {series_sql('click')}, n AS (SELECT row_number() OVER (ORDER BY ts) AS i, ts, v FROM a WHERE ts <= {END}),
r AS (SELECT i, ts, v AS c FROM n WHERE i = 1 UNION ALL SELECT n.i, n.ts, CASE WHEN r.c IS NULL THEN n.v ELSE r.c * 0.9 + n.v * 0.1 END FROM r JOIN n ON n.i = r.i + 1)
SELECT ts, round(c, 9) AS c FROM r"""
)
def cdef_recurrence(spark, sf_dir):
    return out(script(spark, sf_dir, "DEF:a=events:click:AVERAGE", "CDEF:c=PREV,UN,a,PREV,0.9,*,a,0.1,*,+,IF", "XPORT:c").export())


# forecasting


def hw_sql(m: forecast.Model) -> str:
    """The recurrence, row by row: r holds the state after row i of a series."""
    g = m.gamma if m.deviation_gamma is None else m.deviation_gamma
    apply = "({} * {})" if m.multiplicative else "({} + {})"
    remove = "CASE WHEN {1} > 0 THEN {0} / {1} END" if m.multiplicative else "({0} - {1})"
    blend = lambda w, new, old: f"({w} * ({new}) + (1 - {w}) * ({old}))"
    return f"""WITH RECURSIVE {HOURLY}, n AS (SELECT series, ts, v, row_number() OVER (PARTITION BY series ORDER BY ts) AS i FROM pdp),
r AS (
  SELECT DISTINCT series, 0::BIGINT AS i, NULL::BIGINT AS ts, NULL::DOUBLE AS v, NULL::DOUBLE AS p, NULL::DOUBLE AS new, NULL::DOUBLE AS new_d, NULL::DOUBLE AS d, 0.0::DOUBLE AS failure,
    NULL::DOUBLE AS level, NULL::DOUBLE AS trend, 1::BIGINT AS gap, list_resize([]::DOUBLE[], {m.period}) AS season, list_resize([]::DOUBLE[], {m.period}) AS deviation, list_resize([]::INT[], {m.window}, 0) AS flags FROM n
  UNION ALL
  SELECT series, i, ts, v, p, new, new_d, d, (list_sum(flags) >= {m.threshold})::INT::DOUBLE, level, trend, gap,
    list_concat(season[1:k - 1], [new], season[k + 1:]), list_concat(deviation[1:k - 1], [new_d], deviation[k + 1:]), flags
  FROM (
    SELECT *, CASE WHEN guess IS NULL THEN NULL WHEN v IS NULL THEN d WHEN d IS NULL THEN abs(v - guess) ELSE {blend(g, 'abs(v - guess)', 'd')} END AS new_d,
      list_concat([(d IS NOT NULL AND (v IS NULL OR coalesce(v > guess + {m.delta_pos} * d OR v < guess - {m.delta_neg} * d, false)))::INT], flags_[1:{m.window - 1}]) AS flags
    FROM (
      SELECT *, CASE WHEN opens THEN CASE WHEN s IS NULL THEN {remove.format('v', 'level')} ELSE {blend(m.gamma, remove.format('v', 'level'), 's')} END
          WHEN level_ IS NOT NULL AND s IS NULL THEN {remove.format('v', 'level_')}
          WHEN learns THEN {blend(m.gamma, remove.format('v', 'level'), 's')} ELSE s END AS new,
        CASE WHEN opens THEN 0.0 WHEN learns THEN {blend(m.beta, 'level - level_', 'trend_')} ELSE trend_ END AS trend,
        CASE WHEN opens OR learns THEN 1 WHEN p IS NOT NULL AND v IS NULL THEN gap_ + 1 ELSE gap_ END AS gap,
        CASE WHEN opens THEN {apply.format('v', 's')} ELSE p END AS guess
      FROM (
        SELECT *, CASE WHEN opens THEN v WHEN learns THEN {blend(m.alpha, remove.format('v', 's'), 'level_ + gap_ * trend_')} ELSE level_ END AS level, {apply.format('(level_ + gap_ * trend_)', 's')} AS p
        FROM (
          SELECT n.series, n.i, n.ts, n.v, (n.i - 1) % {m.period} + 1 AS k, season[k] AS s, deviation[k] AS d, r.level AS level_, r.trend AS trend_, r.gap AS gap_, season, deviation, r.flags AS flags_,
            r.level IS NULL AND n.v IS NOT NULL AS opens, r.level IS NOT NULL AND season[k] IS NOT NULL AND n.v IS NOT NULL AS learns
          FROM r JOIN n ON n.series = r.series AND n.i = r.i + 1
        )
      )
    )
  )
)
SELECT series, ts, round(v, 6) AS v, round(p, 6) AS predicted, round(new, 6) AS seasonal, round(new_d, 6) AS deviation, round(d, 6) AS devpredict, failure FROM r WHERE i > 0"""


for _n, _m in (("hw_predict", forecast.Model(24)), ("mhw_predict", forecast.Model(24, multiplicative=True)), ("hw_failures", forecast.Model(24, delta_pos=1.0, delta_neg=1.0, window=6, threshold=3))):

    def _hw(spark: SparkSession, sf_dir: str, m: forecast.Model = _m) -> DataFrame:
        return out(forecast.forecast(hourly(spark, sf_dir), m), 6)

    query(hw_sql(_m), _n)(_hw)


# maintenance


@query(f"WITH {rra_sql('AVERAGE', 12, 100)}{PICK}")
def tune_backfill(spark, sf_dir):
    s = database(spark, sf_dir)
    return out(admin.backfilled(s.points, s.db, Archive("AVERAGE", 0.5, 12, 100)))


@query(f"WITH {rra_sql('AVERAGE', 6, 20)}{PICK}")
def resize_shrink(spark, sf_dir):
    s = database(spark, sf_dir)
    return out(admin.resized(s.points, s.db, 1, -380)[0].where("rra = 1").select("series", "ts", "v"))


@query(f"WITH {rra_sql('MAX', 24, 60)}{PICK}")
def archive_store(spark, sf_dir):
    """Archives written to a new store in two parts and read back."""
    s, folder = ingested(spark, sf_dir), archives.shared_folder(spark)
    middle = (START + END) // 2
    archives.store(s.points.where(F.col("ts") <= middle), s.db, folder)
    archives.append(archives.load(spark, folder), s.points.where(F.col("ts") > middle), s.db.last_update, folder)
    again = archives.load(spark, folder)
    assert again.db == s.db
    return out(again.points.where("rra = 2").select("series", "ts", "v"))


@query(
    " UNION ALL ".join(
        f"SELECT * FROM (WITH {rra_sql(a.cf, a.pdp_per_row, a.rows)}, l AS (SELECT (max(ts) // 86400 - 3) * 86400 + 5000 AS t FROM rd) SELECT series AS ds, ts, '{a.cf}' AS cf, {a.pdp_per_row} AS pdp_per_row, round(v, 9) AS v FROM rra, l WHERE ts > t // {a.pdp_per_row * HOUR} * {a.pdp_per_row * HOUR})"
        for a in ARCHIVES
    )
)
def update_summary(spark, sf_dir):
    """What the updates of the last days wrote."""
    s = database(spark, sf_dir)
    return out(admin.written(s.points, s.db, s.db.last_update // DAY * DAY - 3 * DAY + 5000).withColumnRenamed("series", "ds"))


@query(f"WITH {rra_sql('AVERAGE', 6, 400)}{PICK}")
def create_prefilled(spark, sf_dir):
    """A new database with the rows of one of the same definition."""
    s = database(spark, sf_dir)
    new = Database(HOUR, s.db.sources, s.db.archives, s.db.last_update, s.db.last_update)
    return out(admin.prefilled(s.points, s.db, new).where("rra = 1").select("series", "ts", "v"))


@query(
    f"""WITH {rra_sql('AVERAGE', 6, 400)} SELECT CASE series WHEN 'click' THEN 'hits' ELSE series END AS series, ts, round(v, 9) AS v FROM rra JOIN (SELECT max(last) AS top FROM e) ON ts > top - 380 * 21600 WHERE series <> 'error'"""
)
def tune_structure(spark, sf_dir):
    """Several changes in one operation: a source renamed, one removed, an archive shortened."""
    s = database(spark, sf_dir)
    db, points = admin.restructured(s.db, s.points, rename={"click": "hits"}, remove_sources=("error",), resize={1: -20}, remove_archives=(0, 3))
    assert [a.pdp_per_row for a in db.archives] == [6, 24] and db.archives[0].rows == 380
    return out(points.where("rra = 0").select("series", "ts", "v"))


@query(
    f"""WITH {rra_sql('AVERAGE', 6, 400)}, n AS (SELECT DISTINCT series FROM rra), l AS (SELECT max(CAST(floor(epoch(ts)) AS BIGINT)) AS t FROM events),
g AS (SELECT unnest(range((t - 401 * 21600) // 21600 * 21600 + 21600, (t - 21600) // 21600 * 21600 + 21601, 21600)) AS ts FROM l)
SELECT n.series, g.ts, round(rra.v, 9) AS v FROM n CROSS JOIN g LEFT JOIN rra ON rra.series = n.series AND rra.ts = g.ts"""
)
def step_change(spark, sf_dir):
    """The archives of a database whose step was made four times finer, as a fetch alone gives them."""
    s = database(spark, sf_dir)
    finer = s.db.restepped(4)
    return out(fetch.fetch(s.points, finer, "AVERAGE", finer.last_update - 401 * 21600, finer.last_update - 21600, 21600)[0])


# files and texts


STORED = f"WITH {rra_sql('AVERAGE', 6, 400)}, n AS (SELECT DISTINCT series, last FROM rra JOIN e USING (series)), l AS (SELECT max(CAST(floor(epoch(ts)) AS BIGINT)) // 21600 * 21600 AS t FROM events), g AS (SELECT n.series, l.t - 21600 * i AS ts FROM (SELECT DISTINCT series FROM n) n, l, range(400) AS r(i)) SELECT g.series, g.ts, round(rra.v, 9) AS v FROM g LEFT JOIN rra ON rra.series = g.series AND rra.ts = g.ts"


@query(STORED)
def rrd_file(spark, sf_dir):
    """The database written as a round-robin file and one of its archives read through the source."""
    s, folder = database(spark, sf_dir), archives.local_path(archives.shared_folder(spark))
    with open(f"{folder}/events.rrd", "wb") as f:
        f.write(rrd.encode(rrd.filled(s.db, s.points)))
    return out(rrd.load(spark, folder).where("rra = 1").select("series", "ts", "v"))


@query(STORED)
def dump_restore(spark, sf_dir):
    """The same by way of an XML dump, which keeps eleven digits."""
    s, folder = database(spark, sf_dir), archives.local_path(archives.shared_folder(spark))
    rounded = s.points.withColumn("v", F.round("v", 9))
    with open(f"{folder}/events.rrd", "wb") as f:
        f.write(rrd.encode(dump.restore(dump.dump(rrd.filled(s.db, rounded)))))
    return out(rrd.load(spark, folder).where("rra = 1").select("series", "ts", "v"))


def text_sql(row: str, head: list[str], tail: list[str] = (), unknown: str = "NaN") -> str:
    value = lambda c: f"coalesce(printf('%.10e', round({c}, 9)), '{unknown}')"
    fixed = [f"SELECT {p} AS part, CAST({i} AS BIGINT) AS place, '{x}' AS line" for p, lines in ((0, head), (2, tail)) for i, x in enumerate(lines)]
    return f"WITH {AB} " + " UNION ALL ".join([*fixed, f"SELECT 1, ts, {row.format(a=value('a'), b=value('b'))} FROM w WHERE ts <= {END}"])


def two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(script(spark, sf_dir, "DEF:a=events:click:AVERAGE", "DEF:b=events:view:AVERAGE", "XPORT:a:click", "XPORT:b:view").export())


@query(text_sql('ts || \',"\' || {a} || \'","\' || {b} || \'"\'', ['"time","click","view"']))
def export_csv(spark, sf_dir):
    return exports.export(two_columns(spark, sf_dir), "CSV", START, END, HOUR)


@query(text_sql("'    <row><t>' || ts || '</t><v0>' || {a} || '</v0><v1>' || {b} || '</v1></row>'", ['<?xml version="1.0" encoding="ISO-8859-1"?>', "", "<xport>", "  <meta>", f"    <start>{START + HOUR}</start>", f"    <end>{END}</end>", "    <step>3600</step>", f"    <rows>{(END - START) // HOUR}</rows>", "    <columns>2</columns>", "    <legend>", "      <entry>click</entry>", "      <entry>view</entry>", "    </legend>", "  </meta>", "  <data>"], ["  </data>", "</xport>"]))
def export_xml(spark, sf_dir):
    return exports.export(two_columns(spark, sf_dir), "XMLENUM", START, END, HOUR)


@query(text_sql(f"'    [ ' || {{a}} || ', ' || {{b}} || CASE WHEN ts < {END} THEN ' ],' ELSE ' ]' END", ['{ "about": "RRDtool graph JSON output",', '  "meta": {', f'    "start": {START + HOUR},', f'    "end": {END},', '    "step": 3600,', '    "legend": [', '      "click",', '      "view"', "          ]", "     },", '  "data": ['], ["  ]", "}"], "null"))
def export_json(spark, sf_dir):
    return exports.export(two_columns(spark, sf_dir), "JSON", START, END, HOUR)


@query(text_sql("lpad(CAST(ts AS VARCHAR), 10, ' ') || ': ' || {a} || ' ' || {b}", [" " * 11 + "click".rjust(20) + "view".rjust(20), ""], unknown="nan"))
def fetch_listing(spark, sf_dir):
    return exports.listing(two_columns(spark, sf_dir))


@query("WITH a AS (SELECT event_type AS series, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS id FROM events) SELECT series, 'x' AS ds, ts, CAST(id AS VARCHAR) AS v FROM a UNION ALL SELECT series, 'y', ts, NULL FROM a UNION ALL SELECT series, 'z', ts, CASE WHEN id % 3 <> 0 THEN CAST(id % 10 AS VARCHAR) END FROM a")
def update_arguments(spark, sf_dir):
    lines = events(spark, sf_dir, "cast(event_id as string)").selectExpr("series", "concat_ws(':', ts, if(seq % 3 = 0, 'U', string(seq % 10)), v) AS line")
    return readings.arguments(lines, ["x", "y", "z"], ["z", "x"], keep=("series",))


@query(f"WITH {HOURLY}, a AS {series_sql('click')} SELECT ts, round(v, 9) AS click FROM a WHERE ts <= {END}")
def at_style_window(spark, sf_dir):
    sources = {"events": database(spark, sf_dir)}
    return out(Script.between("end-30d", "20240131 00:00", sources, now=END).run("DEF:a=events:click:AVERAGE", "XPORT:a:click").export())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as gauges, consolidated to six hours, doubled, with their maximum beside them."""
    s = script(spark, sf_dir, "DEF:x=events:click:AVERAGE:step=21600", "CDEF:c=x,2,*", "VDEF:m=c,MAXIMUM", "CDEF:top=c,0,*,m,+", "XPORT:c", "XPORT:top")
    return out(s.export())


query(f"WITH {SIX}, b AS {series_sql('click', 6 * HOUR)} SELECT ts, round(2 * v, 9) AS c, round((SELECT max(2 * v) FROM b) + 0 * v, 9) AS top FROM b WHERE ts <= {END}")(flagship)
