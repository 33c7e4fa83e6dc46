"""Golden and hand-computed cases of the time-series engine."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions.rpn import Expression, Grid
from tidemill.operators import admin, consolidate, fetch, forecast, ingest, vdef
from tidemill.plans.script import Script
from tidemill.schema import Archive, Database, DataSource, duration

T0 = 1_000_000_000


def readings(spark, rows):
    return spark.createDataFrame([("s", T0 + t, v) for t, v in rows], "series string, ts long, v double")


def values(df, by="ts"):
    return {r[by] - T0: r["v"] for r in df.collect()}


def test_recorded_case(spark):
    a = [(10, 1.0), (20, 3.0), (25, None), (30, 5.0), (40, 7.0)]
    b = [(10, 2.0), (20, 4.0), (25, 6.0), (30, 200.0), (40, 8.0)]
    pa = ingest.pdps(readings(spark, a), DataSource("a", "GAUGE", 20), 10, start=T0)
    pb = ingest.pdps(readings(spark, b), DataSource("b", "GAUGE", 20, 0, 100), 10, start=T0)
    assert values(pa) == {10: 1, 20: 3, 30: 5, 40: 7}
    assert values(pb) == {10: 2, 20: 4, 30: 6, 40: 8}
    assert values(consolidate.archive_rows(pa, Archive("MAX", 0.5, 2, 5), 10)) == {20: 3, 40: 7}
    assert values(consolidate.archive_rows(pa, Archive("LAST", 0.5, 1, 4), 10)) == {10: 1, 20: 3, 30: 5, 40: 7}
    assert values(consolidate.archive_rows(pa, Archive("MIN", 0.5, 3, 3), 10)) == {20: 1}
    both = pa.withColumn("ds", F.lit("a")).unionByName(pb.withColumn("ds", F.lit("b")))
    assert values(ingest.computed(both, "c", "a,b,+")) == {10: 3, 20: 7, 30: 11, 40: 15}


def test_counter_wraps(spark):
    rows = spark.createDataFrame([("s", T0, "4294967296"), ("s", T0 + 10, "5"), ("s", T0 + 20, "18446744073709551615"), ("s", T0 + 30, "5")], "series string, ts long, v string")
    got = {r["ts"] - T0: r["a"] for r in ingest.amounts(rows, DataSource("v", "COUNTER", 100)).collect()}
    assert got[10] == 4 and got[30] == 5 - 18446744073709551615 + 4294967295 + 18446744069414584320


def test_long_gap_is_unknown(spark):
    got = values(ingest.pdps(readings(spark, [(0, 1.0), (10, 1.0), (60, 5.0), (70, 2.0)]), DataSource("v", "GAUGE", 20), 10))
    assert got == {10: 1, 20: None, 30: None, 40: None, 50: None, 60: None, 70: 2}


def test_expressions(spark):
    row = spark.createDataFrame([("s", 3600, 4.0, None, float("inf"))], "series string, ts long, x double, u double, i double")
    cols = {c: F.col(c) for c in ("x", "u", "i")}

    def of(text):
        return row.select(Expression.parse(text).column(cols, Grid(step=3600)).alias("v")).first()["v"]

    assert of("x,0,/") == math.inf and of("0,0,/") is None and of("i,i,-") is None
    assert of("u,x,ADDNAN") == 4 and of("u,x,+") is None and of("u,1,2,IF") == 2
    assert of("0,LOG") == -math.inf and of("-1,SQRT") is None and of("u,0,POW") == 1
    assert of("-2.5,ROUND") == -3 and of("1e300,FLOOR") == 1e300 and of("-7.5,2,%") == -1.5
    assert of("x,1,u,3,MEDIAN") == 2.5 and of("1,2,3,50,3,PERCENT") == 2 and of("i,ISINF") == 1
    assert of("1,2,3,3,REV,POP,POP") == 3 and of("1,2,EXC,-") == 1 and of("x,DUP,*") == 16
    with pytest.raises(ValueError):
        of("x,+")


def test_vdefs(spark):
    rows = spark.createDataFrame([("s", 110 + 10 * i, v) for i, v in enumerate([None, 2.0, 5.0, 5.0, None])], "series string, ts long, v double")
    got = {f: tuple(vdef.vdef(rows, f, 10, 50).first()[1:]) for f in vdef.FUNCTIONS}
    assert got["MAXIMUM"] == (5, 130) and got["FIRST"] == (2, 110) and got["LAST"] == (5, 140)
    assert got["TOTAL"] == (120, None) and got["PERCENT"][0] == 2 and got["PERCENTNAN"][0] == 5


def test_mixed_steps_and_shift(spark):
    t = 3600
    a = spark.createDataFrame([(t + 300 * (i + 1), float(v)) for i, v in enumerate([1, 2, 3, 4])], "ts long, v double")
    b = spark.createDataFrame([(t + 600 + 200 * (i + 1), float(v)) for i, v in enumerate([10, 20, 30, 40])], "ts long, v double")
    s = Script(t, t + 1200, {}).define("a", a, t, t + 1200, 300).define("b", b, t + 600, t + 1400, 200).run("CDEF:c=a,b,+")
    assert [r["v"] for r in s.series["c"].rows.orderBy("ts").collect()] == [13, 13, 23, 24, 34, 34]
    s.run("SHIFT:a:-450")
    assert s.series["a"].start == t - 300


def test_archive_choice_and_window():
    db = Database.create(["DS:x:GAUGE:600:U:U", "RRA:AVERAGE:0.5:1:600", "RRA:AVERAGE:0.5:6:200", "RRA:MAX:0.5:6:200"], 300, 0)
    db = Database(db.step, db.sources, db.archives, 0, 172800)
    assert fetch.choose_archive(db, "AVERAGE", 100000, 172800, 300) == 0
    assert fetch.choose_archive(db, "AVERAGE", 100000, 172800, 1800) == 1
    assert fetch.choose_archive(db, "MAX", 100000, 172800, 1800) == 2
    assert fetch.window(100, 600, 300) == (0, 900)
    assert duration("2h", 300) == 24 and len(Archive.parse("RRA:HWPREDICT:100:0.1:0.1:24")) == 5


def test_forecast_of_a_constant(spark):
    rows = spark.createDataFrame([("s", 10 * i, 5.0) for i in range(12)], "series string, ts long, v double")
    got = [r["predicted"] for r in forecast.forecast(rows, forecast.Model(4)).orderBy("ts").collect()]
    # the first season gives coefficients, and every step after it a prediction
    assert got[:4] == [None] * 4 and all(abs(x - 5) < 1e-9 for x in got[4:])


def test_forecast_of_runs_and_what_it_carries(spark):
    m = forecast.Model(3, 0.5, 0.1, 0.25, smoothing=0.7)
    known = [(0, 4.0, 1), (1, 6.0, 1), (2, 8.0, 1), (3, 5.0, 1), (4, 6.0, 1), (5, 9.0, 1)]
    runs = [(6, 5.0, 2), (7, 5.0, 2), (8, 7.0, 1), (9, 1.0, 4), (10, 1.0, 4), (11, 1.0, 4), (12, 1.0, 4), (13, 6.0, 1)]
    rows = spark.createDataFrame([(k, 10 * t, v, n) for k in "ab" for t, v, n in known + runs], "series string, ts long, v double, run int")
    got = forecast.forecast(rows, m).where("series = 'b'").orderBy("ts").collect()

    # the same by hand
    nan = math.nan
    season, level, trend, gap = [nan] * 3, nan, nan, 1
    want, at, ahead = [], 0, 0
    for _, x, n in known + runs:
        s, p = season[(at + ahead) % 3], nan
        if n > 2:
            gap, ahead, new = gap + 1, 0, nan
        elif math.isnan(level):
            level, trend, new = x, 0.0, 0.0
        elif math.isnan(s):
            new = x - level
        else:
            p, before = level + gap * trend + s, level
            level = 0.5 * (x - s) + 0.5 * (level + gap * trend)
            trend, gap, new = 0.1 * (level - before) + 0.9 * trend, 1, 0.25 * (x - level) + 0.75 * s
        if n == 1:
            season[at] = new
        ahead, at = (int(n == 2) if n < 3 else 0), (at + 1) % 3
        want.append(p)
    assert [None if math.isnan(p) else round(p, 9) for p in want] == [None if r["predicted"] is None else round(r["predicted"], 9) for r in got]
    assert all(r["failure"] == 0 for r in got[9:13]) and [r["devpredict"] for r in got[9:13]] == [None] * 4
    state = forecast.states(rows, m, smooth=False).where("series = 'a'").first()
    assert (round(state["level"], 9), round(state["trend"], 9), state["gap"], state["at"]) == (round(level, 9), round(trend, 9), gap, at)
    assert [round(x, 9) for x in state["season"]] == [round(x, 9) for x in season]
    # the pass takes the mean of three neighbours, here all of them: what is left is 0 and the level has the mean
    smooth = forecast.states(rows, m).where("series = 'a'").first()
    assert all(abs(x) < 1e-9 for x in smooth["season"]) and abs(smooth["level"] - level - sum(season) / 3) < 1e-9


def test_smoothing_adds_the_mean_to_the_level_of_both_models():
    for multiplicative, left in ((False, [-1.0, 0.0, 1.0]), (True, [0.5, 1.0, 1.5])):
        state = forecast.State(level=10.0, season=[1.0, 2.0, 3.0], deviation=[1.0, math.nan, 1.0])
        state.smooth(forecast.Model(3, multiplicative=multiplicative, smoothing=0.0))
        assert state.season == left and state.level == 12.0 and math.isnan(state.deviation[1])


def test_runs_of_readings(spark):
    rows = spark.createDataFrame([("s", t, 1.0) for t in (0, 10, 45, 50, 71)], "series string, ts long, v double")
    got = ingest.pdps(rows, DataSource("v", "GAUGE", 100), 10, runs=True).orderBy("ts").collect()
    assert [(r["ts"], r["run"]) for r in got] == [(10, 1), (20, 3), (30, 3), (40, 3), (50, 1), (60, 2), (70, 2)]


def test_changes_of_structure(spark):
    db = Database.create(["DS:a:GAUGE:20:U:U", "DS:b:GAUGE:20:U:U", "RRA:AVERAGE:0.5:1:4", "RRA:MAX:0.5:2:2"], 10, 0)
    points = spark.createDataFrame([(s, i, t, float(t)) for s in "ab" for i, k in ((0, 10), (1, 20)) for t in range(k, 41, k)], "series string, rra int, ts long, v double")
    new, rows = admin.restructured(db, points, rename={"b": "c"}, remove_sources=("a",), add_sources=(DataSource("d"),), resize={0: -2}, remove_archives=(1,))
    assert [s.name for s in new.sources] == ["c", "d"] and [a.rows for a in new.archives] == [2]
    assert sorted(tuple(r) for r in rows.select("series", "rra", "ts").collect()) == [("c", 0, 30), ("c", 0, 40)]
    for wrong in ({"rename": {"x": "y"}}, {"rename": {"a": "b"}}, {"remove_archives": (0, 1)}, {"resize": {7: 1}}):
        with pytest.raises(ValueError):
            admin.restructured(db, points, **wrong)
    with pytest.raises(ValueError):
        admin.prefilled(points, db, Database(10, db.sources, db.archives, 5, 5))
    with pytest.raises(ValueError):
        admin.prefilled(points, db, Database(5, db.sources, db.archives, 0, 0))
    assert admin.prefilled(points, db, db).count() == points.count()
    assert sorted((r["ts"], r["cf"]) for r in admin.written(points.where("series = 'a'"), db, 25).collect()) == [(30, "AVERAGE"), (40, "AVERAGE"), (40, "MAX")]


def test_one_series_spreads_over_tasks(spark):
    rng = random.Random(5)
    t, rows = T0, []
    for _ in range(400):
        t += rng.choice([1, 60, 5_000, 9_000, 200_000])  # gaps within a day and over several
        rows.append(("s", t, rng.choice([None, rng.random()])))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ingest.amounts(spark.createDataFrame(rows, "series string, ts long, v double"), DataSource("v", "GAUGE", 300_000)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["task"] for r in got}) > 1
    assert sorted((r["prev"], r["ts"]) for r in got) == [(a[1], b[1]) for a, b in zip(rows, rows[1:])]
    # a text keeps what the reading before it said, in another span too
    counted = [("s", T0 + 50_000 * k, str(7 * k)) for k in range(20)]
    got = ingest.amounts(spark.createDataFrame(counted, "series string, ts long, v string"), DataSource("v", "COUNTER", 300_000)).collect()
    assert [r["a"] for r in got] == [7.0] * 19


def test_closed_steps_are_hashed(spark, capsys):
    ingest.pdps(readings(spark, [(0, 1.0), (10, 2.0)]), DataSource("v", "GAUGE", 20), 10).explain()
    assert "SortAggregate" not in capsys.readouterr().out
