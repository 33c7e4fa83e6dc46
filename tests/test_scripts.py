"""Scripts over at-style windows, printed texts and tuning of forecasts."""

import math

import pytest
from pyspark.sql import functions as F

from tidemill.functions.rpn import Expression, Grid
from tidemill.operators import forecast
from tidemill.plans.script import Script
from tidemill.schema import Database

T0 = 1_000_000_000


def test_printed_texts(spark):
    rows = spark.createDataFrame([(T0 + 10, 1500.0), (T0 + 20, 2500.0)], "ts long, v double")
    s = Script.between("end-20s", str(T0 + 20), {}, now=T0 + 20).define("a", rows, T0, T0 + 20, 10)
    s.run("VDEF:m=a,MAXIMUM", "VDEF:n=a,AVERAGE", "PRINT:m:%.1lf %s", "PRINT:m:%Y %T:strftime".replace("%T", "%H"), "PRINT:n:%Y:strftime", "PRINT:a:MIN:%lf", "PRINT:m::valstrfduration")
    assert (s.start, s.end) == (T0, T0 + 20)
    assert s.printed() == ["2.5 k", "2001 01", "----", "1500.000000", "0:00:02"]
    with pytest.raises(ValueError):
        Script.between("1979-01-01", "now", {}, now=T0)
    assert Script.between("end-1000s", str(T0), {}, now=T0, rows=10).step == 100


def test_forecast_tuning():
    db = Database.create(["DS:x:GAUGE:600:U:U", "RRA:HWPREDICT:100:0.1:0.01:24"], 300)
    for option, value in (("alpha", 0.5), ("gamma", 0.2), ("gamma-deviation", 0.3), ("deltapos", 3), ("window-length", 12), ("smoothing-window", 0.1)):
        db = db.forecast_tuned(option, value)
    m = forecast.Model.of(db)
    assert (m.period, m.alpha, m.beta, m.gamma, m.deviation_gamma, m.delta_pos, m.window, m.threshold, m.smoothing) == (24, 0.5, 0.01, 0.2, 0.3, 3, 12, 7, 0.1)
    for option, value in (("beta", 2), ("window-length", 40), ("failure-threshold", 13), ("deltaneg", -1)):
        with pytest.raises(ValueError):
            db.forecast_tuned(option, value)
    with pytest.raises(ValueError):
        Database.create(["DS:x:GAUGE:600:U:U", "RRA:AVERAGE:0.5:1:10"]).forecast_tuned("alpha", 0.5)


def test_aberrant_reset():
    state, m = forecast.State(), forecast.Model(4)
    for k in range(10):
        state.step(float(k), m)
    at = state.at
    state.reset()
    assert math.isnan(state.level) and all(map(math.isnan, state.season)) and state.at == at and not any(state.flags)


def test_recurrences(spark):
    v = [4.0, None, 9.0, 16.0, 1.0, -2.0]
    rows = spark.createDataFrame([(T0 + 10 * (i + 1), x) for i, x in enumerate(v)], "ts long, v double")
    s = Script(T0, T0 + 60, {}).define("a", rows, T0, T0 + 60, 10)

    def of(text):
        s.run(f"CDEF:c{len(s.series)}=a,POP,{text}")
        return [r["v"] for r in s.series[f"c{len(s.series) - 1}"].rows.orderBy("ts").collect()]

    assert of("a,SQRT,PREV,UN,0,PREV,IF,MAXNAN") == [2, 2, 3, 4, 4, 4]
    assert of("PREV,a,0,20,LIMIT,2,AVG") == [4, 4, 6.5, 11.25, 6.125, 6.125]
    assert of("COUNT,PREV,2,SORT,EXC,POP") == [1, 2, 3, 4, 5, 6]
    assert of("PREV,UN,1,PREV,2,*,IF,5,MIN") == [1, 2, 4, 5, 5, 5]
    assert of("a,PREV(a),-,PREV,EXC,ADDNAN") == [None, None, None, 7, -8, -11]
    assert of("TIME,PREV,EXC,MINNAN") == [T0 + 10] * 6
    assert of("a,20,TREND,PREV,ADDNAN") == [None, None, None, 12.5, 21, 20.5]
    assert of("PREV,UN,7,PREV,IF,1,2,3,50,3,PERCENT,+,DUP,-") == [0] * 6
    for bad in ("PREV,+", "PREV,20,TREND", "PREV,a,AVG", "1,PREV"):
        with pytest.raises(ValueError):
            of(bad)


def test_sample_before_at_own_step(spark):
    fine = spark.createDataFrame([(T0 + 10 * (i + 1), float(i)) for i in range(6)], "ts long, v double")
    coarse = spark.createDataFrame([(T0 + 20, 5.0), (T0 + 40, 7.0), (T0 + 60, 1.0)], "ts long, v double")
    s = Script(T0, T0 + 60, {}).define("a", fine, T0, T0 + 60, 10).define("b", coarse, T0, T0 + 60, 20)
    s.run("VDEF:m=b,MAXIMUM", "CDEF:c=a,POP,PREV(b)", "CDEF:d=a,PREV(m),+", "CDEF:e=a,POP,PREV,PREV(b),ADDNAN")
    rows = {n: [r["v"] for r in s.series[n].rows.orderBy("ts").collect()] for n in "cde"}
    assert rows == {"c": [None, None, 5, 5, 7, 7], "d": [7, 8, 9, 10, 11, 12], "e": [None, None, 5, 10, 17, 24]}


def test_past_of_a_coarser_variable(spark):
    fine = spark.createDataFrame([(T0 + 10 * (i + 1), float(i)) for i in range(9)], "ts long, v double")
    coarse = spark.createDataFrame([(T0 + 30, 3.0), (T0 + 60, 6.0), (T0 + 90, None)], "ts long, v double")
    assert T0 % 10 == 0
    start = T0 - T0 % 30
    shift = lambda df: df.withColumn("ts", df["ts"] - (T0 - start))
    s = Script(start, start + 90, {}).define("a", shift(fine), start, start + 90, 10).define("b", shift(coarse), start, start + 90, 30)

    def of(text):
        s.run(f"CDEF:c{len(s.series)}=a,POP,{text}")
        return [r["v"] for r in s.series[f"c{len(s.series) - 1}"].rows.orderBy("ts").collect()]

    # the samples that are over: none, none, 3, 3, 3, 6, 6, 6, unknown; before the first they are 0
    assert of("b,30,TREND") == [0, 0, 3, 3, 3, 6, 6, 6, None]
    assert of("b,60,TREND") == [None, 0, 1.5, 1.5, 1.5, 4.5, 4.5, 4.5, None]
    assert of("b,60,TRENDNAN") == [None, 0, 1.5, 1.5, 1.5, 4.5, 4.5, 4.5, 6]
    # offsets 1 and 2 (the newest and the one before it), below the row's number
    assert of("30,1,30,b,PREDICT") == [None, None, 3, 1.5, 1.5, 4.5, 4.5, 4.5, 6]
    assert of("30,1,30,b,PREDICTSIGMA")[3] == pytest.approx(4.5**0.5)


def test_scripts_of_many_series(spark):
    rows = [(h, T0 + 10 * (i + 1), None if (h, i) == ("y", 2) else float(i * k)) for h, k in (("x", 1), ("y", 10)) for i in range(6)]
    points = spark.createDataFrame(rows, "host string, ts long, v double")
    s = Script(T0, T0 + 60, {}, keys=("host",)).define("a", points, T0, T0 + 60, 10)
    s.run("VDEF:m=a,MAXIMUM", "CDEF:b=a,m,/", "CDEF:c=a,20,TREND,PREV(a),+", "CDEF:d=PREV,UN,a,PREV,a,ADDNAN,IF", "HRULE:m#f00", "PRINT:a:MAX:%lf", "LINE:a#f00", "STACK:b#0f0")
    got = {n: {(r["host"], r["ts"] - T0): r["v"] for r in s.series[n].rows.collect()} for n in "bcd"}
    assert got["b"][("x", 40)] == 3 / 5 and got["b"][("y", 40)] == 30 / 50 and got["b"][("y", 30)] is None
    assert got["c"][("x", 30)] == 1.5 + 1 and got["c"][("y", 40)] is None and got["c"][("y", 50)] == 35 + 30 and got["c"][("x", 10)] is None
    assert got["d"][("x", 60)] == 15 and got["d"][("y", 60)] == 130
    assert {(r["host"], r["at"]) for r in s.ruled().collect()} == {("x", 5), ("y", 50)}
    assert {tuple(r)[:2] for r in s.prints[0][0].collect()} == {("x", 5), ("y", 50)}
    assert {(r["host"], r["b"]) for r in s.stacked().where(F.col("ts") == T0 + 60).collect()} == {("x", 6), ("y", 51)}
    with pytest.raises(ValueError):
        s.run("SHIFT:a:m")
    with pytest.raises(ValueError):
        s.printed()


def test_roll_and_local_time(spark):
    rows = spark.createDataFrame([(1609459200,), (1625097600,)], "ts long")  # 2021-01-01 and 2021-07-01, UTC

    def of(text, zone="UTC"):
        return [r[0] for r in rows.orderBy("ts").select(Expression.parse(text).column({}, Grid(step=86400, zone=zone))).collect()]

    assert of("1,2,3,4,5,6,3,1,ROLL,3,REV,100,*,EXC,10,*,+,+,EXC,POP,EXC,POP,EXC,POP") == [6 * 100 + 1 * 10 + 3] * 2
    assert of("LTIME,TIME,-", "America/New_York") == [154800, -14400] and of("LTIME,TIME,-", "Asia/Kolkata") == [19800] * 2
    assert of("NEWYEAR", "Asia/Kolkata") == [1, 0] and of("NEWMONTH") == [1, 1]
