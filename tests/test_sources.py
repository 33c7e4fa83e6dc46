"""Files, dumps, export texts, times and formats."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import formats, times
from tidemill.schema import Database
from tidemill.sources import dump, exports, rrd

T0 = 1_000_000_000
NOW = 1_700_000_000


def database(last=T0 + 1000):
    words = ["DS:a:GAUGE:600:U:U", "DS:b:COUNTER:600:0:100", "RRA:AVERAGE:0.5:1:50", "RRA:MAX:0.5:6:20", "RRA:HWPREDICT:40:0.1:0.01:10"]
    return Database.create(words, 10, last)


def example():
    whole = rrd.created(database())
    rng = np.random.default_rng(0)
    for r in whole.rows:
        r[:] = rng.normal(size=r.shape)
        r[::7] = math.nan
    return rrd.Whole(rrd.parse(rrd.encode(whole)), whole.rows)


def same(a, b, digits=None):
    assert a.header.db == b.header.db and a.header.open == b.header.open
    for x, y in zip(a.rows, b.rows):
        np.testing.assert_allclose(x, y, rtol=0 if digits is None else 10.0**-digits)


def test_file_round_trip(tmp_path):
    whole = example()
    path = tmp_path / "x.rrd"
    path.write_bytes(rrd.encode(whole))
    back = rrd.read(str(path))
    same(whole, back)
    assert rrd.encode(back) == rrd.encode(whole)
    keys = dict(rrd.info(str(path)))
    assert keys["step"] == "10" and keys["ds[b].max"] == "1.0000000000e+02" and keys["rra[1].cf"] == '"MAX"'
    assert keys["header_size"] == str(len(rrd.encode(whole)) - 8 * sum(r.size for r in whole.rows))
    with pytest.raises(ValueError):
        rrd.parse(rrd.encode(whole)[:300])
    with pytest.raises(ValueError):
        rrd.parse(b"something else" * 100)


def test_ring_that_has_turned(tmp_path):
    whole = example()
    raw = bytearray(rrd.encode(whole))
    h = rrd.parse(bytes(raw))
    at, n = h.offset(0), 16 * 50
    raw[at : at + n] = raw[at + 16 * 30 : at + n] + raw[at : at + 16 * 30]
    raw[h.size - 8 * len(h.db.archives) : h.size - 8 * len(h.db.archives) + 8] = (19).to_bytes(8, "little")
    (tmp_path / "t.rrd").write_bytes(raw)
    same(whole, rrd.read(str(tmp_path / "t.rrd")))


@pytest.mark.parametrize("header", ["none", "dtd", "xsd"])
def test_dump_round_trip(header):
    whole = example()
    back = dump.restore(dump.dump(whole, header))
    same(whole, back, 9)
    assert dump.dump(back, header) == dump.dump(whole, header)
    assert np.isnan(dump.restore(dump.dump(whole), check_range=True).rows[0][:, 1][whole.rows[0][:, 1] < 0]).all()


def test_spark_source(spark, tmp_path):
    whole = example()
    for name in ("x.rrd", "y.rrd"):
        (tmp_path / name).write_bytes(rrd.encode(whole))
    rows = rrd.load(spark, str(tmp_path))
    assert rows.count() == 2 * 2 * sum(r.shape[0] for r in whole.rows)
    one = rows.where("rra = 0 and series = 'a'").where(F.col("path").endswith("x.rrd"))
    got = [r["v"] for r in one.orderBy("ts").collect()]
    assert [math.nan if v is None else v for v in got] == pytest.approx(whole.rows[0][:, 0].tolist(), nan_ok=True)
    assert one.agg(F.max("ts"), F.min("ts")).first()[:] == (T0 + 1000, T0 + 1000 - 490)
    window = one.where(f"ts > {T0 + 700} and ts <= {T0 + 800}")
    assert window.count() == 10
    reader = rrd.Reader({"path": str(tmp_path)})
    list(reader.pushFilters([rrd.EqualTo(("rra",), 0), rrd.GreaterThan(("ts",), T0 + 700), rrd.LessThanOrEqual(("ts",), T0 + 800)]))
    assert [(p.first, p.count) for p in reader.partitions()] == [(20, 10)] * 2
    points = rows.where(F.col("path").endswith("x.rrd"))
    same(whole, rrd.filled(whole.header.db, points))
    assert [n[-5:] for n in rrd.names(str(tmp_path / "y*"))] == ["y.rrd"]


def test_exports(spark):
    t = spark.createDataFrame([(10, 1.5, None), (20, float("inf"), -2.0)], "ts long, x double, `the b` double")
    text = lambda d: [r["line"] for r in d.orderBy("part", "place").collect()]
    assert text(exports.export(t, "CSV", 0, 20, 10)) == ['"time","x","the b"', '10,"1.5000000000e+00","NaN"', '20,"inf","-2.0000000000e+00"']
    assert text(exports.export(t, "JSONTIME", 0, 20, 10))[-4:] == ['    [ "10",1.5000000000e+00, null ],', '    [ "20",null, -2.0000000000e+00 ]', "  ]", "}"]
    assert "    <row><t>10</t><v0>1.5000000000e+00</v0><v1>NaN</v1></row>" in text(exports.export(t, "XMLENUM", 0, 20, 10))
    assert text(exports.listing(t))[2] == "        10: 1.5000000000e+00 nan"
    with pytest.raises(ValueError):
        exports.export(t, "PNG", 0, 20, 10)


@pytest.mark.parametrize(
    "text, want",
    [
        ("1000000000#+1d", 1000000000), ("13:00 Jan 2", 884541474000), ("epoch+1000000000", -1209075200), ("20030102 13:00", 1041512400),
        ("01/02/2003 pm", 1041465600), ("1000000000+5-1h", 1000003605), ("1000000000+999999999999999h", 1661123568), ("1000000000+1 2h", "unparsable trailing text: '...h'"),
        ("12:30:45 01/02/2003", "unparsable trailing text: '...:45 01/02/2003'"), ("now foo", "if 'now' is followed by a token it must be +|- offset"), ("monday 13:00", "unparsable time: monday 13:00"),
        ("12:123", "parsing HH:MM syntax, got MM = 123 (>59!)"), ("13pm", "there cannot be more than 12 AM or PM hours"), ("19700101", "did you really mean month 19700101?"), ("01/02/2003 +1d", "unparsable trailing text: '...1d'"),
        ("12/31/69 +20y", "won't handle dates before epoch (01/01/1970), sorry"), ("Jan 31 2003 10:00 +1mon-1mon", 1044007200), ("May 31 2003 10:00 -1mon-1mon", 1049104800), ("now+", "There should be number after '+'"), ("", "unparsable time: "),
        ("1000000000+1m2m", 1007948800 - 86400), ("1000000000+6m2m", 1000000480), ("now-1d", NOW - 86400),
    ],
)
def test_times(text, want):
    if isinstance(want, int):
        assert times.instant(text, NOW) == want
    else:
        with pytest.raises(ValueError) as e:
            times.instant(text, NOW)
        assert str(e.value) == want


def test_windows_and_zones():
    assert times.window("end-1d", "1000000000", NOW) == (999913600, 1000000000)
    assert times.window("1000000000", "start+1d", NOW) == (1000000000, 1000086400)
    assert times.instant("1041397200+180d", NOW, "America/New_York") == 1056949200
    assert times.instant("Mar 9 2025 02:30", NOW, "America/New_York") == 1741505400
    with pytest.raises(ValueError, match="relative to itself"):
        times.window("start+1", "now", NOW)


def test_formats():
    kept, texts = None, []
    for f, v in (("%lf %S", 2500), ("%lf %s", 1500000), ("%lf %S", 2500), ("%lf %S", 0), ("%lf %s", 2500)):
        text, kept = formats.number(f, v, 1000, kept)
        texts.append(text)
    assert texts == ["2.500000 k", "1.500000 M", "0.002500 M", "0.000000 M", "2.500000 k"]
    assert formats.time("%Y/%m %T %q %j", None) == "----/-- --:--:-- - ---" and formats.time("%H:%M", 3600) == "01:00"
    assert formats.number("%lf %s", 1e24, 1024)[0] == "847.032947 ?" and formats.number("%5.1lf%%", None)[0] == "  nan%"
    assert [formats.duration(f, 90061001) for f in ("", "%.3S", "%0.1H", "%5D", "%00010D")] == ["25:01:01", "90061.001", "25.0", "    1", "0000000001"]
    assert formats.duration("x%D y%H", -90061001) == "-x1 y25" and formats.time_of_value("", 1.9) == "1970-01-01 00:00:01"
    for bad in ("%d", "%lf %lf", "%lf%", "%s"):
        with pytest.raises(ValueError):
            formats.number(bad, 1.0)
    with pytest.raises(ValueError):
        formats.duration("%q", 1)
