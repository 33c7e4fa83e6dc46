"""Round-robin files as XML and back."""

from __future__ import annotations

import math
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime
from xml.sax.saxutils import escape

import numpy as np

from ..functions import times
from ..schema import BASIC, Archive, Database, DataSource
from . import rrd

#: What precedes the root for each kind of header.
HEADERS = {
    "none": "<!-- Round Robin Database Dump -->\n<rrd>\n",
    "dtd": '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE rrd SYSTEM "https://oss.oetiker.ch/rrdtool/rrdtool.dtd">\n<!-- Round Robin Database Dump -->\n<rrd>\n',
    "xsd": '<?xml version="1.0" encoding="utf-8"?>\n<!-- Round Robin Database Dump -->\n<rrd xmlns="https://oss.oetiker.ch/rrdtool/rrdtool-dump.xml" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"\n\txsi:schemaLocation="https://oss.oetiker.ch/rrdtool/rrdtool-dump.xml https://oss.oetiker.ch/rrdtool/rrdtool-dump.xsd">\n',
}
#: Names of parameters in the text where they differ from ours.
NAMED = {
    "HWPREDICT": {"hw_alpha": "alpha", "hw_beta": "beta", "dependent_rra_idx": "dependent"},
    "MHWPREDICT": {"hw_alpha": "alpha", "hw_beta": "beta", "dependent_rra_idx": "dependent"},
    "SEASONAL": {"seasonal_gamma": "gamma", "seasonal_smooth_idx": "smooth_index", "smoothing_window": "smoothing_window", "dependent_rra_idx": "dependent"},
    "DEVSEASONAL": {"seasonal_gamma": "gamma", "seasonal_smooth_idx": "smooth_index", "smoothing_window": "smoothing_window", "dependent_rra_idx": "dependent"},
    "DEVPREDICT": {"dependent_rra_idx": "dependent"},
    "FAILURES": {"delta_pos": "delta_pos", "delta_neg": "delta_neg", "window_len": "window", "failure_threshold": "threshold", "dependent_rra_idx": "dependent"},
}
#: Most data sources or archives, and values, that a restored file may have.
MOST_PARTS, MOST_VALUES = 4096, 1_000_000


def _number(x: float | None) -> str:
    if x is None or math.isnan(x):
        return "NaN"
    return f"{x:.10e}" if math.isfinite(x) else "inf" if x > 0 else "-inf"


def lines(whole: rrd.Whole, header: str = "dtd", zone: str = "UTC") -> Iterator[str]:
    """The document in pieces; rows from oldest to newest."""
    h, db, tz = whole.header, whole.header.db, times.zone_of(zone)
    when = lambda t: datetime.fromtimestamp(t, tz).strftime("%Y-%m-%d %H:%M:%S %Z")
    yield HEADERS[header]
    yield f"\t<version>{h.version}</version>\n\t<step>{db.step}</step> <!-- Seconds -->\n\t<lastupdate>{db.last_update}</lastupdate> <!-- {when(db.last_update)} -->\n\n"
    for s, o in zip(db.sources, h.open):
        yield f"\t<ds>\n\t\t<name> {escape(s.name)} </name>\n\t\t<type> {s.kind} </type>\n"
        if s.kind == "COMPUTE":
            yield f"\t\t<cdef> {escape(s.cdef or '')} </cdef>\n"
        else:
            yield f"\t\t<minimal_heartbeat>{s.heartbeat}</minimal_heartbeat>\n\t\t<min>{_number(s.low)}</min>\n\t\t<max>{_number(s.high)}</max>\n"
        yield f"\n\t\t<!-- PDP Status -->\n\t\t<last_ds>{escape(o.last)}</last_ds>\n\t\t<value>{_number(o.value)}</value>\n\t\t<unknown_sec> {o.unknown} </unknown_sec>\n\t</ds>\n\n"
    yield "\t<!-- Round Robin Archives -->\n"
    for i, a in enumerate(db.archives):
        slot = a.pdp_per_row * db.step
        yield f"\t<rra>\n\t\t<cf>{a.cf}</cf>\n\t\t<pdp_per_row>{a.pdp_per_row}</pdp_per_row> <!-- {slot} seconds -->\n\n\t\t<params>\n"
        if a.cf in BASIC:
            yield f"\t\t<xff>{_number(a.xff)}</xff>\n"
        for tag, own in NAMED.get(a.cf, {}).items():
            value = a.params.get(own, 0)
            yield f"\t\t<{tag}>{_number(value) if isinstance(value, float) else value}</{tag}>\n"
        yield "\t\t</params>\n\t\t<cdp_prep>\n"
        for words in h.prep[i]:
            first, second = struct.unpack_from("<dd", words, 64)
            yield f"\t\t\t<ds>\n\t\t\t<primary_value>{_number(first)}</primary_value>\n\t\t\t<secondary_value>{_number(second)}</secondary_value>\n"
            if a.cf in BASIC:
                value, missing = struct.unpack_from("<dQ", words)
                yield f"\t\t\t<value>{_number(value)}</value>\n\t\t\t<unknown_datapoints>{missing}</unknown_datapoints>\n"
            else:
                yield f"\t\t\t<state>{words[:64].hex()}</state>\n"
            yield "\t\t\t</ds>\n"
        yield "\t\t</cdp_prep>\n\t\t<database>\n"
        oldest = h.end(i) - (a.rows - 1) * slot
        for k, row in enumerate(whole.rows[i].tolist()):
            t = oldest + k * slot
            yield f"\t\t\t<!-- {when(t)} / {t} --> <row>{''.join(f'<v>{_number(v)}</v>' for v in row)}</row>\n"
        yield "\t\t</database>\n\t</rra>\n"
    yield "</rrd>\n"


def dump(whole: rrd.Whole, header: str = "dtd", zone: str = "UTC") -> str:
    return "".join(lines(whole, header, zone))


def _float(text: str | None) -> float:
    text = (text or "").strip()
    return math.nan if text.lower() in ("nan", "-nan", "u", "") else float(text)


def restore(text: str, check_range: bool = False) -> rrd.Whole:
    """The file that a document describes; check_range: values outside a source's bounds are unknown."""
    root = ET.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1]
    if root.tag != "rrd":
        raise ValueError("the root is not rrd")
    get = lambda e, tag: (e.findtext(tag) or "").strip()
    sources, opened = [], []
    for e in root.findall("ds"):
        kind = get(e, "type")
        if kind == "COMPUTE":
            sources.append(DataSource(get(e, "name"), kind, 0, cdef=get(e, "cdef")))
        else:
            low, high = (None if math.isnan(x := _float(get(e, t))) else x for t in ("min", "max"))
            sources.append(DataSource(get(e, "name"), kind, int(get(e, "minimal_heartbeat")), low, high))
        opened.append(rrd.Open(get(e, "last_ds"), _float(get(e, "value")), int(get(e, "unknown_sec") or 0)))
    archives, preps, rows = [], [], []
    for e in root.findall("rra"):
        cf, own = get(e, "cf"), e.find("params")
        words = {}
        for tag, name in NAMED.get(cf, {}).items():
            value = get(own, tag) or "0"
            words[name] = int(float(value)) if rrd.PARAMS[cf][name][1] else _float(value)
        prep = []
        for d in e.findall("cdp_prep/ds"):
            raw = bytearray(80)
            if cf in BASIC:
                struct.pack_into("<dQ", raw, 0, _float(get(d, "value")), int(get(d, "unknown_datapoints") or 0))
            else:
                raw[:64] = bytes.fromhex(get(d, "state")).ljust(64, b"\0")
            struct.pack_into("<dd", raw, 64, _float(get(d, "primary_value")), _float(get(d, "secondary_value")))
            prep.append(bytes(raw))
        values = np.array([[_float(v.text) for v in r.findall("v")] for r in e.findall("database/row")], float)
        if values.ndim != 2 or values.shape[1] != len(sources):
            raise ValueError(f"an archive's rows do not have {len(sources)} values each")
        if check_range:
            for k, s in enumerate(sources):
                column = values[:, k]
                column[(column < (-math.inf if s.low is None else s.low)) | (column > (math.inf if s.high is None else s.high))] = math.nan
        archives.append(Archive(cf, _float(get(own, "xff")) if cf in BASIC else 0.0, int(get(e, "pdp_per_row")), len(values), words))
        preps.append(prep)
        rows.append(values)
    if not sources or not archives:
        raise ValueError("a database has at least one DS and one RRA")
    if max(len(sources), len(archives)) > MOST_PARTS or sum(r.size for r in rows) > MOST_VALUES:
        raise ValueError(f"more than {MOST_PARTS} parts or {MOST_VALUES} values")
    seasons = [a.rows for a in archives if a.cf == "SEASONAL"]
    for a in archives:
        if "period" in rrd.PARAMS.get(a.cf, {}):
            a.params["period"] = seasons[0] if seasons else 0  # a season is that archive's rows
    db = Database(int(get(root, "step")), tuple(sources), tuple(archives), None, int(get(root, "lastupdate")))
    return rrd.Whole(rrd.Header(db, get(root, "version"), opened, preps, [a.rows - 1 for a in archives]), rows)
