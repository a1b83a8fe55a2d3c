"""Steps of the replay against a plain loop."""

from __future__ import annotations

from itertools import groupby

from conftest import DATA

from haulmark import plans
from haulmark.sources.tables import STOP_ORDER, stops

SF = str(DATA / "sf0.001")


def test_steps_equal_a_loop_and_need_no_python(spark):
    want = []
    rows = stops(spark, SF).orderBy("route_id", *STOP_ORDER).collect()
    for route, own in groupby(rows, key=lambda r: r.route_id):
        t, battery = 28800.0, 100.0
        for step, r in enumerate(own, 1):
            battery -= r.packages * 1.5
            t = max(t + r.travel_s / 10, 30000.0) + r.service_s
            if r.status == "N":
                t, battery = t + (100.0 - battery) / 100.0 * 3600, 100.0
            want.append((route, step, t, battery))
    got = plans.QUERIES["udtf_route_replay"](spark, SF)
    assert [(n, k) for n, k in got.dtypes] == [("route_id", "bigint"), ("step", "int"), ("t", "double"), ("battery", "double")]
    assert sorted(map(tuple, got.collect())) == want
    assert "Python" not in got._jdf.queryExecution().toString()
