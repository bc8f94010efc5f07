"""Routes taken apart into slices and stretches equal whole-route windows; measured metrics before modelled ones."""

from __future__ import annotations

import random

import pytest

from routecover.operators import elevation

POINTS = "area_id long, route_id long, seq long, lng double, lat double, elev double, sampled boolean"


@pytest.fixture(scope="module")
def points(spark):
    """One long route and short ones: standing points, steps longer than a stretch, single points."""
    r = random.Random(9)
    rows = []
    for route, n in ((1, 900), (2, 1), (3, 2), (4, 60)):
        x, y = 10.0, 50.0
        for i in range(n):
            step = r.choice([0.0, 0.00004, 0.0003, 0.0003, 0.09 if route == 4 else 0.001])
            x, y = x + r.choice([-1, 1]) * step, y + step / 2
            rows.append((1, route, i * 3, x, y, 800 + r.uniform(-9, 9), route != 4 or i != 30))
    r.shuffle(rows)
    return spark.createDataFrame(rows, POINTS)


@pytest.mark.parametrize("stretch", [None, 51, 7])
def test_stretches_equal_the_plain_window(points, stretch):
    plain = {(x.route_id, x.seq): x for x in elevation.smoothed(elevation.profile(points)).collect()}
    apart = elevation.smoothed_in_stretches(elevation.profile_in_slices(points), stretch_m=stretch).collect()
    assert len(apart) == len(plain) == 963
    for x in apart:
        p = plain[x.route_id, x.seq]
        assert (x.step, x.lng, x.sampled) == (p.step, p.lng, p.sampled)
        assert (x.dist, x.smooth) == pytest.approx((p.dist, p.smooth), abs=1e-6)


def test_times_of_long_routes(points):
    key = lambda rows: {x.route_id: tuple(x)[2:] for x in rows}
    plain, apart = (key(elevation.route_metrics(points, long_routes=b).collect()) for b in (False, True))
    assert set(plain) == set(apart) == {1, 2, 3, 4}
    for k in plain:
        assert apart[k] == pytest.approx(plain[k], abs=1e-6)
    empty = points.limit(0)
    assert elevation.route_metrics(empty, long_routes=True).count() == 0


def test_measured_before_modelled(spark, points):
    modelled = spark.createDataFrame([(1, k, 1.0, 2.0, 3.0) for k in (1, 2, 4, 5)] + [(1, 6, None, None, None)], "area_id long, route_id long, ascent double, descent double, seconds double")
    got = {x.route_id: x for x in elevation.preferred_metrics(points, modelled).collect()}
    measured = {x.route_id: x for x in elevation.route_metrics(points).collect()}
    assert set(got) == {1, 2, 4, 5, 6} and [k for k in sorted(got) if got[k].measured] == [1]
    assert (got[1].ascent, got[1].seconds) == (measured[1].ascent, measured[1].seconds)
    assert all((got[k].ascent, got[k].descent, got[k].seconds) == (1.0, 2.0, 3.0) for k in (2, 4, 5)) and got[6].seconds is None
