"""Random pairs of a cube, exclusions, lines of a map and the bounded first pass, against plain Python."""

import hashlib
import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.operators import maps, spacetime, structure
from murmuration.plans import catalogue

SHAPE, STEPS = (5, 4, 3), (2.0, 3.0, 4.0)


def _cube(spark):
    rng = np.random.default_rng(3)
    rows = [(i, j, k, *map(float, rng.normal(size=3))) for i in range(5) for j in range(4) for k in range(3) if (i, j, k) != (2, 2, 2)]
    return rows, spark.createDataFrame(rows, "ix long, iy long, iz long, v1 double, v2 double, v3 double")


def _plain_sample(rows, edges, target, budget, least, seed):
    at = {(r[0] * 4 + r[1]) * 3 + r[2]: r for r in rows}
    held, spent, seen, out = [0] * (len(edges) - 1), 0, set(), []
    while spent < budget and min(held) < target:
        size, new = min(budget - spent, max(least, 8 * sum(target - n for n in held))), set()
        for c in range(spent, spent + size):
            h = hashlib.md5(f"{seed},{c}".encode()).hexdigest()  # noqa: S324
            a, b = sorted((int(h[:15], 16) % 60, int(h[16:31], 16) % 60))
            if a != b and (a, b) not in seen:
                new.add((a, b))
        seen |= new
        spent += size
        for a, b in sorted(new):
            if a in at and b in at:
                p, q = np.array(at[a], float), np.array(at[b], float)
                r, m = (q[:3] - p[:3]) * STEPS, (p[3:] + q[3:]) / 2
                lam = np.linalg.norm(np.cross(r, m)) / np.linalg.norm(m)
                if edges[0] <= lam <= edges[-1] and lam > 0:
                    k = min(sum(e <= lam for e in edges) - 1, len(edges) - 2)
                    out.append((a * 60 + b, k, held[k] < target))
                    held[k] += held[k] < target
    return sorted(out), spent, len(seen), min(held) >= target


@pytest.mark.parametrize(("target", "budget", "least"), [(5, 10_000, 40), (60, 900, 100), (3, 50, 7)])
def test_cube_random_pairs(spark, target, budget, least):
    rows, cube = _cube(spark)
    edges = structure.log_edges(*structure.cube_range((8.0, 9.0, 8.0), STEPS), 5)
    assert (edges[0], edges[-1]) == (2.0, 9.0)
    got = structure.cube_random_pairs(cube, SHAPE, STEPS, edges, target, budget, 7, least)
    want, drawn, distinct, covered = _plain_sample(rows, edges, target, budget, least, 7)
    assert sorted((r.id, r.bin, r.taken) for r in got.considered.collect()) == want
    assert (got.drawn, got.distinct, got.covered) == (drawn, distinct, covered)
    one = structure.sampling_diagnostics(got, edges, 2.0, target).first()
    assert one.in_range == len(want) and one.accepted == sum(w[2] for w in want) and math.isclose(one.accepted_fraction, one.accepted / one.in_range)
    table = structure.sampling_bins(got, edges, target).collect()
    assert all(r.accepted == min(r.accepted, target) and r.occupancy == r.accepted / target for r in table)


def test_cube_range_and_errors(spark):
    assert structure.cube_range((8.0, 3.0, 99.0), (2.0, 1.0, 3.0), low=0.1) == (0.5, 8.0)
    with pytest.raises(ValueError):
        structure.cube_range((8.0, 3.0, 9.0), (2.0, 1.0, 3.0), high=0.2)
    _, cube = _cube(spark)
    for bad in ({"target": 0}, {"budget": 0}, {"shape": (1, 1, 1)}):
        with pytest.raises(ValueError):
            structure.cube_random_pairs(**({"grid": cube, "shape": SHAPE, "steps": STEPS, "edges": [1.0, 2.0]} | bad))


def test_exclusions_count_each_reason(spark, tmp_path):
    nan = float("nan")
    fine = dict(x=0.0, y=0.0, z=0.0, v1=1.0, v2=0.0, v3=0.0)
    cases = [({}, {"y": 1.0}), ({"x": nan}, {}), ({"v1": nan}, {"y": 1.0}), ({"x": nan, "v1": nan}, {}), ({"v1": -1.0}, {"y": 1.0}), ({}, {}), ({}, {"x": 5.0}), ({}, {"y": 50.0})]
    rows = [(t, c, *(fine | own).values()) for t, pair in enumerate(cases) for c, own in enumerate(pair)]
    pairs = structure.same_step_pairs(spark.createDataFrame(rows, "step long, sc long, x double, y double, z double, v1 double, v2 double, v3 double"))
    want = {"total": 8, "kept": 1, "bad_position": 2, "bad_field": 2, "zero_field": 1, "zero_lag": 2, "out_of_range": 1}
    assert structure.exclusions(pairs, [0.5, 2.0]).first().asDict() == want
    assert structure.write_valid_pairs(pairs, [0.5, 2.0], str(tmp_path / "pairs")) == want
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 1


def test_lines_of_paths_and_rings(spark):
    rng = random.Random(4)
    names = rng.sample(range(10_000), 140)
    shapes, pieces, want = [("path", 37), ("ring", 40), ("path", 2), ("ring", 3), ("ring", 4), ("path", 3), ("path", 40)], [], {}
    for kind, size in shapes:
        own = [names.pop() for _ in range(size)]
        pieces += list(itertools.pairwise(own)) + ([(own[-1], own[0])] if kind == "ring" else [])
        if kind == "ring":
            k = own.index(min(own))
            own = own[k:] + own[:k]
            own = own if own[1] < own[-1] else [own[0], *own[:0:-1]]
        else:
            own = own if own[0] < own[-1] else own[::-1]
        want[min(own)] = (kind == "ring", own)
    rng.shuffle(pieces)
    pieces = [p if rng.random() < 0.5 else p[::-1] for p in pieces]
    got = {}
    for r in maps.lines(spark.createDataFrame([*pieces, pieces[0]], "a long, b long")).collect():
        got.setdefault(r.line, {})[r.at] = (r.vertex, r.closed, r.size)
    assert set(got) == set(want)
    for line, (closed, own) in want.items():
        assert [got[line][k] for k in range(len(own))] == [(v, closed, len(own)) for v in own]
    assert maps.lines(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rings_of_a_map(spark):
    """A hill has a closed line, half a hill an open one; the plan has no task that gets all pieces."""
    table = spark.range(15).crossJoin(spark.range(15).withColumnRenamed("id", "j")).select(F.col("id").alias("i"), "j", (F.pow(F.col("id") - 7, 2) + F.pow(F.col("j") - 7, 2)).alias("value"))
    ring = sorted(maps.longest_line(maps.level_segments(table, 20.5)).collect())
    assert [r.at for r in ring] == list(range(len(ring))) and all(abs(math.hypot(r.i - 7, r.j - 7) - math.sqrt(20.5)) < 0.2 for r in ring)
    steps = [math.dist((a.i, a.j), (b.i, b.j)) for a, b in itertools.pairwise([*ring, ring[0]])]
    assert max(steps) < 1.5
    half = sorted(maps.longest_line(maps.level_segments(table.where("i >= 7"), 20.5)).collect())
    assert 3 < len(half) < len(ring) and max(math.dist((a.i, a.j), (b.i, b.j)) for a, b in itertools.pairwise(half)) < 1.5
    plan = maps.longest_line(maps.level_segments(table, 20.5))._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("moving", [True, False])
def test_farthest_pair_is_found_among_few(spark, moving):
    rng = np.random.default_rng(5)
    steps, lags, rows = 900, 450, []
    walk = np.cumsum(rng.normal(size=(steps, 5, 3)), 0) * 0.05
    for t in range(steps):
        for c in range(5):
            p = (0.01 * t if moving else 0.0) + walk[t, c] + 3 * c
            if (t, c) not in ((5, 1), (17, 2)):
                rows.append((t, c, *map(float, p)))
    frame = spark.createDataFrame([*rows, (901, 1, float("nan"), 0.0, 0.0)], "step long, sc long, ux double, uy double, uz double")
    got = spacetime.farthest(frame, lags, 32)
    at = np.full((steps, 5, 3), np.nan)
    for t, c, *p in rows:
        at[t, c] = p
    most, pairs = 0.0, 0
    for lag in range(lags + 1):
        d = np.sqrt(((at[lag:, None, :] - at[: steps - lag, :, None]) ** 2).sum(-1))[:, *np.triu_indices(5)]
        most, pairs = max(most, np.nanmax(d)), pairs + int(np.isfinite(d).sum())
    assert math.isclose(got.most, most, rel_tol=1e-12)
    assert got.measured < 0.2 * pairs


def test_tau_bins_and_lags(spark):
    assert spacetime.max_lag(100, explicit=7, seconds=1.0, dt=0.3) == 3 and spacetime.max_lag(100, explicit=7) == 7 and spacetime.max_lag(101) == 50
    with pytest.raises(ValueError):
        spacetime.max_lag(100, seconds=1.0)
    rng = np.random.default_rng(6)
    rows = [(t, c, "H" if c == 0 else f"N{c}", float(rng.normal()), 1.0, float(t), float(c), 0.0) for t in range(60) for c in range(3)]
    frame = spark.createDataFrame(rows, "step long, sc long, label string, fluct double, sigma double, ux double, uy double, uz double")
    edges = spacetime.linear_edges(0.0, 25.0, 4)
    by_lag = spacetime.correlation_map(frame, 20, edges).toPandas()
    one = spacetime.correlation_map(frame, 20, edges, tau_edges=spacetime.centred_edges(20, 0.5), dt=0.5).toPandas()
    key = lambda t, c: sorted(zip(t[c], t.r_bin, t.n, t["corr"].round(12), strict=True))
    assert key(by_lag, "lag") == key(one, "tau_bin")
    some = spacetime.correlation_map(frame, 20, edges, tau_edges=[0.0, 1.0, 5.0], dt=0.5).toPandas()
    for r in some.itertuples():
        own = by_lag[by_lag.lag.between(*((0, 1) if r.tau_bin == 0 else (2, 9))) & (by_lag.r_bin == r.r_bin)]
        assert r.n == own.n.sum() and math.isclose(r.corr, (own.n * own["corr"]).sum() / own.n.sum(), abs_tol=1e-12)
    with pytest.raises(ValueError):
        spacetime.correlation_map(frame, 20, edges, tau_edges=[1.0, 1.0])


def _leaving(steps):
    """Places (step, probe, axis) of a rigid formation with gaps, whose last probe leaves it in the end."""
    rng = np.random.default_rng(7)
    at = np.array([0.11, 0.07, 0.03]) * np.arange(steps)[:, None, None] + rng.normal(size=(1, 4, 3)) * 2
    at[steps // 2 :, 3, 1] += np.cumsum(rng.normal(size=steps - steps // 2)) * 0.1
    at[5, 1] = at[17:29, 2] = np.nan
    return at, rng.normal(size=(steps, 4))


def test_sums_by_spectra_and_step_by_step(spark):
    steps, lags = 200, 99
    at, value = _leaving(steps)
    rows = [(t, c, float(value[t, c]), 0.5 + c, *map(float, at[t, c])) for t in range(steps) for c in range(4) if np.isfinite(at[t, c, 0]) or t == 20]
    frame = spark.createDataFrame(rows, "step long, sc long, fluct double, sigma double, ux double, uy double, uz double").withColumn("label", F.lit("H")).cache()
    there = np.zeros((steps, 4), bool)
    there[[r[0] for r in rows], [r[1] for r in rows]] = True
    g = np.where(there, value, 0) / (0.5 + np.arange(4))
    i, j = np.triu_indices(4)
    r = {k: np.sqrt(((at[k:][:, j] - at[: steps - k][:, i]) ** 2).sum(-1)) for k in range(lags + 1)}
    most = max(np.nanmax(x) for x in r.values())
    assert math.isclose(spacetime.greatest_distance(frame, lags, 4), most, rel_tol=1e-12)
    edges = spacetime.linear_edges(0.0, most, 6)
    got = {(x.lag, x.r_bin): (x.n, x.corr) for x in spacetime.correlation_map(frame, lags, edges, block=4).collect()}
    rigid = {(x.lag, x.i, x.j): x for x in spacetime.rigid_map(frame, lags, 4).collect()}
    for k in range(lags + 1):
        product = g[k:][:, j] * g[: steps - k][:, i]
        for b in range(6):
            own = product[(r[k] >= edges[b]) & (r[k] < edges[b + 1])]
            n, mean = got.get((k, b), (0, 0.0))
            assert n == len(own) and math.isclose(mean, own.mean() if n else 0.0, abs_tol=1e-9), (k, b, n, len(own), mean, own.mean())
        for p in range(len(i)):
            own, both = rigid[k, i[p], j[p]], there[k:, j[p]] & there[: steps - k, i[p]]
            assert own.n == both.sum() and math.isclose(own.total, product[both, p].sum(), abs_tol=1e-9) and abs(own.r - np.nanmin(r[k][:, p])) < 1e-5


def test_what_a_rigid_formation_costs_grows_with_its_steps(spark):
    shape = np.random.default_rng(8).normal(size=(5, 3)) * 2
    for steps in (1000, 2000):
        rows = [(t, c, *map(float, shape[c] + 0.03125 * t * np.array([2.5, 1.2, 1.5]))) for t in range(steps) for c in range(5)]
        frame = spark.createDataFrame(rows, "step long, sc long, ux double, uy double, uz double").withColumn("fluct", F.lit(1.0)).withColumn("sigma", F.lit(1.0))
        lags = steps // 2
        found = spacetime.farthest(frame, lags, 8)
        assert found.measured <= 4 * 8 * steps
        packed, size, n, probes, bounds = spacetime._prepared(frame, lags, 8)
        edges = np.linspace(0, found.most, 13)
        open_ = spacetime._unsure(spark, bounds, lags, lambda a, b: np.searchsorted(edges, a, "right") == np.searchsorted(edges, b, "right"))
        assert open_.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] <= 3
        assert -(-n // size) <= spacetime.COARSE


def _broadcast_rows(plan) -> list[int]:
    """How many rows each broadcast of an executed plan held."""
    name, inner = plan.nodeName(), []
    if name == "AdaptiveSparkPlan":
        inner = [plan.executedPlan()]
    elif name.endswith("QueryStage"):
        inner = [plan.plan()]
    own = [plan.metrics().apply("numOutputRows").value()] if name == "BroadcastExchange" else []
    inner += [plan.children().apply(k) for k in range(plan.children().size())]
    return own + [n for p in inner for n in _broadcast_rows(p)]


def test_scattered_open_lags_take_no_list_of_short_blocks(spark):
    """Far from the origin rounding opens some lags in most runs; what is broadcast for them is bounded by the long blocks."""
    steps, lags = 600, 299
    shape = np.random.default_rng(3).normal(size=(3, 3)) * 2
    at = 1e8 + shape + 0.03125 * np.arange(steps)[:, None, None] * np.array([2.5, 1.2, 1.5])
    at[40:45, 1] = np.nan
    rows = [(t, c, *map(float, at[t, c])) for t in range(steps) for c in range(3) if np.isfinite(at[t, c, 0])]
    frame = spark.createDataFrame(rows, "step long, sc long, ux double, uy double, uz double").withColumn("fluct", F.lit(1.0)).withColumn("sigma", F.lit(1.0)).cache()
    rigid = spacetime.rigid_map(frame, lags, 4)
    got = {(x.lag, x.i, x.j): x for x in rigid.collect()}
    assert max(_broadcast_rows(rigid._jdf.queryExecution().executedPlan())) <= 3 * 3 * spacetime.COARSE * (spacetime.COARSE // 2 + 1)
    assert len(got) == 6 * (lags + 1)
    for (k, i, j), x in got.items():
        r = np.sqrt(((at[k:, j] - at[: steps - k, i]) ** 2).sum(-1))
        assert x.n == np.isfinite(r).sum() and np.floor(x.r * 1e5 + 0.5) == np.floor(np.nanmin(r) * 1e5 + 0.5), (k, i, j, x.r, np.nanmin(r))


def test_places_come_back_as_they_were():
    rng = np.random.default_rng(4)
    for x in (30 + 0.0375 * np.arange(5000.0), rng.normal(size=100) * 10.0 ** rng.integers(-300, 300, 100), np.array([np.nan, -0.0, 0.0, np.inf, -1.5, np.nan]), np.zeros(1)):
        data = spacetime._shrunk(x)
        assert spacetime._regrown(data).tobytes() == x.tobytes()
    assert len(spacetime._shrunk(30 + 0.0375 * np.arange(5000.0))) < 5000


def test_distances_near_a_half_are_rounded_as_in_sql(spark):
    """Distances of the formation at 60 and 360 x sf0.1, where the product with 10**5 lies on the other side of a half than their text."""
    near = [32831.049015, 90584.89055499999, 118309.06047499999, 45486.930844999995, 81510.801585, 150308.592625, 178167.15888499998, 0.0, 2.5]
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(near)], "k long, r double").withColumn("r", catalogue._scaled(F.col("r"), 5))
    got = [x.r for x in catalogue._r(frame, 5).orderBy("k").collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 5)", [r]).fetchone()[0] for r in near]
