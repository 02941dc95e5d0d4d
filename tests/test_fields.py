"""Field analysis: registered queries against DuckDB, and analytic invariants."""

import itertools
import json
import math
import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.operators import cascade, formation, grid, maps, reconstruct, spacetime, spectrum, structure
from murmuration.plans import catalogue, figures
from murmuration.sinks import tables
from murmuration.sources.views import unpacked

SF = "/root/testdata/sf0.001"


def _rows(frame):
    out = []
    for r in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple("-" if v is None or v != v else f"{float(v):.8g}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v) for v in r))
    return sorted(out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not here")
@pytest.mark.parametrize("name", ["sf_lambda_bins", "st_hub_acf", "grid_trilinear", "recon_metrics", "tetra_counts", "wrapped_path_breaks", "asof_nearest_batch", "st_corr_map", "sf_data_bins", "sf_random_pairs", "series_gaps", "recon_nearest", "requested_times", *figures.ORACLE_SQL])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "supplier", "part", "orders", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    queries, sql = catalogue.QUERIES | figures.QUERIES, catalogue.ORACLE_SQL | figures.ORACLE_SQL
    assert _rows(queries[name](spark, SF).toPandas()) == _rows(con.execute(sql[name]).df())


def test_nearest_times_need_no_frame_to_the_end(spark):
    """A frame that ends with its bucket is gone through anew for each row, so many times on one day take for ever."""
    times = lambda name, seconds: spark.createDataFrame([(k,) for k in seconds], "k long").select(F.timestamp_seconds("k").alias(name))
    asked, known = [90_000 + 7 * k for k in range(400)], [86_400 + 1000 * k for k in range(9)] + [900_000]
    got = formation.asof_nearest(times("a", asked), times("b", known), "a", "b")
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    at = lambda c: F.unix_seconds(c)
    assert {r[0]: r[1] for r in got.select(at("a"), at("b")).collect()} == {a: min(known, key=lambda k: (abs(k - a), k)) for a in asked}


def _affine(spark, shape=(5, 4, 3), box=(4.0, 3.0, 2.0)):
    cells = [(i, j, k, 2.0 * i + j - k + 1, float(j), i - 3.0 * k) for i in range(shape[0]) for j in range(shape[1]) for k in range(shape[2])]
    return spark.createDataFrame(cells, "ix long, iy long, iz long, v1 double, v2 double, v3 double"), shape, box


def test_trilinear_is_exact_for_affine_fields(spark):
    cells, shape, box = _affine(spark)
    p = spark.createDataFrame([(1, 0.5, 1.25, 0.75), (2, 3.9, 2.5, 1.5)], "id long, x double, y double, z double")
    for r in grid.sample_trilinear(p, cells, ["id"], box, shape).join(p, "id").collect():
        assert math.isclose(r.v1, 2 * r.x + r.y - r.z + 1, abs_tol=1e-12) and math.isclose(r.v3, r.x - 3 * r.z, abs_tol=1e-12)


def test_curl_has_no_divergence(spark):
    cells, _, _ = _affine(spark)
    bent = cells.select("ix", "iy", "iz", *[(F.col(v) * F.col(w)).alias(v) for v, w in (("v1", "v2"), ("v2", "v3"), ("v3", "v1"))])
    assert grid.divergence(grid.curl(bent, (1.0, 0.5, 2.0)), (1.0, 0.5, 2.0)).agg(F.max(F.abs("div"))).first()[0] < 1e-9


def test_reconstruction_of_an_affine_field(spark):
    rng = np.random.default_rng(0)
    x = rng.random((30, 3))
    s = spark.createDataFrame([(i, *map(float, p), float(p @ [1, 2, 3])) for i, p in enumerate(x)], "sample_id long, x double, y double, z double, v double")
    q = spark.createDataFrame([(i, *map(float, x[:4].mean(0) * 0 + x[4 * i : 4 * i + 4].mean(0))) for i in range(5)], "id long, x double, y double, z double")
    for name in ("rbf", "linear"):
        for r in reconstruct.build_method(name)(q, s, "id").join(q, "id").collect():
            assert math.isclose(r.v, r.x + 2 * r.y + 3 * r.z, abs_tol=1e-6)
    with pytest.raises(ValueError):
        reconstruct.build_method("other")


def test_redundancy_counts(spark):
    """Generic positions of four craft: 495 combinations, 240 of them reflections."""
    points = spark.range(12).withColumnRenamed("id", "pid")
    assert cascade.combinations(points).count() == 495
    assert cascade.not_redundant(cascade.combinations(points)).count() == 255


def test_contracts(spark):
    with pytest.raises(ValueError):
        structure.log_edges(0, 1, 3)
    with pytest.raises(ValueError):
        spacetime.max_lag(10, explicit=10)
    with pytest.raises(ValueError):
        formation.moving(spark.createDataFrame([("H", 0.0, 0.0, 0.0)], "label string, x double, y double, z double"), 0, 1.0, (1, 1, 1), 1.0, (1, 1, 1))
    assert spacetime.linear_edges(0, 0, 2) == [-0.5, 0.0, 0.5]


def test_the_entry_imports_without_the_llm_folders(tmp_path):
    """In a copy without them the queries of the rest are there, and nothing of the rest imports them."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "murmuration"), tmp_path / "murmuration", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import sys, __spark_entry__ as e; q = e.queries(); assert 'sf_lambda_bins' in q and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q); assert not any('llm' in m for m in sys.modules if m.startswith('murmuration')); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": os.environ.get("PYTHONPATH", "")})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(catalogue.QUERIES) + len(figures.QUERIES)


def test_correlation_blocks_against_pairs(spark):
    """Blocks far smaller than the series and the lags, gaps in the series, against all lagged pairs one by one."""
    rng = np.random.default_rng(5)
    rows = [(t, c, float(t + c), float(c * c), float(rng.normal()), float(rng.normal()), 1.0 + c) for t in range(40) for c in range(3) if (t, c) not in ((5, 1), (17, 2), (18, 2))]
    table = spark.createDataFrame([(t, c, "H" if c == 0 else f"N{c}", f, s, x, y, 0.0) for t, c, x, y, f, _, s in rows], "step long, sc long, label string, fluct double, sigma double, ux double, uy double, uz double")
    want, most, rigid = {}, 0.0, {}
    for t, c, x, y, f, _, s in rows:
        for t2, c2, x2, y2, f2, _, s2 in rows:
            if 0 <= t2 - t <= 20 and c <= c2:
                r = math.hypot(x2 - x, y2 - y)
                most = max(most, r)
                want.setdefault(t2 - t, []).append((r, f * f2 / (s * s2)))
                rigid.setdefault((t2 - t, c, c2), []).append(f * f2 / (s * s2))
    assert math.isclose(spacetime.greatest_distance(table, 20, 7), most)
    edges = spacetime.linear_edges(0.0, 40.0, 5)
    got = {(r.lag, r.r_bin): (r.n, r.corr) for r in spacetime.correlation_map(table, 20, edges, block=7).collect()}
    for lag, pairs in want.items():
        for k in range(5):
            p = [v for r, v in pairs if edges[k] <= r < edges[k + 1]]
            assert (lag, k) not in got if not p else got[lag, k][0] == len(p) and math.isclose(got[lag, k][1], sum(p) / len(p), abs_tol=1e-12)
    assert {(r.lag, r.i, r.j): r.n for r in spacetime.rigid_map(table, 20, 7).collect()} == {k: len(v) for k, v in rigid.items()}


def test_nearest_samples_against_all(spark):
    """Clustered samples, ties, points far outside and positions that aren't finite."""
    rng = np.random.default_rng(9)
    x = np.vstack([rng.random((200, 3)) * 0.01, rng.random((30, 3)) * 5, [[9.0, 9.0, 9.0]] * 3])
    s = spark.createDataFrame([(i, *map(float, p), float(i)) for i, p in enumerate(x)] + [(999, float("nan"), 0.0, 0.0, 1.0)], "sample_id long, x double, y double, z double, v double")
    q = np.vstack([rng.random((60, 3)) * 5, [[-50.0, 3.0, 60.0], [9.0, 9.0, 9.0]]])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(q)] + [(900, None, 1.0, 1.0)], "id long, x double, y double, z double")
    for k in (1, 4):
        got = {}
        for r in reconstruct.nearest_samples(points, s, "id", k).collect():
            got.setdefault(r.id, {})[r.rank] = (round(r.d2, 9), r.sample_id)
        assert len(got) == len(q)
        for i, p in enumerate(q):
            best = sorted((round(float(((y - p) ** 2).sum()), 9), j) for j, y in enumerate(x))[:k]
            assert [got[i][n + 1] for n in range(k)] == best
    assert reconstruct.nearest(points, s.limit(0), "id").count() == 0


def test_join_condition_of_pairs_stays_short(spark):
    """Filters on the lag aren't written out in the join that makes the pairs."""
    rows = spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0, 1.0, 0.0, 0.0)], "step long, sc long, x double, y double, z double, v1 double, v2 double, v3 double")
    plan = structure.structure_functions(structure.same_step_pairs(rows), [0.5, 1.0, 2.0])._jdf.queryExecution().optimizedPlan().toString()
    assert max(len(line) for line in plan.splitlines() if "Join" in line) < 400


def test_subsets_and_completeness(spark):
    rows = spark.createDataFrame([(t, c, float(t)) for t in range(4) for c in ("H", "N1", "N2") if (t, c) != (2, "N1")] + [(0, "H", float("nan"))], "step long, label string, v double")
    got = formation.completeness(rows, ["v"]).first()
    assert (got.rows, got.steps, got.labels, got.missing, got.repeated, got.bad_values, got.complete) == (12, 4, 3, 1, 1, 1, False)
    assert formation.selected(rows, ["H", "N2"]).count() == 9 and formation.selected(rows, None).count() == 12
    for bad in (["N1"], ["H", "H"], ["H", "N9"]):
        with pytest.raises(ValueError):
            formation.selected(rows, bad)


def test_rates_reject_flat_tetrahedra(spark):
    points = spark.createDataFrame([(p, *map(float, xyz), *[float(7 * p + k) for k in range(6)]) for p, xyz in ((0, (0, 0, 0)), (2, (1, 0, 0)), (4, (0, 1, 0)), (6, (1, 1, 0)), (8, (0, 0, 2)))], "pid long, " + ", ".join(f"{n}{k} double" for n in ("l", "yp", "ym") for k in (1, 2, 3)))
    got = {(r.a, r.b, r.c, r.d): r for r in cascade.flagged(cascade.rates(cascade.tetrahedra(points))).collect()}
    assert got[0, 2, 4, 6].reason == "ill-conditioned" and got[0, 2, 4, 6].eps_plus is None and got[0, 2, 4, 6].planarity == 1
    fine = got[0, 2, 4, 8]
    assert fine.reason is None and fine.det == 2 and math.isclose(fine.eps_plus, -0.25 * (14 + 29 + 58 / 2 + 0), rel_tol=1) and fine.condition > 1


@pytest.mark.parametrize(("axes", "n", "near"), [(2, 14, 5), (3, 40, 8)])
def test_linear_against_all_simplices(spark, axes, n, near):
    """Of all simplices of samples around a point the one of least height; points outside, on lattice ties and not finite."""
    rng = np.random.default_rng(axes)
    x = np.round(rng.random((n, 3)), 2)
    position = "xyz"[:axes]
    s = spark.createDataFrame([(i, *map(float, p), float(p[0] ** 2 - p[1] * 3)) for i, p in enumerate(x)], "sample_id long, x double, y double, z double, v double")
    q = rng.random((30, 3)) * 1.2 - 0.1
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(q)] + [(99, None, 0.5, 0.5)], "id long, x double, y double, z double")
    got = {r.id: r.v for r in reconstruct.linear(points, s, "id", position, near=near, chunk=16).collect()}
    assert len(got) == 31 and math.isnan(got[99])
    groups = np.array(list(itertools.combinations(range(n), axes + 1)))
    a = np.concatenate([x[groups][:, :, :axes], np.ones((len(groups), axes + 1, 1))], 2).transpose(0, 2, 1)
    solid = np.abs(np.linalg.det(a)) > 1e-12
    groups, inverse, outside = groups[solid], np.linalg.inv(a[solid]), 0
    height, value = (x[:, :axes] ** 2).sum(1), x[:, 0] ** 2 - x[:, 1] * 3
    for i, p in enumerate(q):
        w = inverse @ np.r_[p[:axes], 1.0]
        cost = np.where((w >= -1e-9).all(1), (w * height[groups]).sum(1), np.inf)
        best = np.flatnonzero(cost <= cost.min() + 1e-9)
        outside += np.isinf(cost.min())
        assert math.isnan(got[i]) if np.isinf(cost.min()) else any(math.isclose(got[i], float(w[k] @ value[groups[k]]), abs_tol=1e-7) for k in best)
    assert 0 < outside < 30


def test_longest_level_line(spark):
    """A ring beside a small one: the larger, closed, each vertex on an edge of the mesh; no line, no rows."""
    nodes = [(i, j, float(min((i - 10) ** 2 + (j - 10) ** 2, 30 + 40 * ((i - 22) ** 2 + (j - 3) ** 2) - 35))) for i in range(26) for j in range(22)]
    table = spark.createDataFrame(nodes, "i long, j long, value double")
    line = sorted(maps.longest_line(maps.level_segments(table, 30.5)).collect())
    assert len(line) > 30 and all(4 < math.hypot(r.i - 10, r.j - 10) < 7 for r in line)
    assert all(r.i == int(r.i) or r.j == int(r.j) for r in line) and max(math.hypot(a.i - b.i, a.j - b.j) for a, b in zip(line, [*line[1:], line[0]], strict=True)) <= math.sqrt(2)
    assert maps.longest_line(maps.level_segments(table, -5.0)).count() == 0
    saddle = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 1.0)], "i long, j long, value double")
    assert maps.level_segments(saddle, 0.4).count() == 2 and maps.level_segments(saddle.where("i + j < 2"), 0.4).count() == 0
    with pytest.raises(ValueError):
        maps.refined(saddle, (1, 2), (5, 5))


def test_refined_map_leaves_holes(spark):
    nodes = spark.createDataFrame([(i, j, 2.0 * i - j) for i in range(5) for j in range(4) if (i, j) != (2, 2)], "i long, j long, value double")
    got = {(r.i, r.j): r.value for r in maps.refined(nodes, (5, 4), (9, 7)).collect()}
    assert all(math.isclose(v, 2.0 * i / 2 - j / 2, abs_tol=1e-12) for (i, j), v in got.items())
    assert set(got) == {(i, j) for i in range(9) for j in range(7) if not (min(i // 2, 3) in (1, 2) and min(j // 2, 2) in (1, 2))}


def test_plane_power_is_that_of_the_whole_plane(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(5, 4, 2, 2))
    v[1, 2, 0] = 0  # a missing cell counts as 0
    cells = [(i, j, k, *map(float, v[i, j, k])) for i in range(5) for j in range(4) for k in range(2) if (i, j, k) != (1, 2, 0)]
    got = {(r.iz, r.kx, r.ky): r.power for r in spectrum.plane_power(spark.createDataFrame(cells, "ix long, iy long, iz long, v1 double, v2 double"), (5, 4)).collect()}
    for k in range(2):
        want = sum(np.abs(np.fft.fft2(v[:, :, k, c])) ** 2 for c in range(2))
        assert all(math.isclose(got[k, a, b], want[a, b], rel_tol=1e-9, abs_tol=1e-9) for a in range(5) for b in range(4))


def test_sinks_and_packed_components(spark, tmp_path):
    rows = spark.createDataFrame([(2, float("nan")), (1, 0.5), (3, None)], "bin int, v double")
    doc = json.loads(tables.document(rows, ["bin"], unit="km").first().json)
    assert doc == {"about": {"unit": "km"}, "rows": [{"bin": 1, "v": 0.5}, {"bin": 2, "v": None}, {"bin": 3, "v": None}]}
    assert json.loads(tables.document(rows.limit(0), ["bin"]).first().json) == {"rows": []}
    with pytest.raises(ValueError):
        tables.write_series(rows, str(tmp_path / "x"), "npz")
    packed = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id long, packed array<double>")
    assert unpacked(packed, "packed", ["ex", "ey", "bx"], ["bx", "ex"]).collect() == [(1, 3.0, 1.0)]
    for bad in ([], ["ex", "ex"], ["bz"]):
        with pytest.raises(ValueError):
            unpacked(packed, "packed", ["ex", "ey", "bx"], bad)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not here")
def test_lookups_side_by_side_keep_their_digits(spark, tmp_path):
    """Means of 0.51 / 101 = 0.0050495049: to 6 digits and then to 4, as the lookup's SQL gives it, it is 0.0051."""
    cell = lambda n, over: (F.floor(F.col("id") / over) % n).cast("int")
    rows = spark.range(210 * 101).select(
        (cell(7, 1) + 1).alias("l_linenumber"), (cell(5, 42) * 10.0 + 1).alias("l_quantity"), F.when(F.col("id") < 210 * 51, 0.01).otherwise(0.0).alias("l_discount"),
        F.make_timestamp(F.lit(1996), cell(6, 7) * 2 + 1, *map(F.lit, (1, 0, 0, 0))).alias("l_shipdate"), F.lit(7.25).alias("l_extendedprice"), F.lit(0.04).alias("l_tax"),
    )
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    shutil.copy(f"{SF}/events.parquet", tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = catalogue.QUERIES["grid_by_method"](spark, str(tmp_path)).toPandas()
    assert _rows(got) == _rows(con.execute(catalogue.ORACLE_SQL["grid_by_method"]).df())
    assert set(got[got.method == "nearest"].v2) == {0.0051}
